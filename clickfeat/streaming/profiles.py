"""Per-key click counts kept up to date over a stream of event files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.operators.profiles import HOUR_BUCKETS

MEASURES = ["clk", "down", *HOUR_BUCKETS]


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_counts(stream: DataFrame, keys: Sequence[str], label: str = "is_attributed") -> DataFrame:
    """Clicks, downloads and four-hour counts per key; additive, so a stateful aggregate suffices."""
    six = F.floor(F.col("hour") / 4)
    return stream.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clk"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("down"),
        *[F.sum((six == i).cast("long")).alias(c) for i, c in enumerate(HOUR_BUCKETS)],
    )


def stream_profiles(
    spark: SparkSession,
    path: str,
    to_clicks: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    out: str,
    checkpoint: str,
    *,
    files_per_batch: int = 100,
    batches_per_base: int = 50,
) -> None:
    """Read all files waiting under ``path`` and write the keys each batch changed to ``out``.

    Every batch goes to its own folder, so a batch repeated after a failure
    replaces what it wrote before.  After ``batches_per_base`` batches they are
    compacted, so that readers read each key once and a few batches more.
    """
    schema = spark.read.parquet(path).schema
    source = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        base = base_of(spark, out)
        if batch_id - (-1 if base is None else base) >= batches_per_base:
            compact_profiles(spark, out, keys)

    before = spark.conf.get(STATE_STORE)
    running = running_counts(to_clicks(source), keys).writeStream.outputMode("update")
    # Key states spill to disk instead of filling the executors' memory; a query keeps the store it was started with.
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        handle = (
            running.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
        handle.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)


def batches_of(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches written and not yet compacted, in order."""
    return sorted(int(name.split("=")[1]) for name in _folders(spark, out) if name.startswith("batch_id="))


def base_of(spark: SparkSession, out: str) -> int | None:
    """The last batch that the newest complete base covers, if there is one."""
    done = [int(name.split("=")[1]) for name in _folders(spark, f"{out}/_base") if name.startswith("upto=")]
    return max((n for n in done if _exists(spark, f"{out}/_base/upto={n}/_SUCCESS")), default=None)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def _folders(spark: SparkSession, name: str) -> list[str]:
    path, files = _path(spark, name)
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []


def _newest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame | None:
    """Newest counts of every key: the base, and the batches after it."""
    base = base_of(spark, out)
    later = [n for n in batches_of(spark, out) if base is None or n > base]
    parts = []
    if later:
        written = spark.read.option("basePath", out).parquet(*[f"{out}/batch_id={n}" for n in later])
        parts.append(written.withColumn("batch_id", F.col("batch_id").cast("long")))
    if base is not None:
        parts.append(spark.read.parquet(f"{out}/_base/upto={base}").withColumn("batch_id", F.lit(base).cast("long")))
    if not parts:
        return None
    newest = F.max_by(F.struct(*MEASURES), "batch_id").alias("m")
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(newest).select(*keys, "m.*")


def compact_profiles(spark: SparkSession, out: str, keys: Sequence[str]) -> int | None:
    """Write the newest counts of every key as one base and return the last batch it covers.

    A base counts once Spark has marked it complete, so a compaction that ends half-way loses nothing.  What the base
    before it had replaced is dropped then; that base and the batches since stay for readers that have begun on them.
    """
    batches, base = batches_of(spark, out), base_of(spark, out)
    upto = max(batches, default=None)
    if upto is None or (base is not None and upto <= base):
        return base
    _newest(spark, out, keys).write.mode("overwrite").parquet(f"{out}/_base/upto={upto}")
    old = [f"{out}/batch_id={n}" for n in batches if base is not None and n <= base]
    older = [int(name.split("=")[1]) for name in _folders(spark, f"{out}/_base") if name.startswith("upto=")]
    old += [f"{out}/_base/upto={n}" for n in older if base is not None and n < base]
    for name in old:
        path, files = _path(spark, name)
        files.delete(path, True)
    return upto


def latest_profiles(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Newest counts of every key with its rate, from the newest base and the batches written since."""
    rows = _newest(spark, out, keys)
    if rows is None:
        raise ValueError(f"no batches under {out}")
    return rows.withColumn("rate", F.col("down") / F.nullif(F.col("clk"), F.lit(0)))
