"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# A key with more rows than this is "hot": its rows are spread over several
# tasks.  The number of hot keys is at most (rows / HOT_ROWS), which is what
# bounds every table this package broadcasts by hint.
HOT_ROWS = 5_000_000
# Rows of a hot key are cut into row-number ranges of this length.
SLICE_ROWS = 4_000_000

# Wide feature rows one task sorts at a time.  Tasks are counted from the rows: left to adaptive execution, the narrow
# input of such a stage would be merged into as few tasks as there are cores, whatever its size.
TASK_ROWS = 100_000

# A table is broadcast by hint only when it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000

# Folders of local sessions that name none, by application.
_local_dirs: dict[str, str] = {}

HOT_ROWS_CONF = "spark.clickfeat.hotRows"
SLICE_ROWS_CONF = "spark.clickfeat.sliceRows"
BROADCAST_ROWS_CONF = "spark.clickfeat.broadcastRows"
TASK_ROWS_CONF = "spark.clickfeat.taskRows"


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job of this package assumes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Wide feature plans have several hundred generated classes; the default
        # cache of 100 would compile them again for every run.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_rows(spark: SparkSession, override: int | None = None) -> int:
    if override is not None:
        return int(override)
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def slice_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICE_ROWS_CONF, str(SLICE_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS)))


def task_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(TASK_ROWS_CONF, str(TASK_ROWS)))


def dealt(df, rows: int, key: str):
    """``df`` of ``rows`` rows, partitioned by ``key`` for a stage that widens and sorts them.

    Tasks are counted where as many as run at once would be too large; few rows are left to adaptive execution.
    """
    tasks = -(-rows // task_rows(df.sparkSession))
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(key)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()  # by setCheckpointDir
    if chosen:
        return chosen.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="clickfeat-")
    return _local_dirs[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """Fresh path under the shared folder, one per call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialise(df):
    """Write a summary table once to the shared folder and go on from there.

    Used for tables that are read more than once or whose size decides a join
    strategy; it also keeps plans short.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """Write a table as Parquet under the shared folder and read it back.

    For tables many jobs read, such as a training table: columns can be skipped
    on reading, and a lost executor costs a re-read instead of a re-computation.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
