"""What the text operators share: input columns, Arrow batches and stored intermediates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.session import stored

# Rows a Python task handles at once; texts of one slice are in memory together.
SLICE_ROWS = 512

# Bits of the sketch that prunes rows by id; at most 16 MB, whatever the input.
SKETCH_BITS = 1 << 27

__all__ = ["SLICE_ROWS", "kept", "pruned", "shuffle_partitions", "slices", "stored", "texts_of"]


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, so that no other column of the input can clash; null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of few rows: bounds what one step holds in Python memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept(df: DataFrame) -> DataFrame:
    """A small table written to the shared folder and read back.

    The plan starts anew from files: it has no lineage, no constraints that grow from step to step, and a size that a
    join can check before it broadcasts.
    """
    return stored(df, "step")


def pruned(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` may be among the one-column table ``ids``: all that are, and some others.

    The ids become a bitmap of ``SKETCH_BITS`` hashed bits, cut into maps of 4 KB that are broadcast: rows are not
    moved and the plan is the same at every size.  With very many ids the bitmap fills up and prunes less.
    """

    def slot(name: str):
        return F.pmod(F.xxhash64(F.col(name)), F.lit(SKETCH_BITS)) + 1

    slots = ids.select(slot(ids.columns[0]).alias("slot")).withColumn("__part", F.bitmap_bucket_number("slot"))
    maps = slots.repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__map"))
    placed = rows.withColumn("__slot", slot(column)).withColumn("__part", F.bitmap_bucket_number("__slot"))
    position = F.bitmap_bit_position("__slot")
    byte = F.conv(F.hex(F.substring("__map", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (position % 8).cast("int")) == 1
    return placed.join(F.broadcast(kept(maps)), "__part").filter(hit).select(*rows.columns)
