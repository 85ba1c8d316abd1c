"""Monotone calibration of scores.

The fit pools adjacent violators in ranges of scores, one Spark task per range, and then range after range with its
neighbours: the ranges of the next level begin in the middle of those before, so that every old border lies inside a new
range, and neighbours are joined up to twice as many blocks as on the level before.  Pooling gives the same blocks in
any order, so the fit is done when no border is violated: after as many levels as the number of ranges can be halved.
Noisy labels leave few blocks of a range, so joined ranges stay small; only a violation that reaches across many ranges
without blocks to pool makes them large.  The driver sees one row per range; blocks and scores stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfeat.operators.skew import attach_by_key
from clickfeat.session import stored

# Blocks that one task pools at once.
RANGE_BLOCKS = 100_000

_BLOCK = "r int, lo double, hi double, s double, n double"


@dataclass(frozen=True)
class IsotonicFit:
    """Blocks of equal fit: ``lo`` and ``hi`` score, ``fit``, ``n`` rows; both bounds are included."""

    blocks: DataFrame
    levels: int


def _kept(score: str, digits: int | None) -> Column:
    value = F.col(score).cast("double")
    return value if digits is None else F.round(value, digits)


def _known(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column)


class _Pool:
    """Stack of blocks in score order; a block that is not above the one before is pooled with it."""

    def __init__(self):
        self.rows: list[tuple[float, float, float, float]] = []

    def add(self, lo: float, hi: float, s: float, n: float) -> None:
        rows = self.rows
        while rows and rows[-1][2] * n >= s * rows[-1][3]:
            lo, _, before, count = rows.pop()
            s, n = s + before, n + count
        rows.append((lo, hi, s, n))

    def batch(self, r: int) -> pa.RecordBatch:
        lo, hi, s, n = (np.array(x, dtype=float) for x in zip(*self.rows)) if self.rows else [np.zeros(0)] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(lo), r, dtype=np.int32)), *map(pa.array, (lo, hi, s, n))], names=["r", "lo", "hi", "s", "n"]
        )


def _pool_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pool = _Pool()
    for batch in batches:
        for row in zip(*[batch.column(i).to_numpy() for i in range(4)]):
            pool.add(*row)
    yield pool.batch(TaskContext.get().partitionId())


def _pool_range(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    pool = _Pool()
    for row in rows.sort_values("lo")[["lo", "hi", "s", "n"]].itertuples(index=False):
        pool.add(*row)
    return pool.batch(int(key[0])).to_pandas()


def _borders(blocks: DataFrame) -> pd.DataFrame:
    """One row per range in order: blocks, middle block, mean of the first and the last block."""
    place = Window.partitionBy("r").orderBy("lo")
    numbered = blocks.select("r", "lo", (F.col("s") / F.col("n")).alias("m"), F.row_number().over(place).alias("i"))
    sized = numbered.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("r")))
    return (
        sized.groupBy("r")
        .agg(
            F.max("size").alias("size"),
            F.min("lo").alias("lo"),
            F.max(F.when(F.col("i") == F.floor(F.col("size") / 2) + 1, F.col("lo"))).alias("middle"),
            F.min_by("m", "lo").alias("first"),
            F.max_by("m", "lo").alias("last"),
        )
        .toPandas()
        .sort_values("lo")
    )


def _next_cuts(ranges: pd.DataFrame, most: int) -> list[float]:
    """Scores at which new ranges begin: the middles of the old ones, as few as keep a range within ``most`` blocks."""
    sizes, middles = ranges["size"].tolist(), ranges["middle"].tolist()
    cuts: list[float] = []
    held = sizes[0] // 2
    for i in range(len(sizes)):
        # From this middle to the next.
        ahead = sizes[i] - sizes[i] // 2 + (sizes[i + 1] // 2 if i + 1 < len(sizes) else 0)
        # The middle of a single block is an old border: no new range begins there while it can be helped.
        if held + ahead > most and (sizes[i] > 1 or held > 2 * most):
            cuts.append(middles[i])
            held = 0
        held += ahead
    return cuts


def fit_isotonic(
    df: DataFrame, score: str, label: str, digits: int | None = None, range_blocks: int = RANGE_BLOCKS
) -> IsotonicFit:
    """Isotonic fit of the label on the score.

    Rows are first summed per score, which gives the same fit.  Scores stay as they are; ``digits``, given at fit and
    at use, rounds them.  Rows with a null or NaN score or label are left out.
    """
    points = df.select(_kept(score, digits).alias("lo"), F.col(label).cast("double").alias("y"))
    points = points.filter(_known("lo") & _known("y")).groupBy("lo").agg(F.sum("y").alias("s"), F.count("y").cast("double").alias("n"))
    points = stored(points.select("lo", F.col("lo").alias("hi"), "s", "n"), "isotonic-points")
    parts = max(1, -(-2 * points.count() // range_blocks))
    ordered = points.repartitionByRange(parts, "lo").sortWithinPartitions("lo")
    blocks = stored(ordered.mapInArrow(_pool_partition, _BLOCK), "isotonic-blocks")
    levels, most = 1, range_blocks
    while True:
        ranges = _borders(blocks)  # one row per range
        broken = (ranges["last"].to_numpy()[:-1] >= ranges["first"].to_numpy()[1:]).any() if len(ranges) > 1 else False
        if not broken:
            return IsotonicFit(blocks.select("lo", "hi", (F.col("s") / F.col("n")).alias("fit"), "n"), levels)
        cuts = sorted(set(_next_cuts(ranges, most)))
        ranged = blocks.withColumn("r", F.lit(0))
        if cuts:
            splits = [float("-inf"), *cuts, float("inf")]
            ranged = Bucketizer(splits=splits, inputCol="lo", outputCol="r").transform(blocks.drop("r"))
        pooled = ranged.withColumn("r", F.col("r").cast("int")).groupBy("r").applyInPandas(_pool_range, _BLOCK)
        blocks = stored(pooled, "isotonic-blocks")
        levels, most = levels + 1, 2 * most


def _corners(fit: IsotonicFit) -> DataFrame:
    """Score and fit at both ends of every block."""
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")
    return fit.blocks.select(ends, "fit")


def apply_isotonic(
    fit: IsotonicFit, df: DataFrame, score: str, name: str, digits: int | None = None, outside: str = "clip", row: str | None = None
) -> DataFrame:
    """Add the fit at each score: a block's value, between blocks the straight line.

    Scores beyond the fitted ones get the nearest value (``clip``) or 0 (``zero``); null and NaN scores get 0.  Distinct
    scores and the blocks' ends are put in order together, in ranges of equal size; what lies before and after a range
    is added from a table of one row per range.
    """
    if outside not in ("clip", "zero"):
        raise ValueError(f"outside must be 'clip' or 'zero', not {outside!r}")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = df.withColumn("__x", F.when(~F.isnan(_kept(score, digits)), _kept(score, digits)))
    asked = scored.filter("__x is not null").groupBy("__x").agg(F.count(F.lit(1)).alias("__n"))
    corner = F.struct("x", F.col("fit").alias("y"))
    both = asked.select(F.col("__x").alias("x"), "__n", F.lit(None).cast("struct<x:double,y:double>").alias("c")).unionByName(
        _corners(fit).select("x", F.lit(None).cast("long").alias("__n"), corner.alias("c"))
    )
    # Range bounds are sampled, so the table is stored with the number of its range.
    ordered = both.repartitionByRange(parts, "x").withColumn("p", F.spark_partition_id())
    ordered = stored(ordered, "isotonic-scores")
    # Both frames grow with the rows: a frame that shrinks is worked out anew for every row.
    up, down = Window.partitionBy("p").orderBy("x"), Window.partitionBy("p").orderBy(F.desc("x"))
    before = F.last("c", ignorenulls=True).over(up.rangeBetween(Window.unboundedPreceding, 0))
    after = F.last("c", ignorenulls=True).over(down.rangeBetween(Window.unboundedPreceding, 0))
    # One row per range.
    edges = ordered.filter("c is not null").groupBy("p").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    numbers = ordered.select("p").distinct().join(edges, "p", "left")
    past = (Window.unboundedPreceding, -1)
    edges = numbers.select(
        "p",
        F.last("high", ignorenulls=True).over(Window.orderBy("p").rowsBetween(*past)).alias("left"),
        F.last("low", ignorenulls=True).over(Window.orderBy(F.desc("p")).rowsBetween(*past)).alias("right"),
    )
    near = ordered.select("p", "x", "__n", before.alias("b"), after.alias("a")).filter("__n is not null")
    near = near.join(F.broadcast(edges), "p").select(
        "x", "__n", F.coalesce("b", "left").alias("b"), F.coalesce("a", "right").alias("a")
    )
    b, a = F.col("b"), F.col("a")
    line = b["y"] + (a["y"] - b["y"]) * (F.col("x") - b["x"]) / (a["x"] - b["x"])
    alone = F.coalesce(b["y"], a["y"]) if outside == "clip" else F.lit(0.0)
    value = (
        F.when(b.isNull() | a.isNull(), alone).when(a["x"] == b["x"], b["y"]).when(a["y"] == b["y"], b["y"]).otherwise(line)
    )
    values = near.select(F.col("x").alias("__x"), value.alias(name), "__n")
    spread = row if row is not None else df.columns[0]
    return attach_by_key(scored, values, ["__x"], "__n", spread_by=spread).select(
        *df.columns, F.coalesce(F.col(name), F.lit(0.0)).alias(name)
    )
