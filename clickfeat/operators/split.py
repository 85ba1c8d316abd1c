"""Unions, splits, folds, samples and batches; random ones are seeded hashes of the row id."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfeat.functions.encode import TEST_HOURS
from clickfeat.operators.skew import hash_bucket_columns, hash_offsets, hash_position, seeded_hash
from clickfeat.session import materialise


def union_sets(sets: Mapping[str, DataFrame]) -> DataFrame:
    """All sets by column name, missing columns null, with their origin in ``src``."""
    parts = [df.withColumn("src", F.lit(name)) for name, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def row_total(df: DataFrame, row: str = "row_id") -> Column:
    """Number of rows, as a scalar subquery; row numbers are contiguous from 0."""
    return df.agg(F.coalesce(F.max(row) + 1, F.lit(0))).scalar()


def split_tail(df: DataFrame, val_size: Column | int, *, src: str = "src", row: str = "row_id") -> DataFrame:
    """Last ``val_size`` train rows are ``valid``, earlier ones ``train``, test rows ``test``.

    Rows appended only to widen the feature scope stay as their own set.
    """
    total = row_total(df.filter(F.col(src) == "train"), row)
    size = F.lit(val_size) if isinstance(val_size, int) else val_size
    train = F.when(F.col(row) >= total - size, "valid").otherwise("train")
    return df.withColumn("split", F.when(F.col(src) == "train", train).otherwise(F.col(src)))


def split_position_hour(df: DataFrame, first: Column | int, hours: Sequence[int] = TEST_HOURS, row: str = "row_id") -> DataFrame:
    """First rows are train; after them the given hours are test, other hours train."""
    late = F.col(row) >= (F.lit(first) if isinstance(first, int) else first)
    return df.withColumn(
        "split", F.when(late & F.col("hour").isin(*hours), "test").otherwise("train")
    )


def folds_contiguous(df: DataFrame, k: int, row: str = "row_id") -> DataFrame:
    """Add ``fold`` 0..k-1: contiguous blocks, the first n % k of them one row longer."""
    n = row_total(df, row)
    small = F.floor(n / F.lit(k)).cast("long")
    long_folds = (n % F.lit(k)).cast("long")
    edge = long_folds * (small + 1)
    r = F.col(row)
    inside_long = F.floor(r / (small + 1))
    after = long_folds + F.floor((r - edge) / F.nullif(small, F.lit(0)))
    return df.withColumn("fold", F.when(r < edge, inside_long).otherwise(after).cast("int"))


def folds_by_chunk(df: DataFrame, chunk: int, k: int, row: str = "row_id") -> DataFrame:
    """Fold of a row's chunk: chunk start over (rows / k)."""
    per_fold = row_total(df, row) / F.lit(k)
    start = F.floor(F.col(row) / F.lit(chunk)) * F.lit(chunk)
    return df.withColumn("fold", F.floor(start / per_fold).cast("int"))


def folds_stratified(df: DataFrame, k: int = 3, seed: int = 42, label: str = "is_attributed", row: str = "row_id") -> DataFrame:
    """Each class is shuffled and dealt out over k folds."""
    ranked = hash_position(df, seed, by=[label], row=row, name="__i")
    return ranked.withColumn("fold", (F.col("__i") % k).cast("int")).drop("__i")


def split_nfold(df: DataFrame, k: int, n: int = 5, seed: int = 10, row: str = "row_id") -> DataFrame:
    """A row is test if its seeded draw from 1..n is k."""
    draw = F.pmod(seeded_hash(seed, F.col(row)), F.lit(n)) + 1
    return df.withColumn("split", F.when(draw == k, "test").otherwise("train"))


def _below_hash_rank(df: DataFrame, want: Callable[[int], int], seed: int, row: str) -> Column:
    """Condition on ``__h``, ``__b`` and the row id that holds for the first rows in hash order.

    ``want`` turns the number of rows into the number wanted.  A count per hash
    bucket tells which bucket the cut falls into; only that bucket's ids are
    ranked, so the sample itself is a filter without shuffle or sort.
    """
    bucketed = hash_bucket_columns(df.select(row), row, seed)
    offsets = materialise(hash_offsets(bucketed))
    total = offsets.agg(F.max("__total")).first()[0] or 0
    rows = min(want(total), total)
    if rows <= 0:
        return F.lit(False)
    cut = offsets.filter((F.col("__offset") < rows) & (F.col("__offset") + F.col("__n") >= rows)).first()
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", row))
    inside = bucketed.filter(F.col("__b") == cut["__b"]).withColumn("__rank", rank)
    last = inside.filter(F.col("__rank") == rows - cut["__offset"]).first()
    same = F.col("__b") == cut["__b"]
    tie = (F.col("__h") == last["__h"]) & (F.col(row) <= last[row])
    return (F.col("__b") < cut["__b"]) | (same & ((F.col("__h") < last["__h"]) | tie))


def sample_exact(df: DataFrame, ratio: float, seed: int = 0, columns: Sequence[str] | None = None, row: str = "row_id") -> DataFrame:
    """Exactly floor(ratio * n) rows without replacement."""
    chosen = _below_hash_rank(df, lambda n: int(n * ratio), seed, row)
    return hash_bucket_columns(df, row, seed).filter(chosen).select(*(columns or df.columns))


def split_random(df: DataFrame, *, ratio: float | None = None, rows: int | None = None, seed: int = 1024, row: str = "row_id") -> DataFrame:
    """Random holdout of a share or of a fixed number of rows, exact and repeatable."""
    if (ratio is None) == (rows is None):
        raise ValueError("give either ratio or rows")
    chosen = _below_hash_rank(df, lambda n: rows if ratio is None else math.ceil(n * ratio), seed, row)
    flagged = hash_bucket_columns(df, row, seed)
    return flagged.withColumn("split", F.when(chosen, "valid").otherwise("train")).select(
        *df.columns, "split"
    )


def shuffle_batches(df: DataFrame, size: int, seed: int = 0, row: str = "row_id") -> DataFrame:
    """Add ``pos`` (rank in seeded random order) and ``batch_id`` of ``size`` rows each."""
    ranked = hash_position(df, seed, row=row)
    return ranked.withColumn("batch_id", F.floor(F.col("pos") / F.lit(size)).cast("long"))


def head_rows(df: DataFrame, n: int, row: str = "row_id") -> DataFrame:
    return df.filter(F.col(row) < n)


def tail_rows(df: DataFrame, n: int, row: str = "row_id") -> DataFrame:
    return df.filter(F.col(row) >= row_total(df, row) - n)
