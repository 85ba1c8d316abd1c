"""Joins by row number or signature: glued tables, id matching, positive/negative pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.operators.sequence import cumcount
from clickfeat.operators.skew import attach_by_key, hash_position
from clickfeat.session import broadcast_rows


def concat_columns(tables: Sequence[tuple[DataFrame, Sequence[str]]], row: str = "row_id") -> DataFrame:
    """Chosen columns of several tables side by side, renamed ``<table number>_<column>``."""
    renamed = [
        df.select(row, *[F.col(c).alias(f"{i}_{c}") for c in cols])
        for i, (df, cols) in enumerate(tables)
    ]
    return reduce(lambda a, b: a.join(b, row, "inner"), renamed)


def blend_join(models: Mapping[str, DataFrame], score: str = "is_attributed", click_id: str = "click_id") -> DataFrame:
    """One score column per model, brought together by click id."""
    parts = [df.select(click_id, F.col(score).alias(name)) for name, df in models.items()]
    return reduce(lambda a, b: a.join(b, click_id, "inner"), parts)


def match_consume(
    test: DataFrame, supplement: DataFrame, signature: Sequence[str], *, id_col: str = "click_id", row: str = "row_id"
) -> DataFrame:
    """The first supplement row of a signature maps to every test row of it."""
    first = supplement.groupBy(*signature).agg(F.min_by(id_col, row).alias("supplement_id"))
    rows = test.select(*signature, row, F.col(id_col).alias("test_id"))
    return attach_by_key(rows, first, signature, spread_by=row, how="inner").select(
        "supplement_id", "test_id"
    )


def match_pairwise(
    test: DataFrame, supplement: DataFrame, signature: Sequence[str], *, id_col: str = "click_id", row: str = "row_id"
) -> DataFrame:
    """The i-th test row of a signature pairs with its i-th supplement row."""
    left = cumcount(test, signature, "__i", row=row).select(
        *signature, "__i", F.col(id_col).alias("test_id")
    )
    right = cumcount(supplement, signature, "__i", row=row).select(
        *signature, "__i", F.col(id_col).alias("supplement_id")
    )
    return left.join(right, [*signature, "__i"], "inner").select("supplement_id", "test_id")


def pair_pos_neg(
    df: DataFrame,
    *,
    mode: str = "cover",
    label: str = "is_attributed",
    row: str = "row_id",
    seed: int | None = None,
) -> DataFrame:
    """Pairs of a positive and a negative row.

    ``cover``: positives are repeated until every negative has one.
    ``equal``: the i-th positive with the i-th negative, as far as both go.
    Rows are taken in row order, or in seeded hash order.
    """
    flagged = df.withColumn("__positive", (F.col(label) > 0))
    if seed is None:
        numbered = cumcount(flagged, ["__positive"], "__i", row=row)
    else:
        numbered = hash_position(flagged, seed, by=["__positive"], row=row, name="__i")
    positives = numbered.filter(F.col("__positive")).select(F.col(row).alias("pos_id"), "__i")
    negatives = numbered.filter(~F.col("__positive")).select(F.col(row).alias("neg_id"), "__i")
    if mode == "equal":
        return positives.join(negatives, "__i").select("pos_id", "neg_id")
    if mode != "cover":
        raise ValueError(f"unknown pairing mode {mode!r}")
    n_pos = df.filter(F.col(label) > 0).count()
    if n_pos == 0:
        return positives.join(negatives, "__i").select("pos_id", "neg_id")
    wrapped = negatives.withColumn("__i", F.col("__i") % F.lit(n_pos))
    # Few positives mean many negatives per positive: then the counted, small side is broadcast.
    side = F.broadcast(positives) if n_pos <= broadcast_rows(df.sparkSession) else positives
    return wrapped.join(side, "__i").select("pos_id", "neg_id")
