"""Ranking and error metrics over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickfeat.operators.skew import row_index, running_totals
from clickfeat.session import materialise


def auc_exact(df: DataFrame, score: str, label: str = "is_attributed", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half; null without both classes.

    Rows are first counted per distinct score; the number of negatives below
    each score is a distributed running total.  Rows whose score is null or NaN
    have no rank and are left out; a null group is a group of its own.
    """
    by = list(by)
    positive = (F.col(label) > 0).cast("long")
    per_score = (
        df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*by, F.col(score).cast("double").alias("__s"))
        .agg(F.sum(positive).alias("__pos"), F.sum(1 - positive).alias("__neg"))
    )
    ranked = running_totals(per_score, "__s", ["__neg"], by)
    wins = F.col("__pos") * (F.col("__neg_before") + F.col("__neg") / F.lit(2.0))
    pairs = F.sum("__pos").cast("double") * F.sum("__neg").cast("double")
    return ranked.groupBy(*by).agg(
        (F.sum(wins) / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        F.sum("__pos").alias("positives"),
        F.sum("__neg").alias("negatives"),
    )


def auc_grid(df: DataFrame, score: str, label: str = "is_attributed", steps: int = 1000) -> DataFrame:
    """AUC as a left sum over ``steps`` equal thresholds from 0 to 1.

    A row passes the thresholds up to its grid index, so counting rows per
    index gives at most ``steps + 1`` rows for the running sums.
    """
    top = steps - 1
    s = F.col(score).cast("double")
    guess = F.floor(s * F.lit(float(top)))
    # The product can round across a threshold; settle it against the threshold itself.
    index = (
        F.when((guess + 1) / F.lit(float(top)) <= s, guess + 1)
        .when(guess / F.lit(float(top)) > s, guess - 1)
        .otherwise(guess)
    )
    index = F.least(F.greatest(index, F.lit(-1)), F.lit(top)).cast("int")
    positive = (F.col(label) > 0).cast("long")
    counts = df.filter(s.isNotNull() & ~F.isnan(s)).groupBy(index.alias("k")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    grid = df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("k"))
    filled = grid.join(F.broadcast(counts), "k", "left").na.fill(0, ["pos", "neg"])
    passing = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    rates = filled.select(
        "k",
        (F.sum("pos").over(passing) / F.nullif(F.sum("pos").over(every), F.lit(0))).alias("pta"),
        (F.sum("neg").over(passing) / F.nullif(F.sum("neg").over(every), F.lit(0))).alias("pfa"),
    ).filter("k >= 0")
    before = F.coalesce(F.lag("pfa").over(Window.orderBy("k")), F.lit(1.0))
    return rates.select((F.col("pta") * (before - F.col("pfa"))).alias("a")).agg(
        F.sum("a").alias("auc")
    )


def rmse(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    error = F.col(label) - F.col(score)
    return df.groupBy(*by).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def accuracy_at(df: DataFrame, score: str, threshold: float, label: str = "is_attributed", by: Sequence[str] = ()) -> DataFrame:
    """Share of positives and of negatives at or above the threshold."""
    hit = (F.col(score) >= threshold).cast("long")
    y = (F.col(label) > 0).cast("long")
    return df.groupBy(*by).agg(
        (F.sum(hit * y) / F.nullif(F.sum(y), F.lit(0))).alias("tp_rate"),
        (F.sum(hit * (1 - y)) / F.nullif(F.sum(1 - y), F.lit(0))).alias("fp_rate"),
    )


def fold_summary(scores: DataFrame, score: str = "auc") -> DataFrame:
    """Mean, population deviation and 1 - mean of the fold scores."""
    return scores.agg(
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        (1 - F.avg(score)).alias("error"),
    )


# Batches of one block; 0.8 to this power is below the last bit of a double against 1.
BLOCK = 256


def running_score(scores: DataFrame, order: str, score: str = "auc") -> DataFrame:
    """Running mean m = 0.2 * (4 m + score), started with the first score.

    ``scores`` has one row per batch.  Batches are numbered and cut into blocks.  Inside a block the mean has a
    closed form with powers of at most 0.8^-256, which a double holds.  What earlier blocks add is the end of the
    block before and, damped by 0.8^256, of the one before that; a third would change no bit.
    """
    numbered = row_index(scores, [order], "__i").withColumns(
        {
            "__block": F.floor(F.col("__i") / BLOCK).cast("long"),
            "__at": (F.col("__i") % BLOCK).cast("double"),
        }
    )
    share = F.when(F.col("__i") == 0, F.col(score)).otherwise(F.lit(0.2) * F.col(score))
    inside = Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = numbered.withColumn("__x", share / F.pow(F.lit(0.8), F.col("__at"))).withColumn(
        "__own", F.sum("__x").over(inside) * F.pow(F.lit(0.8), F.col("__at"))
    )
    ends = materialise(own.filter(F.col("__at") == BLOCK - 1).select("__block", F.col("__own").alias("__end")))
    earlier = [
        ends.select((F.col("__block") + back).alias("__block"), F.col("__end").alias(f"__end{back}")) for back in (1, 2)
    ]
    joined = own.join(earlier[0], "__block", "left").join(earlier[1], "__block", "left")
    carry = F.coalesce("__end1", F.lit(0.0)) + F.lit(0.8**BLOCK) * F.coalesce("__end2", F.lit(0.0))
    running = F.col("__own") + carry * F.pow(F.lit(0.8), F.col("__at") + 1)
    return joined.select(*scores.columns, running.alias("running"))
