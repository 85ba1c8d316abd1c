"""Models that learn chunk after chunk: score-then-fit, continued boosting, stacked out-of-fold columns, random trees.

Loops here are over fits, of which there is a stated number whatever the data; each fit is a distributed Spark job.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfeat.learning.learners import FEATURES, LABEL, SCORE, WEIGHT, Learner, Params, int_params, score
from clickfeat.session import stored

# ---- score, then fit ------------------------------------------------------------


def with_step(df: DataFrame, chunk: str, steps: int, name: str = "step") -> DataFrame:
    """Deal chunks 0, 1, 2 ... in order into ``steps`` runs of about equal numbers of chunks."""
    last = df.agg(F.max(chunk)).first()[0] or 0
    return df.withColumn(name, F.floor(F.col(chunk) * steps / F.lit(last + 1)).cast("int"))


def progressive_scores(
    df: DataFrame, learner: Learner, params: Params | None = None, *, chunk: str = "chunk_id", steps: int = 5
) -> DataFrame:
    """Score every chunk by a model that was fitted on the chunks before it only.

    Chunks are dealt into ``steps`` runs; a run is scored by the model of all runs before it and joins the training rows
    of the next, so there are steps - 1 fits.  The first run has no model and its score is null.  Adds ``step``,
    ``fitted_to`` (the last chunk the model saw) and ``score``.  ``df`` is read once per fit and should be stored.
    """
    dealt = with_step(df, chunk, steps)
    bounds = {r["step"]: r["last"] for r in dealt.groupBy("step").agg(F.max(chunk).alias("last")).collect()}
    parts = []
    for step in sorted(bounds):
        here = dealt.filter(F.col("step") == step)
        seen = [s for s in bounds if s < step]
        if not seen:
            parts.append(here.withColumns({"fitted_to": F.lit(None).cast("long"), SCORE: F.lit(None).cast("double")}))
            continue
        model = learner.fit(dealt.filter(F.col("step") < step), params)
        parts.append(score(model, here.withColumn("fitted_to", F.lit(bounds[max(seen)]).cast("long"))))
    return reduce(DataFrame.unionByName, parts) if parts else dealt.withColumns(
        {"fitted_to": F.lit(None).cast("long"), SCORE: F.lit(None).cast("double")}
    )


# ---- boosting continued from chunk to chunk ---------------------------------------


@dataclass
class StagedModel:
    """A prior and stages of trees whose margins add up; ``losses`` has the holdout's after each stage."""

    prior: float
    rate: float
    stages: list[Model] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def add_margin(self, df: DataFrame, name: str = "margin", stages: int | None = None) -> DataFrame:
        out, total = df, F.lit(self.prior)
        for i, model in enumerate(self.stages[:stages]):
            column = f"__stage{i}"
            out = model.copy({model.predictionCol: column}).transform(out)
            total = total + F.lit(self.rate) * F.col(column)
        return out.select(*df.columns, total.alias(name))

    def score(self, df: DataFrame, name: str = SCORE) -> DataFrame:
        return self.add_margin(df, "__margin").select(*df.columns, _sigmoid(F.col("__margin")).alias(name))


def _sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def log_loss(df: DataFrame, margin: str = "margin", label: str = LABEL) -> float:
    """Mean log loss of margins; log(1 + exp(x)) without overflow."""
    x = F.when(F.col(label) > 0, -F.col(margin)).otherwise(F.col(margin))
    return float(df.agg(F.avg(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))).first()[0] or 0.0)


def fit_staged(
    chunks: Sequence[DataFrame], params: Params | None = None, *, rate: float = 0.5, holdout: DataFrame | None = None, patience: int = 2
) -> StagedModel:
    """Boosting that goes on from chunk to chunk: a stage's trees are fitted to what all stages before leave over.

    The target on a chunk is the Newton step (label - p) / (p (1 - p)) of the log loss at the margin so far, with the
    weight p (1 - p) (times the row's weight), so that stages add up on one scale.  With a holdout, fitting ends after
    ``patience`` stages without a lower loss and the stages behind the best are dropped.
    """
    first = chunks[0].agg(F.avg(LABEL)).first()[0]
    share = min(max(first if first is not None else 0.5, 1e-6), 1 - 1e-6)
    model = StagedModel(math.log(share / (1 - share)), rate)
    best, since = (log_loss(model.add_margin(holdout)) if holdout is not None else math.inf), 0
    for chunk in chunks:
        p = _sigmoid(F.col("margin"))
        spread = F.greatest(p * (1 - p), F.lit(1e-4))
        weight = F.col(WEIGHT) if WEIGHT in chunk.columns else F.lit(1.0)
        target = model.add_margin(chunk).select(
            FEATURES, ((F.col(LABEL) - p) / spread).alias("__target"), (spread * weight).alias("__weight")
        )
        if target.isEmpty():
            continue
        maker = GBTRegressor(featuresCol=FEATURES, labelCol="__target", weightCol="__weight", seed=1024, **int_params(params or {}))
        model.stages.append(maker.fit(stored(target, "stage")))
        if holdout is None:
            continue
        model.losses.append(log_loss(model.add_margin(holdout)))
        since = 0 if model.losses[-1] < best else since + 1
        best = min(best, model.losses[-1])
        if since >= patience:
            break
    if holdout is not None and since:
        model.stages, model.losses = model.stages[:-since], model.losses[:-since]
    return model


# ---- stacking -----------------------------------------------------------------------


def out_of_fold_columns(
    df: DataFrame, base: Mapping[str, tuple[Learner, Params]], *, fold: str = "fold", k: int
) -> DataFrame:
    """Add one column per base learner, scored by its fit on the other folds, and ``left_out``: the fold those fits missed.

    The learners of a fold are fitted on the same rows and score the same part one after the other, so that no column
    has to be joined back.
    """
    parts = []
    for i in range(k):
        rest, part = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i).withColumn("left_out", F.lit(i))
        for name, (learner, params) in base.items():
            part = score(learner.fit(rest, params), part, name)
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def stack(
    df: DataFrame,
    base: Mapping[str, tuple[Learner, Params]],
    second: tuple[Learner, Params],
    *,
    fold: str = "fold",
    k: int,
) -> DataFrame:
    """Out-of-fold score of a second learner on the base learners' out-of-fold columns.

    The second learner is fitted on the columns of the other folds.  Each of its inputs was scored by a fit that did not
    see that row.
    """
    first = stored(out_of_fold_columns(df, base, fold=fold, k=k), "stack")
    columns = list(base)
    ready = first.withColumn(FEATURES, array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])))
    learner, params = second
    parts = []
    for i in range(k):
        model = learner.fit(ready.filter(F.col(fold) != i), params)
        parts.append(score(model, ready.filter(F.col(fold) == i)))
    return reduce(DataFrame.unionByName, parts)


# ---- extremely randomised trees ---------------------------------------------------------


@dataclass
class RandomTrees:
    """Groups of trees; the splits of a group lie at its own random thresholds."""

    thresholds: list[list[list[float]]]
    models: list[Model]

    def score(self, df: DataFrame, name: str = SCORE) -> DataFrame:
        out, total = df, F.lit(0.0)
        for g, (cuts, model) in enumerate(zip(self.thresholds, self.models)):
            column = f"__group{g}"
            out = model.copy({model.featuresCol: "__steps", model.predictionCol: column}).transform(discretise(out, cuts)).drop("__steps")
            total = total + F.col(column)
        return out.select(*df.columns, (total / F.lit(float(len(self.models)))).alias(name))


def draw_thresholds(low: Sequence[float], high: Sequence[float], splits: int, rng: random.Random) -> list[list[float]]:
    """Per feature, ``splits`` values drawn evenly between its least and greatest, in order."""
    return [sorted(rng.uniform(a, b) for _ in range(splits)) for a, b in zip(low, high)]


def discretise(df: DataFrame, cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``__steps``: for each feature the number of thresholds below its value."""
    # One expression whatever the number of thresholds: written out, the comparisons make code too long to be compiled.
    thresholds = F.lit([[float(cut) for cut in own] for own in cuts])
    steps = F.zip_with(
        vector_to_array(FEATURES), thresholds, lambda x, own: F.size(F.filter(own, lambda cut: cut < x)).cast("double")
    )
    return df.withColumn("__steps", array_to_vector(steps))


def fit_random_trees(
    df: DataFrame, size: int, params: Params | None = None, *, groups: int = 4, splits: int = 16, seed: int = 0
) -> RandomTrees:
    """Regression trees on random thresholds: every group draws its own, and its trees see the features only through them."""
    values = F.col("__values")
    opened = df.select(vector_to_array(FEATURES).alias("__values"))
    row = opened.agg(*[f(values[i]).alias(f"{n}{i}") for n, f in (("a", F.min), ("b", F.max)) for i in range(size)]).first()
    low, high = ([float(row[f"{n}{i}"] or 0.0) for i in range(size)] for n in "ab")
    out = RandomTrees([], [])
    chosen = {"featureSubsetStrategy": "0.6", **int_params(params or {})}
    for g in range(groups):
        cuts = draw_thresholds(low, high, splits, random.Random(seed * 1_000_003 + g))
        maker = RandomForestRegressor(
            featuresCol="__steps", labelCol=LABEL, bootstrap=False, maxBins=max(32, splits + 1), seed=seed + g, **chosen
        )
        if WEIGHT in df.columns:
            maker = maker.setWeightCol(WEIGHT)
        out.thresholds.append(cuts)
        # A fit reads its rows several times before it keeps them.
        kept = [LABEL, *([WEIGHT] if WEIGHT in df.columns else []), "__steps"]
        out.models.append(maker.fit(stored(discretise(df, cuts).select(*kept), "steps")))
    return out
