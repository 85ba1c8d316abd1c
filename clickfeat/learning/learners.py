"""Learners by name: a maker of a Spark ML estimator and its parameter space."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    FMClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import FeatureHasher, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameters that are whole numbers.
INT_PARAMS = frozenset(
    "maxIter maxDepth maxBins numTrees minInstancesPerNode seed factorSize blockSize n_estimators".split()
)
LABEL, FEATURES, WEIGHT, SCORE = "label", "features", "weight", "score"

Params = Mapping[str, object]


def int_params(params: Params) -> dict[str, object]:
    """Whole-number parameters as int, however the search drew them."""
    return {k: int(v) if k in INT_PARAMS and v is not None else v for k, v in params.items()}


@dataclass(frozen=True)
class Learner:
    """``make(params)`` builds the estimator; ``space`` lists the values a search draws from."""

    name: str
    make: Callable[[dict], Estimator]
    space: Mapping[str, Sequence] = field(default_factory=dict)
    weighted: bool = True

    def create(self, params: Params | None = None) -> Estimator:
        return self.make(int_params(params or {}))

    def fit(self, df: DataFrame, params: Params | None = None) -> Model:
        estimator = self.create(params)
        if self.weighted and WEIGHT in df.columns:
            estimator = estimator.copy({estimator.weightCol: WEIGHT})
        return estimator.fit(df)


def score(model: Model, df: DataFrame, name: str = SCORE) -> DataFrame:
    """Add the score: the probability of class 1, else the margin, else the prediction."""
    out = model.transform(df)
    if "probability" in out.columns:
        value = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        value = vector_to_array("rawPrediction")[1]
    else:
        value = F.col("prediction").cast("double")
    return out.select(*df.columns, value.alias(name))


def assemble(df: DataFrame, columns: Sequence[str], label: str = "is_attributed") -> DataFrame:
    """Dense feature vector (nulls are 0) and a double label."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    vector = VectorAssembler(inputCols=list(columns), outputCol=FEATURES)
    return vector.transform(filled).withColumn(LABEL, F.col(label).cast("double"))


def hash_categories(
    df: DataFrame, categories: Sequence[str], numbers: Sequence[str] = (), slots: int = 1 << 20, label: str = "is_attributed"
) -> DataFrame:
    """One-hot hashed categories and numbers as one sparse vector."""
    hasher = FeatureHasher(
        inputCols=[*categories, *numbers],
        outputCol=FEATURES,
        numFeatures=slots,
        categoricalCols=list(categories),
    )
    return hasher.transform(df).withColumn(LABEL, F.col(label).cast("double"))


def balance_weight(label: str = LABEL, positive: float = 99.7):
    """Weight column for rare positives."""
    return F.when(F.col(label) > 0, F.lit(float(positive))).otherwise(F.lit(1.0))


def resample_by_weight(df: DataFrame, weight: str, seed: int = 0, row: str = "row_id") -> DataFrame:
    """Keep each row with probability ``weight`` (0..1), repeatably.

    For learners without a weight column.
    """
    draw = F.pmod(F.xxhash64(F.col(row), F.lit(seed).cast("long")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.filter(draw < F.col(weight))


def fit_boosted(df: DataFrame, valid: str, params: Params | None = None) -> Model:
    """Boosted trees that stop early on the rows flagged by the boolean column ``valid``."""
    estimator = REGISTRY["gbt"].create(params)
    estimator = estimator.copy({estimator.validationIndicatorCol: valid})
    if WEIGHT in df.columns:
        estimator = estimator.copy({estimator.weightCol: WEIGHT})
    return estimator.fit(df)


def random_ridge(df: DataFrame, size: int, params: Params | None = None, seed: int = 0, row: str = "row_id") -> list[tuple[Model, VectorSlicer]]:
    """Ridge fits on seeded row and column subsets; score with ``score_ridges``."""
    chosen = dict(params or {})
    members = int(chosen.pop("n_estimators", 5))
    rows, cols = float(chosen.pop("subsample", 0.75)), float(chosen.pop("max_features", 0.5))
    keep = max(1, int(round(cols * size)))
    fits = []
    for m in range(members):
        subset = sorted(random.Random(seed + m).sample(range(size), keep))
        slicer = VectorSlicer(inputCol=FEATURES, outputCol="subset", indices=subset)
        part = resample_by_weight(df.withColumn("__keep", F.lit(rows)), "__keep", seed + m, row)
        estimator = REGISTRY["ridge"].create(chosen).setFeaturesCol("subset")
        fits.append((estimator.fit(slicer.transform(part)), slicer))
    return fits


def score_ridges(fits: list[tuple[Model, VectorSlicer]], df: DataFrame, name: str = SCORE) -> DataFrame:
    """Average of the members' predictions, all in one projection."""
    out = df
    names = []
    for i, (model, slicer) in enumerate(fits):
        column = f"__r{i}"
        one = model.copy({model.predictionCol: column})
        out = one.transform(slicer.transform(out)).drop("subset")
        names.append(column)
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return out.select(*df.columns, (total / F.lit(float(len(names)))).alias(name))


def importance(model: Model, names: Sequence[str], spark) -> DataFrame:
    """Importance of every feature of a fitted tree model; one row per feature."""
    values = model.featureImportances.toArray()
    rows = [(n, float(values[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def _linear(kind: float) -> Callable[[dict], Estimator]:
    def make(p: dict) -> Estimator:
        return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, elasticNetParam=kind, **p)

    return make


def _mlp(p: dict) -> Estimator:
    return MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=LABEL, **p)


def _entry(name: str, cls, space: Mapping[str, Sequence], weighted: bool = True, **fixed) -> Learner:
    return Learner(
        name, lambda p: cls(featuresCol=FEATURES, labelCol=LABEL, **{**fixed, **p}), space, weighted
    )


_TREES = {"maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 5, 15], "featureSubsetStrategy": ["0.3", "0.6", "1.0"]}

REGISTRY: dict[str, Learner] = {
    learner.name: learner
    for learner in (
        _entry("gbt", GBTClassifier, {**_TREES, "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.7, 1.0]}, seed=1024),
        _entry("lr", LogisticRegression, {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}),
        Learner("lasso", _linear(1.0), {"regParam": [1e-5, 1e-4, 1e-3, 1e-2, 1e-1]}),
        Learner("ridge", _linear(0.0), {"regParam": [0.01, 0.1, 1.0, 10.0, 20.0]}),
        _entry("linear_sv", LinearSVC, {"regParam": [0.01, 0.1, 1.0]}),
        _entry("rf", RandomForestRegressor, {**_TREES, "numTrees": [10, 20, 50]}, seed=1024),
        _entry(
            "extra_trees",
            RandomForestRegressor,
            {**_TREES, "numTrees": [10, 20, 50]},
            seed=1024,
            bootstrap=False,
            featureSubsetStrategy="0.3",
        ),
        _entry("gbm", GBTRegressor, {**_TREES, "stepSize": [0.05, 0.1]}, seed=1024),
        # The weight column of these two has no effect; resample by weight instead.
        _entry("fm", FMClassifier, {"factorSize": [4, 8], "stepSize": [0.01, 0.05]}, weighted=False, seed=1024),
        Learner("mlp", _mlp, {"maxIter": [20, 50]}, weighted=False),
    )
}


def get_learner(name: str) -> Learner:
    try:
        return REGISTRY[name.strip()]
    except KeyError:
        raise KeyError(f"no learner {name!r}; known: {sorted(REGISTRY)}") from None
