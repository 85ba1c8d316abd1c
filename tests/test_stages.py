"""Learners that go on from chunk to chunk, stacking, and random trees."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickfeat.learning import learners, stages, tune


@pytest.fixture(scope="module")
def rows(spark):
    """The label follows two features and is noisy; a third feature says nothing."""
    rng = np.random.default_rng(3)
    n = 3000
    x, z, noise = rng.random(n), rng.random(n), rng.random(n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(6 * x + 4 * (z > 0.5) - 5)))).astype(int)
    frame = pd.DataFrame({"row_id": range(n), "x": x, "z": z, "noise": noise, "is_attributed": y})
    table = learners.assemble(spark.createDataFrame(frame), ["x", "z", "noise"])
    table = table.withColumn("fold", (F.col("row_id") % 3).cast("int")).withColumn("chunk_id", F.floor(F.col("row_id") / 100))
    return table.select("row_id", "chunk_id", "fold", "label", "features").cache()


def test_stages_lower_the_holdout_loss(rows):
    chunks = [rows.filter((F.col("chunk_id") % 5) == i) for i in range(4)]
    holdout = rows.filter((F.col("chunk_id") % 5) == 4)
    model = stages.fit_staged(chunks, {"maxIter": 3, "maxDepth": 3}, holdout=holdout)
    prior = stages.log_loss(model.add_margin(holdout, stages=0))
    assert len(model.stages) == len(model.losses) >= 3
    assert all(b < a for a, b in zip([prior, *model.losses], model.losses))
    # The margin of all stages is the sum of what each adds.
    margins = [model.add_margin(holdout, stages=i).agg(F.sum("margin")).first()[0] for i in range(len(model.stages) + 1)]
    assert len(set(margins)) == len(margins)
    scored = model.score(holdout)
    assert scored.filter("score < 0 or score > 1").isEmpty() and tune.auc_of(scored) > 0.8


def test_stages_end_early_and_drop_what_does_not_help(rows, spark):
    chunks = [rows.filter((F.col("chunk_id") % 5) == i) for i in range(2)]
    # From the third chunk on the labels are turned around.
    turned = [rows.filter((F.col("chunk_id") % 5) == i).withColumn("label", 1 - F.col("label")) for i in (2, 3, 2, 3)]
    holdout = rows.filter((F.col("chunk_id") % 5) == 4)
    model = stages.fit_staged([*chunks, *turned], {"maxIter": 3, "maxDepth": 3}, holdout=holdout, patience=2)
    assert len(model.stages) == 2
    empty = rows.limit(0)
    assert stages.fit_staged([empty, empty]).stages == []


def test_progressive_models_saw_earlier_chunks_only(rows):
    class Spy:
        seen = []

        def fit(self, df, params=None):
            self.seen.append(df.agg(F.max("chunk_id")).first()[0])
            return learners.get_learner("lr").fit(df, params)

    out = stages.progressive_scores(rows, Spy(), {"maxIter": 5}, steps=4).cache()
    assert out.count() == rows.count() and len(Spy.seen) == 3
    firsts = {r.step: (r.first, r.fitted_to) for r in out.groupBy("step").agg(F.min("chunk_id").alias("first"), F.max("fitted_to").alias("fitted_to")).collect()}
    assert [firsts[i][1] for i in range(4)] == [None, *Spy.seen]
    assert all(first > fitted for first, fitted in list(firsts.values()) if fitted is not None)
    assert out.filter("step = 0 and score is not null").isEmpty() and out.filter("step > 0 and score is null").isEmpty()
    assert tune.auc_of(out.filter("score is not null")) > 0.8


def test_stacked_values_are_out_of_fold(rows):
    base = {"a": (learners.get_learner("lr"), {"maxIter": 5}), "b": (learners.get_learner("rf"), {"numTrees": 5, "maxDepth": 4})}
    out = stages.stack(rows, base, (learners.get_learner("lr"), {"maxIter": 10}), k=3).cache()
    assert out.count() == rows.count() and out.filter("left_out <> fold or a is null or b is null or score is null").isEmpty()
    # The column of a fold is what a fit on the other folds gives.
    model = learners.get_learner("lr").fit(rows.filter("fold <> 1"), {"maxIter": 5})
    want = {r.row_id: r.score for r in learners.score(model, rows.filter("fold = 1")).collect()}
    got = {r.row_id: r.a for r in out.filter("fold = 1").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    alone = tune.auc_of(out.withColumn("score", F.col("b")))
    assert tune.auc_of(out) > alone - 0.02


def test_random_trees_split_at_random_thresholds(rows):
    train, test = rows.filter("fold <> 2"), rows.filter("fold = 2")
    one = stages.fit_random_trees(train, 3, {"numTrees": 5, "maxDepth": 5}, groups=2, splits=8, seed=1)
    two = stages.fit_random_trees(train, 3, {"numTrees": 5, "maxDepth": 5}, groups=2, splits=8, seed=2)
    again = stages.draw_thresholds([0.0], [1.0], 4, random.Random(7))
    assert again == stages.draw_thresholds([0.0], [1.0], 4, random.Random(7))
    assert one.thresholds != two.thresholds and one.thresholds[0] != one.thresholds[1]
    assert all(c == sorted(c) and 0 <= c[0] and c[-1] <= 1 for group in one.thresholds for c in group)
    assert tune.auc_of(one.score(test)) > 0.75
    # Values between two neighbouring thresholds cannot be told apart.
    steps = stages.discretise(test, one.thresholds[0]).select("__steps").distinct().count()
    assert steps <= 9**3


def test_halving_keeps_the_better_half_on_twice_the_rows(rows):
    log = tune.tune_halving(rows, learners.get_learner("lr"), trials=6, fixed={"maxIter": 3}).toPandas()
    sizes = log.groupby("round").agg(trials=("trial", "size"), kept=("survived", "sum"), rows=("rows", "max"))
    assert sizes.trials.tolist() == [6, 3, 2, 1] and sizes.kept.tolist() == [3, 2, 1, 1]
    assert all(1.6 < b / a < 2.5 for a, b in zip(sizes.rows, sizes.rows[1:]))
    for turn in range(3):
        now, then = log[log["round"] == turn], log[log["round"] == turn + 1]
        assert set(then.trial) == set(now[now.survived].trial)
        assert now[now.survived].loss.max() <= now[~now.survived].loss.min()
    small = {r.row_id for r in tune.nested_sample(rows, 0.1, 5).collect()}
    assert small < {r.row_id for r in tune.nested_sample(rows, 0.2, 5).collect()}


def test_positions_follow_the_files(spark, tmp_path):
    from clickfeat.sources.readers import with_file_positions

    path = str(tmp_path / "files")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    placed = with_file_positions(spark.read.parquet(path))
    assert placed.columns == ["id", "row_id"] and placed.filter("id <> row_id").isEmpty() and placed.count() == 1000
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Repartition" not in plan


def test_steps_do_not_grow_with_the_thresholds(rows):
    """Written-out comparisons became code too long to be compiled (F3, F5)."""
    size = len(rows.first()["features"])
    cuts = stages.draw_thresholds([-1.0] * size, [1.0] * size, 64, random.Random(1))
    out = stages.discretise(rows, cuts)
    plan = out.select("__steps")._jdf.queryExecution().analyzed().toString()
    assert plan.count("cast(") < 10
    for r in out.limit(50).collect():
        assert list(r["__steps"]) == [float(sum(v > c for c in own)) for v, own in zip(r["features"], cuts)]


def test_models_are_fitted_together_and_ranked_in_one_pass(rows):
    """One fit and one ranking after the other made hundreds of short jobs and read the rows once per model (F6, F7)."""
    wanted = [(learners.get_learner(name), {"maxIter": 3}) for name in ("lr", "gbm", "ridge")]
    models = tune.fit_all(rows, wanted)
    assert [type(m).__name__ for m in models] == ["LogisticRegressionModel", "GBTRegressionModel", "LinearRegressionModel"]
    alone = [tune.auc_of(learners.score(learner.fit(rows, params), rows)) for learner, params in wanted]
    assert tune.aucs_of(models, rows) == pytest.approx(alone, abs=1e-12)
    assert all(np.isnan(tune.aucs_of(models, rows.filter("label > 0"))))
    assert all(np.isnan(tune.aucs_of(models, rows.filter("label > 2"))))


def test_training_tables_hold_features_once(clicks):
    from clickfeat.registry.modelling import training_table

    assert training_table(clicks).columns == ["row_id", "fold", "weight", "label", "features"]
