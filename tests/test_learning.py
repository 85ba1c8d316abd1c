"""Learners, search, calibration and the stream."""

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from clickfeat.learning import calibrate, learners, tune
from clickfeat.operators.split import folds_contiguous
from clickfeat.registry.modelling import NUMBERS, hashed_table, training_table
from clickfeat.sources.readers import clicks_from_events, read_clicks
from clickfeat.streaming.profiles import latest_profiles, stream_profiles


@pytest.fixture(scope="module")
def table(spark):
    return training_table(read_clicks(spark, DATA)).cache()


@pytest.fixture(scope="module")
def separable(spark):
    frame = pd.DataFrame({"row_id": range(240), "x": [i % 24 / 24 for i in range(240)], "noise": [(i * 37) % 11 for i in range(240)]})
    frame["is_attributed"] = (frame.x > 0.6).astype(int)
    return spark.createDataFrame(frame)


def test_unknown_learner():
    with pytest.raises(KeyError):
        learners.get_learner("nope")


def test_int_params():
    assert learners.int_params({"maxDepth": 3.0, "stepSize": 0.5}) == {"maxDepth": 3, "stepSize": 0.5}


@pytest.mark.parametrize("name", ["gbt", "lr", "ridge", "linear_sv", "rf"])
def test_learners_find_a_separable_rule(separable, name):
    data = learners.assemble(separable, ["x", "noise"])
    params = {"numTrees": 5} if name == "rf" else {"maxIter": 10}
    scored = learners.score(learners.get_learner(name).fit(data, params), data)
    assert tune.auc_of(scored) > 0.97


def test_weights_reach_the_learner(separable):
    data = learners.assemble(separable, ["noise"])
    flat = learners.get_learner("lr").fit(data, {"maxIter": 20})
    heavy = learners.get_learner("lr").fit(
        data.withColumn("weight", learners.balance_weight("label", 50.0)), {"maxIter": 20}
    )
    assert heavy.intercept > flat.intercept + 1


def test_cross_validation_scores_every_row_once(separable):
    data = folds_contiguous(learners.assemble(separable, ["x"]), 3)
    oof, per_fold, test = tune.cross_validate(
        data, learners.get_learner("lr"), {"maxIter": 5}, k=3, test=data.filter("fold = 0")
    )
    assert oof.count() == oof.select("row_id").distinct().count() == 240
    assert {r.fold for r in per_fold.collect()} == {0, 1, 2}
    assert test.count() == 80 and test.filter("score < 0 or score > 1").count() == 0


def test_search_is_seeded_and_sorted(separable):
    data = learners.assemble(separable, ["x", "noise"])
    runs = [
        tune.tune(data, learners.get_learner("lr"), trials=3, sample=None, fixed={"maxIter": 3}).collect()
        for _ in range(2)
    ]
    assert runs[0] == runs[1] and len(runs[0]) == 3
    losses = [r.loss for r in runs[0]]
    assert losses == sorted(losses)
    assert len(tune.draw_params({"a": [1, 2]}, 5)) == 2


def test_feature_selection_rule(separable):
    gain = {"x": 0.3, "noise": 0.0}
    out = tune.select_features(
        separable, learners.get_learner("lr"), ["is_attributed"], ["x", "noise"],
        sample=None, seed=2, loss_of=lambda cols: 0.5 - sum(gain.get(c, 0) for c in cols),
    ).collect()
    assert {r.feature for r in out} == {"x", "noise"}
    assert [r.feature for r in out if r.kept] == ["x"]
    assert len(out) == 2


def test_importance_names_every_feature(spark, table):
    model = learners.get_learner("gbt").fit(table, {"maxIter": 2, "maxDepth": 2})
    out = learners.importance(model, NUMBERS, spark).collect()
    assert {r.feature for r in out} == set(NUMBERS)
    assert sum(r.importance for r in out) == pytest.approx(1.0)


def test_random_ridge_averages_members(table):
    fits = learners.random_ridge(table, len(NUMBERS), {"n_estimators": 3, "max_features": 0.5})
    assert len({tuple(s.getIndices()) for _, s in fits}) > 1
    scored = learners.score_ridges(fits, table)
    assert scored.columns[-1] == "score" and scored.count() == 1000


def test_resampling_keeps_the_weight(spark):
    df = spark.range(20000).select(F.col("id").alias("row_id"), F.lit(0.2).alias("w"))
    kept = learners.resample_by_weight(df, "w")
    assert abs(kept.count() / 20000 - 0.2) < 0.02
    assert kept.exceptAll(learners.resample_by_weight(df.repartition(5), "w")).count() == 0


def pool_violators(x, y):
    blocks = []
    for v in y[np.argsort(x, kind="stable")]:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.concatenate([[v] * n for v, n in blocks])


def test_isotonic(spark):
    rng = np.random.default_rng(1)
    x = np.arange(60) / 60
    y = (rng.random(60) < x).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"p": np.repeat(x, 2), "y": np.repeat(y, 2)}))
    model = calibrate.fit_isotonic(df, "p", "y")
    got = calibrate.apply_isotonic(model, df, "p", "c").select("p", "c").distinct().orderBy("p").toPandas().c
    np.testing.assert_allclose(got, pool_violators(x, y), atol=1e-9)


def isotonic_values(x, y):
    return dict(zip(x.tolist(), pool_violators(x, y).tolist()))


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "late low block", "ties"])
def test_isotonic_over_many_ranges(spark, shape):
    """Ranges of 16 blocks: violations reach across many borders, or none does."""
    rng = np.random.default_rng(5)
    n = 3000
    x = np.arange(n) / n
    y = {
        "noise": (rng.random(n) < x).astype(float),
        "falling": -x,
        "rising": x,
        "late low block": np.where(x < 0.9, x, -5.0),
        "ties": np.floor(rng.random(n) * 3),
    }[shape]
    df = spark.createDataFrame(pd.DataFrame({"p": x, "y": y}))
    fit = calibrate.fit_isotonic(df, "p", "y", range_blocks=16)
    blocks = fit.blocks.orderBy("lo").toPandas()
    assert blocks.n.sum() == n and (np.diff(blocks.fit) > 0).all() and (blocks.lo[1:].to_numpy() > blocks.hi[:-1].to_numpy()).all()
    got = calibrate.apply_isotonic(fit, df, "p", "c").toPandas()
    want = isotonic_values(x, y)
    np.testing.assert_allclose(got.c, [want[v] for v in got.p], atol=1e-9)


def test_isotonic_of_a_million_scores(spark):
    df = spark.range(1_000_000).select((F.col("id") / 1e6).alias("p"), (F.crc32(F.col("id").cast("string").cast("binary")) % 1000 < F.col("id") / 1000).cast("int").alias("y"))
    fit = calibrate.fit_isotonic(df, "p", "y", range_blocks=20_000)
    assert fit.levels > 1
    frame = df.toPandas()
    want = pool_violators(frame.p.to_numpy(), frame.y.to_numpy().astype(float))
    got = calibrate.apply_isotonic(fit, df, "p", "c").orderBy("p").toPandas()
    np.testing.assert_allclose(got.c, want, atol=1e-9)


def test_isotonic_between_and_beyond_scores(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (None, 1.0), (float("nan"), 1.0), (2.0, None)], "p double, y double")
    fit = calibrate.fit_isotonic(df, "p", "y")
    asked = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 1.0, 1.25, 2.0, 3.0, None, float("nan")] * 30)], "i long, p double")
    for outside, ends in (("clip", (0.0, 1.0)), ("zero", (0.0, 0.0))):
        got = calibrate.apply_isotonic(fit, asked, "p", "c", outside=outside).orderBy("i").toPandas()
        assert got.c.tolist() == [ends[0], 0.0, 0.25, 1.0, ends[1], 0.0, 0.0] * 30
    empty = calibrate.fit_isotonic(df.limit(0), "p", "y")
    assert calibrate.apply_isotonic(empty, asked, "p", "c").filter("c <> 0").isEmpty()
    assert calibrate.apply_isotonic(fit, asked.limit(0), "p", "c").isEmpty()


def test_stream_over_several_batches(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(5).write.parquet(folder)
    stream_profiles(
        spark, folder, clicks_from_events, ["ip"], out, str(tmp_path / "cp"), files_per_batch=2
    )
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 3
    got = {r.ip: (r.clk, r.down) for r in latest_profiles(spark, out, ["ip"]).collect()}
    want = clicks_from_events(events).groupBy("ip").agg(F.count("*").alias("n"), F.sum("is_attributed").alias("d"))
    assert got == {r.ip: (r.n, r.d) for r in want.collect()}
    # A restart finds nothing new and leaves the result as it is.
    stream_profiles(spark, folder, clicks_from_events, ["ip"], out, str(tmp_path / "cp"))
    assert got == {r.ip: (r.clk, r.down) for r in latest_profiles(spark, out, ["ip"]).collect()}


def test_hashed_rows_are_dealt_before_the_fit(spark):
    """A scan of one row group was one task for the fit and the scores (F4)."""
    table = hashed_table(read_clicks(spark, DATA))
    files = table.inputFiles()
    assert files and all("hashed-" in f for f in files)
    assert table.count() == read_clicks(spark, DATA).count()


def test_learner_registry_fits_whole_learners(clicks, monkeypatch):
    """No learner has fewer iterations or trees, or smaller ones, than it has by itself."""
    from clickfeat.registry import modelling

    wanted = []
    monkeypatch.setattr(modelling.tune, "fit_all", lambda table, fits: wanted.extend(fits) or fits)
    monkeypatch.setattr(modelling.tune, "aucs_of", lambda models, table: [0.5] * len(models))
    assert modelling.learner_registry(clicks).count() == len(wanted) == len(learners.REGISTRY)
    for learner, params in wanted:
        estimator = learner.create(params)
        for size in ("maxIter", "numTrees", "maxDepth"):
            if estimator.hasParam(size):
                assert estimator.getOrDefault(size) >= type(estimator)().getOrDefault(size)
