"""Results must not depend on size, on the plan chosen for hot keys, or on nulls among the keys."""

import math
import random

import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from clickfeat.functions import encode
from clickfeat.learning import calibrate, learners, tune
from clickfeat.operators import describe, profiles, score, skew, split
from clickfeat.plans.build import add_features
from clickfeat.plans.specs import FeatureSpec
from clickfeat.sources.writers import cached_feature, input_files


def test_bin_edges_cover_the_range(spark):
    edges = encode.click_edges()
    assert len(edges) == 1020 and edges == sorted(set(edges)) and edges[-1] == 44_181_914
    assert edges[:264] == [6.0 + 18 * i for i in range(264)]
    down = encode.download_edges()
    assert len(down) == 235 and down == sorted(set(down)) and down[-1] == 101_817
    df = spark.createDataFrame([(5000,), (100_000,), (10**9,)], "x long")
    got = [r.b for r in encode.bin_edges(df, "x", edges, "b").orderBy("x").collect()]
    assert got == [sum(e < x for e in edges) for x in (5000, 100_000, 10**9)] and got[0] < got[1] < got[2] == 1020


def test_bin_edges_match_the_reference_lists(spark):
    """Bins counted by hand on the published lists."""
    clicks = [(6, 0), (4759, 264), (10_000, 526), (100_000, 954), (44_181_914, 1019), (44_181_915, 1020)]
    loads = [(0, 0), (1, 1), (50, 13), (192, 48), (193, 49), (100_000, 234), (101_817, 234), (101_818, 235)]
    for edges, known in ((encode.click_edges(), clicks), (encode.download_edges(), loads)):
        got = encode.bin_edges(spark.createDataFrame([(x,) for x, _ in known], "x long"), "x", edges, "b")
        assert [(r.x, r.b) for r in got.orderBy("x").collect()] == known


def test_combo_key_keeps_nulls_apart(spark):
    df = spark.createDataFrame([(1, None, 2), (1, 2, None), (1, 2, 3)], "a int, b int, c int")
    assert [r.k for r in df.select(encode.combo_key("a", "b", "c").alias("k")).collect()] == [None, None, "1_2_3"]


@pytest.mark.parametrize("batches", [3, 5, 20_000])
def test_running_score_of_many_batches(spark, batches):
    values = [(i, ((i * 7919) % 101) / 101) for i in range(batches)]
    want, m = [], None
    for _, v in values:
        m = v if m is None else 0.2 * (4 * m + v)
        want.append(m)
    got = score.running_score(spark.createDataFrame(values, "b long, auc double").repartition(3), "b")
    assert [r.running for r in got.orderBy("b").collect()] == pytest.approx(want, rel=1e-12)


def test_auc_with_nan_and_null_groups(spark):
    rows = [(g, s, y) for g in ("a", None) for s, y in ((0.1, 0), (0.4, 1), (0.3, 0), (0.9, 1), (math.nan, 1), (None, 0))]
    df = spark.createDataFrame(rows, "g string, s double, is_attributed int")
    got = {r.g: (r.auc, r.positives, r.negatives) for r in score.auc_exact(df, "s", by=["g"]).collect()}
    assert got == {"a": (1.0, 2, 2), None: (1.0, 2, 2)}


def test_stratified_folds_keep_null_labels(spark):
    rows = [(i, None if i % 10 == 0 else i % 2) for i in range(100)]
    got = split.folds_stratified(spark.createDataFrame(rows, "row_id long, is_attributed int"), 5)
    assert got.count() == 100 and got.filter("is_attributed is null").count() == 10


def test_running_totals_cut_even_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(20_000).selectExpr("cast(id as double) as x", "1L as n")
        got = skew.running_totals(df, "x", ["n"])
        assert got.filter("n_before <> x").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_moments_do_not_depend_on_the_plan(spark):
    n = 1000
    frame = pd.DataFrame(
        {
            "row_id": range(n),
            "ip": [1] * n,
            "app": [i % 2 for i in range(n)],
            "device": 1,
            "os": 1,
            "channel": 1,
            "click_time": pd.Timestamp("2020-03-01") + pd.to_timedelta(range(n), unit="s"),
            "epoch": [1_500_000_000 + i for i in range(n)],
            "is_attributed": 0,
        }
    )
    clicks = spark.createDataFrame(frame)
    specs = [FeatureSpec("v", "var", ("ip",), "epoch"), FeatureSpec("k", "skew", ("ip",), "epoch"), FeatureSpec("m", "mean", ("app",), "epoch"), FeatureSpec("va", "var", ("app",), "epoch")]
    for limit in (10, 10**9):
        got = add_features(clicks, specs, limit=limit).filter("row_id = 0").first()
        assert got.v == pytest.approx(frame.epoch.var(), rel=1e-9)
        assert got.k == pytest.approx(0.0, abs=1e-9)
        even = frame[frame.app == 0].epoch
        assert got.m == pytest.approx(even.mean(), rel=1e-12) and got.va == pytest.approx(even.var(), rel=1e-9)


@pytest.mark.parametrize("most", ["500000", "0"])
def test_variance_of_a_narrow_group_far_from_the_others(spark, most):
    """The groups lie 10^6 and more deviations apart; sums around one origin for all would lose the narrow one."""
    n, near = 600, 1_000_000.0
    values = [5e8 + near * i if i % 3 else 0.5 * (i % 7) for i in range(n)]
    app = [int(bool(i % 3)) for i in range(n)]
    frame = pd.DataFrame(
        {"row_id": range(n), "ip": 1, "app": app, "device": 1, "os": 1, "channel": range(n), "is_attributed": 0, "x": values}
    ).assign(click_time=pd.Timestamp("2020-03-01"))
    specs = [FeatureSpec("v", "var", ("app",), "x"), FeatureSpec("k", "skew", ("app",), "x"), FeatureSpec("m", "mean", ("app",), "x")]
    before = spark.conf.get("spark.clickfeat.broadcastRows", None)
    spark.conf.set("spark.clickfeat.broadcastRows", most)
    try:
        got = {r.app: r for r in add_features(spark.createDataFrame(frame), specs, limit=50).select("app", "v", "k", "m").distinct().collect()}
    finally:
        spark.conf.unset("spark.clickfeat.broadcastRows") if before is None else spark.conf.set("spark.clickfeat.broadcastRows", before)
    for key, own in frame.groupby("app").x:
        assert (got[key].v, got[key].k) == pytest.approx((own.var(), own.skew()), rel=1e-9, abs=1e-9)
        assert got[key].m == pytest.approx(own.mean(), rel=1e-9, abs=1e-6)


def described(df, cols):
    return {r["column"]: r for r in describe.describe_full(df, cols).collect()}


def test_describe_full_of_ties_and_odd_columns(spark):
    rng = random.Random(3)
    n = 30_000
    frame = pd.DataFrame(
        {
            "even": [rng.random() for _ in range(n)],
            "tied": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(n)],
            "sparse": [rng.gauss(0, 1) if rng.random() < 0.01 else None for _ in range(n)],
            "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(n)],
            "one": [7.0 if i == 5 else None for i in range(n)],
            "none": [None] * n,
        }
    ).astype("float64")
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame))
    got = described(df, list(frame))
    assert set(got) == set(frame) - {"none"}
    for c, row in got.items():
        own = frame[c].dropna()
        assert (row["count"], row["min"], row["max"]) == (len(own), own.min(), own.max())
        assert [row["p25"], row["p50"], row["p75"]] == pytest.approx(list(own.quantile([0.25, 0.5, 0.75])), rel=1e-12)
    assert described(df.limit(0), ["even"]) == {}


def test_describe_full_with_sketches_that_miss(spark, monkeypatch):
    """Brackets aimed at the wrong place are found out by their counts."""
    monkeypatch.setattr(describe, "BRACKET", -0.2)
    values = [float((i * 7919) % 4001) for i in range(4001)]
    row = described(spark.createDataFrame([(v,) for v in values], "x double"), ["x"])["x"]
    assert (row.p25, row.p50, row.p75) == (1000.0, 2000.0, 3000.0)


def test_describe_full_keeps_few_rows(spark, monkeypatch):
    """No row is multiplied: what is generated is a small part of the rows, whatever the ties."""
    seen = []
    plain = describe.running_totals
    monkeypatch.setattr(describe, "running_totals", lambda df, *a: (seen.append(df.agg(F.sum("n")).first()[0]), plain(df, *a))[1])
    df = spark.range(200_000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 4).alias("c"), F.floor(F.rand(3) * 50).alias("d"))
    described(df, ["a", "b", "c", "d"])
    assert sum(seen) < 0.02 * 200_000


def test_isotonic_keeps_tiny_scores_apart(spark):
    rows = [(i * 1e-10, float(i >= 500)) for i in range(1000)]
    df = spark.createDataFrame(rows, "s double, y double")
    model = calibrate.fit_isotonic(df, "s", "y")
    got = calibrate.apply_isotonic(model, df, "s", "p").collect()
    assert {(r.y, r.p) for r in got} == {(0.0, 0.0), (1.0, 1.0)}


def test_draws_cover_a_small_space():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    drawn = tune.draw_params(space, 99, seed=5)
    assert len(drawn) == 6 and len({tuple(sorted(d.items())) for d in drawn}) == 6
    assert tune.draw_params(space, 4, seed=5) == tune.draw_params(space, 4, seed=5)


def test_selection_searches_and_passes(spark):
    """``late`` helps only once ``first`` is in, so it may need a second pass."""

    def loss(columns):
        return 1.0 - 0.2 * ("first" in columns) - 0.3 * ({"first", "late"} <= set(columns))

    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_id long, is_attributed int")
    for seed in range(4):
        out = tune.select_features(df, learners.get_learner("lr"), [], ["late", "first", "none"], sample=None, seed=seed, passes=3, loss_of=loss).collect()
        assert {r.feature for r in out if r.kept} == {"first", "late"}


def test_cached_feature_follows_its_input(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    calls = []

    def compute(df):
        calls.append(1)
        return df.selectExpr("id * 2 as x")

    def run():
        return cached_feature(spark.read.parquet(source), cache, "f", {"a": 1}, "v1", compute).count()

    spark.range(5).write.parquet(source)
    assert run() == 5 and run() == 5 and len(calls) == 1
    spark.range(3).write.mode("append").parquet(source)
    assert run() == 8 and len(calls) == 2
    assert len(input_files(spark.read.parquet(f"{DATA}/events.parquet"))) == 1


def test_profiles_roll_up_from_the_smallest_wider_set(spark):
    sets = [frozenset("a"), frozenset("ab"), frozenset("ac"), frozenset("abc"), frozenset("d")]
    finest = frozenset("abcd")
    sizes = dict(zip([*sets, finest], [3, 50, 9, 90, 4, float("inf")]))
    parents = profiles.rollup_parents(sets, finest, sizes)
    assert parents == {sets[0]: sets[2], sets[1]: sets[3], sets[2]: sets[3], sets[3]: finest, sets[4]: finest}


def test_profiles_do_not_multiply_the_finest_rows(spark, clicks):
    plan = profiles.profile_counts(clicks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan


def test_lookup_broadcasts_share_one_budget(spark, clicks):
    sizes, widths = {"a": 10, "b": 1000, "c": 100, "d": 5}, dict.fromkeys("abcd", 100)
    assert profiles.sets_to_broadcast(sizes, widths, 500, 20_000) == set("acd")
    assert profiles.sets_to_broadcast(sizes, widths, 5000, 12_000) == set("acd")
    assert profiles.sets_to_broadcast(sizes, widths, 5000, 1_600) == set("ad")
    profile = profiles.profiles(clicks, [("app",), ("ip",), ("ip", "app")])
    options = {"key_sets": [("app",), ("ip",), ("ip", "app")]}
    rows = profiles.lookup(clicks, profile, {"clk": "c"}, **options)
    want = sorted(map(tuple, rows.select("row_id", "c1", "c2", "c3").collect()))
    spark.conf.set(profiles.BROADCAST_BYTES_CONF, "2000")
    try:
        low = profiles.lookup(clicks, profile, {"clk": "c"}, **options)
        assert sorted(map(tuple, low.select("row_id", "c1", "c2", "c3").collect())) == want
    finally:
        spark.conf.unset(profiles.BROADCAST_BYTES_CONF)
