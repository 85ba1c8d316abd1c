"""The paths taken for hot keys give what the plain paths and brute force give."""

import numpy as np
import pandas as pd
import pandas.testing as pt
import pytest
from conftest import skewed_frame
from pyspark.sql import functions as F

from clickfeat.operators import match, profiles, score, sequence, split
from clickfeat.operators.skew import (
    attach_by_key,
    hash_position,
    is_skewed,
    largest_group,
    row_index,
    running_totals,
)
from clickfeat.plans.build import add_features, sort_chains
from clickfeat.plans.specs import CATALOGUE, NUMBERED_FEATURES, FeatureSpec, pick


def in_order(df):
    return df.toPandas().sort_values("row_id", ignore_index=True)


def test_hot_key_is_seen(small_slices, skewed):
    frame = skewed_frame()
    assert largest_group(skewed, ["ip"]) == frame.groupby("ip").size().max()
    assert is_skewed(skewed, ["ip"])


def test_attach_by_key(small_slices, skewed):
    frame = skewed_frame()
    dim = skewed.groupBy("ip").agg(F.count("*").alias("n"), F.max("channel").alias("top"))
    want = frame.groupby("ip").channel.transform("max")
    for counts in (None, "n", dim.select("ip", F.col("n").alias("__n"))):
        got = in_order(attach_by_key(skewed, dim, ["ip"], counts))
        assert len(got) == len(frame)
        assert (got.top == want).all()


def test_hot_salts_spread_rows(small_slices, skewed):
    """The join of a hot key runs in several partitions."""
    dim = skewed.groupBy("ip").agg(F.count("*").alias("n"))
    small_slices.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    small_slices.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = attach_by_key(skewed, dim.withColumn("m", F.col("n")), ["ip"], "n")
        parts = joined.filter("ip = 0").select(F.spark_partition_id()).distinct().count()
    finally:
        small_slices.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        small_slices.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


@pytest.mark.parametrize("keys", [["ip"], ["ip", "app"], ["device"], ["device", "hour"]])
def test_sequences(small_slices, skewed, keys):
    frame = skewed_frame()
    seconds = frame.click_time.astype("int64") // 10**9
    if frame.click_time.dtype != "datetime64[ns]":
        seconds = frame.click_time.astype("datetime64[ns]").astype("int64") // 10**9
    grouped = seconds.groupby([frame[k] for k in keys])
    got = in_order(
        sequence.add_sequence(
            skewed, keys, next_name="n", prev_name="p", next_epoch_name="e", cumcount_name="c"
        )
    )
    ahead, behind = grouped.shift(-1) - seconds, seconds - grouped.shift(1)
    np.testing.assert_array_equal(got.n.astype(float), ahead % 86400)
    np.testing.assert_array_equal(got.p.astype(float), behind % 86400)
    np.testing.assert_array_equal(got.e.astype(float), ahead.where(ahead.notna(), 3_000_000_000 - seconds))
    np.testing.assert_array_equal(got.c, grouped.cumcount())


def test_sequence_identities(small_slices, skewed):
    got = in_order(sequence.add_sequence(skewed, ["ip"], next_name="n", prev_name="p", cumcount_name="c"))
    last = got.groupby("ip").c.transform("max")
    assert (last == got.groupby("ip").c.transform("size") - 1).all()
    nxt = got.groupby("ip").p.shift(-1)
    np.testing.assert_array_equal(got.n.astype(float), nxt.astype(float))


def test_shift_rows_keeps_nulls(small_slices, skewed):
    df = skewed.withColumn("maybe", F.when(F.col("row_id") % 5 != 0, F.col("channel")))
    got = in_order(sequence.shift_rows(df, ["maybe", "ip"]))
    np.testing.assert_array_equal(got.maybe_shift.astype(float), got.maybe.shift(1).astype(float))
    np.testing.assert_array_equal(got.ip_shift.astype(float), got.ip.shift(1).astype(float))


SPECS = (
    pick(
        "ip_c_os", "ip_cu_c", "ip_app_cu_os", "app_cu_chl", "ip_app_co", "app_chl_co", "ip_d_os_h_co",
        "ip_app_chl_var_h", "app_os_var_da", "ip_app_mean_h", "app_chl_mean_h",
        "ip_channel_prevClick", "ip_os_device_nextClick", "device_nextClick",
    )
    + [FeatureSpec("ip_skew_h", "skew", ("ip",), "hour"), FeatureSpec("app_skew_h", "skew", ("app",), "hour")]
    + [FeatureSpec("ip_seen", "count_nonnull", ("ip",), "maybe"), FeatureSpec("ip_cu_m", "nunique", ("ip",), "maybe")]
)


def brute(frame, spec):
    keys = [frame[k] for k in spec.keys]
    if spec.kind == "count":
        return frame.groupby(list(spec.keys)).row_id.transform("size")
    if spec.kind == "cumcount":
        return frame.groupby(list(spec.keys)).cumcount()
    if spec.kind in ("next", "prev"):
        seconds = (frame.click_time - pd.Timestamp("1970-01-01")).dt.total_seconds()
        shifted = seconds.groupby(keys).shift(-1 if spec.kind == "next" else 1)
        return (shifted - seconds if spec.kind == "next" else seconds - shifted) % 86400
    how = {"count_nonnull": "count", "nunique": "nunique", "mean": "mean", "var": "var", "skew": "skew"}[spec.kind]
    return frame[spec.value].groupby(keys).transform(how)


def test_feature_plan_against_pandas(spark, skewed):
    df = skewed.withColumn("maybe", F.when(F.col("row_id") % 5 != 0, F.col("channel")))
    frame = in_order(df)
    plain = in_order(add_features(df, SPECS))
    for spec in SPECS:
        np.testing.assert_allclose(
            plain[spec.name].astype(float), brute(frame, spec).astype(float), rtol=1e-9, atol=1e-9, err_msg=spec.name
        )


def test_feature_plan_hot_equals_plain(small_slices, skewed):
    df = skewed.withColumn("maybe", F.when(F.col("row_id") % 5 != 0, F.col("channel")))
    plain = in_order(add_features(df, SPECS, limit=10**9))
    hot = in_order(add_features(df, SPECS))
    pt.assert_frame_equal(plain, hot, check_dtype=False)


def test_one_shuffle_for_all_anchored_features(spark, clicks):
    specs = [s for s in CATALOGUE if "ip" in s.keys]
    plan = add_features(clicks, specs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("+- Sort ") <= 14


def test_sort_chains_nest():
    chains = sort_chains([(frozenset("a"), ("r",)), (frozenset("ab"), ()), (frozenset("abc"), ()), (frozenset("a"), ())])
    assert [len(members) for _, members in chains] == [3, 1]
    assert chains[0][0] == ["a", "b", "c"]


def test_feature_names_must_be_free(clicks):
    with pytest.raises(ValueError):
        add_features(clicks, [*NUMBERED_FEATURES, NUMBERED_FEATURES[0]])


def test_row_index(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 13).alias("k"), "id")
    got = row_index(df, ["k", F.desc("id")]).toPandas().sort_values("row_id", ignore_index=True)
    want = df.toPandas().sort_values(["k", "id"], ascending=[True, False], ignore_index=True)
    assert got.row_id.tolist() == list(range(1000))
    assert got.id.tolist() == want.id.tolist()


def test_running_totals_by_group(spark):
    frame = pd.DataFrame({"g": [i % 3 for i in range(200)], "x": [float(i * 31 % 200) for i in range(200)], "c": range(200)})
    got = running_totals(spark.createDataFrame(frame), "x", ["c"], ["g"]).toPandas()
    want = frame.sort_values("x").groupby("g").c.transform(lambda s: s.cumsum() - s)
    merged = got.merge(frame.assign(want=want), on=["g", "x"])
    assert (merged.c_before == merged.want).all() and len(merged) == 200


def test_hash_position_is_a_permutation(spark, skewed):
    got = hash_position(skewed, 3, by=["is_attributed"]).toPandas()
    for _, group in got.groupby("is_attributed"):
        assert sorted(group.pos) == list(range(len(group)))
    again = hash_position(skewed.repartition(7), 3, by=["is_attributed"]).toPandas()
    assert got.set_index("row_id").pos.sort_index().equals(again.set_index("row_id").pos.sort_index())
    other = hash_position(skewed, 4, by=["is_attributed"]).toPandas()
    assert not got.set_index("row_id").pos.sort_index().equals(other.set_index("row_id").pos.sort_index())


def test_samples_and_splits(spark, skewed):
    n = skewed.count()
    chosen = split.sample_exact(skewed, 0.37, seed=5)
    ids = {r.row_id for r in chosen.collect()}
    assert len(ids) == int(n * 0.37) == chosen.count()
    order = hash_position(skewed, 5).toPandas().sort_values("pos")
    assert ids == set(order.row_id[: len(ids)])
    halves = split.split_random(skewed, rows=33, seed=1).toPandas()
    assert len(halves) == n and (halves.split == "valid").sum() == 33 and halves.row_id.is_unique
    nfold = split.split_nfold(skewed, 2, 4).toPandas()
    assert 0 < (nfold.split == "test").sum() < n
    strat = split.folds_stratified(skewed, 3).toPandas().groupby(["is_attributed", "fold"]).size().unstack()
    assert (strat.max(axis=1) - strat.min(axis=1)).max() <= 1
    batches = split.shuffle_batches(skewed, 64).toPandas().groupby("batch_id").size()
    assert batches.tolist() == [64] * (n // 64) + [n % 64]


def test_matching_under_skew(small_slices, skewed):
    both = skewed.withColumn("click_id", F.col("row_id") + 1000)
    test = both.filter("hour % 2 = 0")
    supplement = both.withColumn("click_id", F.col("row_id") + 5000)
    frame = skewed_frame()
    even = frame[frame.hour % 2 == 0]
    got = match.match_pairwise(test, supplement, ["ip"]).toPandas()
    i = even.assign(i=even.groupby("ip").cumcount())
    j = frame.assign(i=frame.groupby("ip").cumcount())
    want = i.merge(j, on=["ip", "i"])
    assert sorted(zip(got.test_id, got.supplement_id)) == sorted(
        zip(want.row_id_x + 1000, want.row_id_y + 5000)
    )
    got = match.match_consume(test, supplement, ["ip"]).toPandas()
    first = frame.groupby("ip").row_id.min()
    assert sorted(zip(got.test_id, got.supplement_id)) == sorted(
        zip(even.row_id + 1000, even.ip.map(first) + 5000)
    )


def test_lookup_under_skew(small_slices, skewed):
    profile = profiles.profiles(skewed.filter("hour < 9"), [("ip",), ("ip", "app")])
    mean = profiles.fallback(profile)
    sets = [("ip",), ("ip", "app")]
    hot = in_order(profiles.lookup(skewed, profile, {"clk": "c", "rate": "r"}, mean, key_sets=sets))
    small_slices.conf.set("spark.clickfeat.broadcastRows", "100000")
    plain = in_order(profiles.lookup(skewed, profile, {"clk": "c", "rate": "r"}, mean, key_sets=sets))
    pt.assert_frame_equal(hot, plain)


def test_profile_counts_add_up(clicks):
    out = profiles.profile_counts(clicks).toPandas()
    sums = out.groupby("key_set")[["clk", "down"]].sum()
    assert len(sums) == 24 and (sums.clk == 1000).all() and sums.down.nunique() == 1
    assert (out[profiles.HOUR_BUCKETS].sum(axis=1) == out.clk).all()
    assert (out[profiles.QUARTER_BUCKETS].sum(axis=1) == out.clk).all()


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"p": rng.integers(0, 60, 500) / 60, "y": rng.integers(0, 2, 500), "g": rng.integers(0, 3, 500)})
    got = {r.g: r.auc for r in score.auc_exact(spark.createDataFrame(frame), "p", "y", ["g"]).collect()}
    for g, part in frame.groupby("g"):
        pos, neg = part.p[part.y == 1].to_numpy(), part.p[part.y == 0].to_numpy()
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert got[g] == pytest.approx(wins / (len(pos) * len(neg)))


def test_gaps_without_the_anchor_share_one_exchange(small_slices, skewed):
    """Ranges of 16 rows, broadcasts of 10: every set equals its own window, and the clicks are exchanged once."""
    sets = [("device",), ("device", "channel"), ("app", "device", "channel"), ("app", "hour")]
    wanted = [(keys, {"next_name": f"n{i}", "prev_name": f"p{i}", "cumcount_name": f"c{i}"}) for i, keys in enumerate(sets)]
    names = [f"{p}{i}" for i in range(len(sets)) for p in "npc"]
    got = sequence.add_sliced_sequences(skewed, wanted)
    plain = skewed
    for keys, columns in wanted:
        plain = sequence.add_sequence(plain, keys, **columns, skewed=False)
    assert sorted(map(tuple, got.select("row_id", *names).collect())) == sorted(map(tuple, plain.select("row_id", *names).collect()))
    small_slices.conf.set("spark.clickfeat.broadcastRows", "100000")
    out = sequence.add_sliced_sequences(skewed, wanted)
    small_slices.conf.set("spark.clickfeat.broadcastRows", "10")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tasks_of_wide_features_follow_the_rows(spark, skewed):
    """Adaptive execution must not merge the narrow input of the sorts into as few tasks as there are cores (F1, F2)."""
    specs = pick("ip_cu_c", "ip_app_chl_var_h", "ip_os_prevClick", "device_nextClick", "app_chl_co")
    names = ["row_id", *[s.name for s in specs]]
    # Nulls and equal values go through both plans alike.
    plain = sorted(map(str, add_features(skewed, specs).select(*names).collect()))
    spark.conf.set("spark.clickfeat.taskRows", "20")
    try:
        out = add_features(skewed, specs).select(*names)
        assert out.rdd.getNumPartitions() == 20
        assert sorted(map(str, out.collect())) == plain
    finally:
        spark.conf.unset("spark.clickfeat.taskRows")
