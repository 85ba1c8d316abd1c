"""Small hand-made cases: ties, single rows, wraps, misses, zeros."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from clickfeat.functions import blend, encode
from clickfeat.operators import aggregate, match, profiles, score, sequence, split
from clickfeat.operators.describe import describe_full

T0 = datetime.datetime(2020, 1, 1)


def log(spark, rows):
    """rows of (row_id, ip, seconds after T0)"""
    data = [(r, ip, T0 + datetime.timedelta(seconds=s)) for r, ip, s in rows]
    return spark.createDataFrame(data, "row_id long, ip long, click_time timestamp")


def test_single_row_group(spark):
    df = log(spark, [(0, 1, 0)]).withColumn("hour", F.lit(3))
    df = aggregate.add_measures(
        df, ["ip"], {"n": ("count", None), "u": ("nunique", "hour"), "v": ("var", "hour"), "s": ("skew", "hour")}
    )
    df = sequence.add_sequence(df, ["ip"], next_name="next", prev_name="prev", cumcount_name="cc")
    row = df.first()
    assert (row.n, row.u, row.v, row.s, row.cc, row.next, row.prev) == (1, 1, None, None, 0, None, None)


def test_time_tie(spark):
    df = sequence.add_sequence(log(spark, [(1, 7, 5), (2, 7, 5)]), ["ip"], next_name="n", cumcount_name="c")
    assert [(r.n, r.c) for r in df.orderBy("row_id").collect()] == [(0, 0), (None, 1)]


def test_day_wrap(spark):
    df = log(spark, [(0, 1, 0), (1, 1, 2 * 86400 + 3)])
    assert sequence.next_click(df, ["ip"], "n").orderBy("row_id").first().n == 3
    assert sequence.next_click(df, ["ip"], "n", wrap_day=False).orderBy("row_id").first().n == 172803


def test_wrapping_distinct_count(spark):
    df = spark.range(300).select(F.lit(1).alias("ip"), "id", F.col("id").alias("row_id"))
    row = aggregate.add_countuniq(df, ["ip"], "id", "u").select("u", encode.narrow_wrap("u", 8).alias("w")).first()
    assert (row.u, row.w) == (300, 44)


def _profile(spark, clk):
    rows = [("app", "1", 1, clk, 1, 0.25, 0.5, 0.1)]
    return spark.createDataFrame(
        rows, "key_set string, key string, app int, clk double, down long, rate double, entropy_6 double, entropy_4 double"
    )


def test_profile_miss_and_low_support(spark):
    mean = spark.createDataFrame([("app", 9.0, 0.75)], "key_set string, clk double, rate double")
    df = spark.createDataFrame([(0, 1), (1, 2)], "row_id long, app int")

    def look(clk, mean=None, **options):
        out = profiles.lookup(df, _profile(spark, clk), {"rate": "r"}, mean, key_sets=[("app",)], **options)
        return [r.r1 for r in out.orderBy("row_id").collect()]

    assert look(10.0, mean) == [0.25, 0.75]
    assert look(10.0) == [0.25, None]
    assert look(4.0, mean, min_clicks=5) == [0.75, 0.75]


def test_entropy(spark):
    counts = [F.lit(c) for c in (1, 1, 0, 0, 0, 0)]
    row = spark.range(1).select(
        encode.entropy(counts, F.lit(2)).alias("full"), encode.entropy(counts, F.lit(2), legacy=True).alias("last")
    ).first()
    assert math.isclose(row.full, math.log(2))
    assert math.isclose(row.last, 0.5 * math.log(2))


def test_id_matching_with_duplicates(spark):
    test = spark.createDataFrame([(i, 100 + i, "a") for i in range(3)], "row_id long, click_id long, sig string")
    supplement = spark.createDataFrame([(i, 200 + i, "a") for i in range(2)], "row_id long, click_id long, sig string")
    consumed = match.match_consume(test, supplement, ["sig"]).collect()
    assert sorted((r.supplement_id, r.test_id) for r in consumed) == [(200, 100), (200, 101), (200, 102)]
    paired = match.match_pairwise(test, supplement, ["sig"]).collect()
    assert sorted((r.supplement_id, r.test_id) for r in paired) == [(200, 100), (201, 101)]


def test_contiguous_folds(spark):
    df = split.folds_contiguous(spark.range(11).withColumnRenamed("id", "row_id"), 5)
    assert [r["count"] for r in df.groupBy("fold").count().orderBy("fold").collect()] == [3, 2, 2, 2, 2]
    few = split.folds_contiguous(spark.range(3).withColumnRenamed("id", "row_id"), 5)
    assert sorted(r.fold for r in few.collect()) == [0, 1, 2]


def test_blends_with_zero(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.4, 0.4)], "a double, b double")
    cols = ["a", "b"]
    rows = df.select(
        blend.geometric(cols).alias("g"), blend.harmonic(cols).alias("h"), blend.mean(cols).alias("m"),
        blend.harmonic(cols, True).alias("t"),
    ).collect()
    assert (rows[0].g, rows[0].h, rows[0].m) == (0.0, 0.0, 0.25)
    assert math.isclose(rows[1].g, 0.4) and math.isclose(rows[1].h, 0.2) and math.isclose(rows[1].t, 0.4)


def test_weighted_blend_skips_missing(spark):
    df = spark.createDataFrame([(0.2, None), (None, None)], "a double, b double")
    out = [r.w for r in df.select(blend.weighted({"a": 2.0, "b": 1.0}).alias("w")).collect()]
    assert out[0] == pytest.approx(0.2) and out[1] is None


def test_auc_ties_and_reversal(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "p double, y int")
    assert score.auc_exact(df, "p", "y").first().auc == 0.5
    mixed = spark.createDataFrame([(i * 37 % 101 / 101, int(i % 3 == 0)) for i in range(100)], "p double, y int")
    up = score.auc_exact(mixed, "p", "y").first().auc
    down = score.auc_exact(mixed.withColumn("p", -F.col("p")), "p", "y").first().auc
    assert up + down == pytest.approx(1.0)
    assert score.auc_exact(mixed.filter("y = 1"), "p", "y").first().auc is None


def test_bins(spark):
    df = spark.createDataFrame([(6,), (7,), (42,), (43,), (0,)], "x int")
    out = encode.bin_edges(df, "x", [6, 24, 42], "b").collect()
    assert [r.b for r in out] == [0, 1, 2, 3, 0]


def test_trimmed_text(spark):
    df = spark.createDataFrame([(0.0,), (1.25,), (10.0,), (0.00001,), (3.14159,)], "x double")
    out = [r.t for r in df.select(encode.trimmed_text(F.col("x"), 4).alias("t")).collect()]
    assert out == ["0", "1.25", "10", "0", "3.1416"]


def test_constant_column_scales_to_null(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert encode.min_max(df, ["x"]).first().x_mm is None
    assert encode.zscore(df, ["x"]).first().x_z is None


def test_describe_matches_pandas(spark):
    values = [float((i * 7919) % 101) / 3 for i in range(57)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = df.toPandas().x.describe()
    got = describe_full(df, ["x"]).first()
    for name, key in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
        assert got[name] == pytest.approx(want[key])


def test_running_score(spark):
    aucs = [0.5, 0.7, 0.6, 0.9]
    df = spark.createDataFrame(list(enumerate(aucs)), "b int, auc double")
    want, m = [], 0.0
    for a in aucs:
        m = a if m == 0 else 0.2 * (m * 4 + a)
        want.append(m)
    got = [r.running for r in score.running_score(df, "b").orderBy("b").collect()]
    assert got == pytest.approx(want)


def test_pairs_cover_all_negatives(spark):
    df = spark.createDataFrame([(i, int(i in (2, 5))) for i in range(9)], "row_id long, is_attributed int")
    pairs = sorted((r.neg_id, r.pos_id) for r in match.pair_pos_neg(df).collect())
    assert pairs == [(0, 2), (1, 5), (3, 2), (4, 5), (6, 2), (7, 5), (8, 2)]


def test_split_tail(spark):
    df = split.union_sets(
        {
            "train": spark.range(6).withColumnRenamed("id", "row_id"),
            "supplement": spark.range(2).withColumnRenamed("id", "row_id"),
            "test": spark.range(3).withColumnRenamed("id", "row_id"),
        }
    )
    out = split.split_tail(df, 2).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 4, "valid": 2, "supplement": 2, "test": 3}


def test_block_columns(spark):
    df = spark.createDataFrame([(1, 10, 11, 20, 21)], "id int, a_0 int, b_0 int, a_1 int, b_1 int")
    assert encode.select_blocks(df, ["id"], 2, ["a"], drop=[0]).columns == ["id", "a_1"]
    assert encode.group_fields(df, ["id"], 2, ["a", "b"]).columns == ["id", "a_0", "a_1", "b_0", "b_1"]


def test_skewness_edges(spark):
    rows = [(1, 5)] * 4 + [(2, 1), (2, 9)] + [(3, 0), (3, 0), (3, 7)]
    df = spark.createDataFrame([(i, ip, v) for i, (ip, v) in enumerate(rows)], "row_id long, ip int, v int")
    want = df.toPandas().groupby("ip").v.skew()
    got = {r.ip: r.s for r in aggregate.add_skew(df, ["ip"], "v", "s").collect()}
    assert got[1] == 0.0 and got[2] is None
    assert got[3] == pytest.approx(want[3])


def test_large_groups_do_not_overflow(spark):
    """Power sums of a counted table stand for more rows than a bigint product could hold."""
    base = spark.createDataFrame([(1, 3, 10**12), (1, 5, 10**12)], "app int, hour int, w long")
    row = base.groupBy("app").agg(
        *[aggregate.weighted_measure(k, "hour", "w").alias(k) for k in ("count", "mean", "var", "skew")]
    ).first()
    assert (row["count"], row.mean) == (2 * 10**12, 4.0)
    assert row["var"] == pytest.approx(1.0) and row.skew == pytest.approx(0.0, abs=1e-9)
