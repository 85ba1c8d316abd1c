"""Joins, group features, sequence features, profiles, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.operators import aggregate, describe, match, profiles, sequence
from clickfeat.operators.skew import attach_by_key, row_index
from clickfeat.plans.build import add_features
from clickfeat.plans.specs import (
    CATALOGUE,
    CHUNK_FEATURES,
    FINAL_FEATURES,
    NUMBERED_FEATURES,
    FeatureSpec,
    spec_by_code,
)
from clickfeat.registry.base import clicks_query, predictions, query, rounded
from clickfeat.registry.files import MAPPING_SQL, match_inputs
from clickfeat.schema import LOOKUP_KEY_SETS, PROFILE_KEY_SETS
from clickfeat.session import new_folder
from clickfeat.sources.readers import read_clicks, with_file_positions


def spec_sql(spec: FeatureSpec) -> str:
    """The feature as SQL over the view ``t``; distinct counts come from joined tables ``u_<name>``."""
    keys = ", ".join(spec.keys)
    part, v = f"partition by {keys}", spec.value
    if spec.kind == "count":
        body = f"count(*) over ({part})"
    elif spec.kind == "count_nonnull":
        body = f"count({v}) over ({part})"
    elif spec.kind == "nunique":
        body = f"u_{spec.name}.x"
    elif spec.kind == "skew":
        body = f"round(u_{spec.name}.x, 5)"
    elif spec.kind == "mean":
        body = f"round(sum({v}) over ({part}) / count({v}) over ({part})::double, 6)"
    elif spec.kind == "var":
        n = f"count({v}) over ({part})"
        s, ss = f"sum({v}) over ({part})", f"sum({v} * {v}) over ({part})"
        body = f"round(case when {n} > 1 then ({n} * {ss} - {s} * {s}) / ({n} * ({n} - 1))::double end, 6)"
    elif spec.kind == "cumcount":
        body = f"row_number() over ({part} order by row_id) - 1"
    elif spec.kind == "next":
        body = f"(lead(s) over ({part} order by row_id) - s) % 86400"
    elif spec.kind == "prev":
        body = f"(s - lag(s) over ({part} order by row_id)) % 86400"
    elif spec.kind == "next_epoch":
        body = f"coalesce(lead(s) over ({part} order by row_id), 3000000000) - s"
    else:
        raise ValueError(spec.kind)
    return f"{body} as {spec.name}"


def specs_sql(specs: list[FeatureSpec]) -> str:
    per_group = {
        "nunique": "count(distinct {v})",
        # Equal values have skewness 0.
        "skew": "case when count({v}) > 2 then case when min({v}) = max({v}) then 0.0::double else skewness({v}) end end",
    }
    joins = "".join(
        f" join (select {', '.join(s.keys)}, {per_group[s.kind].format(v=s.value)} as x from t group by {', '.join(s.keys)})"
        f" u_{s.name} using ({', '.join(s.keys)})"
        for s in specs
        if s.kind in per_group
    )
    return f"select t.row_id, {', '.join(spec_sql(s) for s in specs)} from t{joins}"


def run_specs(clicks: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    wide = add_features(clicks, specs).select("row_id", *[s.name for s in specs])
    wide = rounded(wide, [s.name for s in specs if s.kind == "skew"], 5)
    return rounded(wide, [s.name for s in specs if s.kind in ("mean", "var")])


def _register_specs(name: str, specs: list[FeatureSpec]) -> None:
    clicks_query(name, specs_sql(specs))(lambda clicks: run_specs(clicks, specs))


_register_specs("catalogue", CATALOGUE)
_register_specs("final_features", FINAL_FEATURES)
_register_specs("numbered_features", NUMBERED_FEATURES)
_register_specs("chunk_features", CHUNK_FEATURES)

FLAGSHIP = [
    FeatureSpec("ip_app_co", "count", ("ip", "app")),
    FeatureSpec("ip_cu_c", "nunique", ("ip",), "channel"),
    FeatureSpec("ip_app_chl_var_h", "var", ("ip", "app"), "hour"),
    FeatureSpec("ip_os_device_nextClick", "next", ("ip", "os", "device")),
]
_register_specs("flagship", FLAGSHIP)


# ---- joins -------------------------------------------------------------------


@clicks_query(
    "join_back",
    """select row_id, g.n, g.last_hour from clicks
       join (select ip, app, os, count(*) as n, max(hour) as last_hour from clicks group by ip, app, os) g using (ip, app, os)""",
)
def join_back(clicks: DataFrame) -> DataFrame:
    table = clicks.groupBy("ip", "app", "os").agg(
        F.count(F.lit(1)).alias("n"), F.max("hour").alias("last_hour")
    )
    counts = table.select("ip", "app", "os", F.col("n").alias("__n"))
    return attach_by_key(clicks, table, ["ip", "app", "os"], counts).select("row_id", "n", "last_hour")


# Rows to look up are all clicks; profiles are built from the clicks before the test hours,
# so that some keys are missing from them.
LOOKUP_FILTER = "hour < 9"


def _profile_sets_sql(key_sets, where: str = "true") -> str:
    """Profile rows of every key set as SQL."""
    parts = []
    for keys in key_sets:
        key = " || '_' || ".join(f"cast({k} as varchar)" for k in keys)
        h6 = ", ".join(f"count(*) filter (hour // 4 = {i}) as h6_{i}" for i in range(6))
        q4 = ", ".join(
            f"count(*) filter (cast(extract(minute from click_time) as int) // 15 = {i}) as q4_{i}" for i in range(4)
        )
        parts.append(
            f"select '{'_'.join(keys)}' as key_set, {key} as key, count(*) as clk, "
            f"cast(sum(is_attributed) as bigint) as down, {h6}, {q4} from clicks where {where} group by {', '.join(keys)}"
        )
    return " union all ".join(parts)


def _h(prefix: str, n: int) -> str:
    return " + ".join(
        f"coalesce(case when {prefix}_{i} > 0 then -({prefix}_{i} / clk::double) * ln({prefix}_{i} / clk::double) end, 0)"
        for i in range(n)
    )


PROFILE_COLUMNS = [*profiles.HOUR_BUCKETS, *profiles.QUARTER_BUCKETS]
RATES_SQL = f"down / clk::double as rate, {_h('h6', 6)} as entropy_6, {_h('q4', 4)} as entropy_4"


def _fallback_cte(name: str, source: str, keep: str, floor: bool) -> str:
    sums = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ["clk", "down", *PROFILE_COLUMNS])
    avg = (lambda c: f"floor({c} / keys::double)") if floor else (lambda c: f"{c} / keys::double")
    return (
        f"{name} as (select key_set, {avg('clk')} as clk, {avg('down')} as down, {RATES_SQL} "
        f"from (select key_set, count(*) as keys, {sums} from {source} where {keep} group by key_set))"
    )


ALL_PROFILES_CTE = f"pc as ({_profile_sets_sql(PROFILE_KEY_SETS)})"
LOOKUP_CTES = (
    f"lc as materialized ({_profile_sets_sql(LOOKUP_KEY_SETS, LOOKUP_FILTER)})",
    f"lp as materialized (select *, {RATES_SQL} from lc)",
    _fallback_cte("lm", "lc", "clk <= 10000", False),
)


@clicks_query(
    "profiles",
    f"select key_set, key, clk, down, {', '.join(PROFILE_COLUMNS)}, round(rate, 6) as rate, "
    f"round(entropy_6, 6) as entropy_6, round(entropy_4, 6) as entropy_4 from (select *, {RATES_SQL} from pc)",
    ALL_PROFILES_CTE,
)
def profiles_query(clicks: DataFrame) -> DataFrame:
    out = profiles.profiles(clicks).select(
        "key_set", "key", "clk", "down", *PROFILE_COLUMNS, "rate", "entropy_6", "entropy_4"
    )
    return rounded(out, ["rate", "entropy_6", "entropy_4"])


def _round_stats_sql(source: str) -> str:
    return "select key_set, " + ", ".join(f"round({c}, 6) as {c}" for c in profiles.STATS) + f" from {source}"


@clicks_query(
    "profile_fallback",
    _round_stats_sql("fb"),
    ALL_PROFILES_CTE,
    _fallback_cte("fb", "pc", "clk <= 10000", False),
)
def profile_fallback(clicks: DataFrame) -> DataFrame:
    return rounded(profiles.fallback(profiles.profiles(clicks)).drop("key"), profiles.STATS)


@clicks_query(
    "profile_fallback_low",
    _round_stats_sql("fb"),
    ALL_PROFILES_CTE,
    _fallback_cte("fb", "pc", "clk <= 5", False),
)
def profile_fallback_low(clicks: DataFrame) -> DataFrame:
    low = profiles.fallback(profiles.profiles(clicks), F.col("clk") <= 5)
    return rounded(low.drop("key"), profiles.STATS)


@clicks_query(
    "profile_fallback_mid",
    _round_stats_sql("fb"),
    ALL_PROFILES_CTE,
    _fallback_cte("fb", "pc", "clk > 5 and clk < 5000", True),
)
def profile_fallback_mid(clicks: DataFrame) -> DataFrame:
    return rounded(profiles.fallback_mid(profiles.profiles(clicks)).drop("key"), profiles.STATS)


def stored_profile(clicks: DataFrame) -> DataFrame:
    """Profile of the clicks before the test hours, written and read back."""
    spark = clicks.sparkSession
    path = new_folder(spark, "lookup-profile")
    profiles.write_profiles(profiles.profiles(clicks.filter(LOOKUP_FILTER), LOOKUP_KEY_SETS), path)
    return spark.read.parquet(path)


def _lookup_sql(fields: dict[str, str], mean: bool, min_clicks: int | None) -> str:
    cols, joins = [], []
    for i, keys in enumerate(LOOKUP_KEY_SETS, start=1):
        name = "_".join(keys)
        key = " || '_' || ".join(f"cast(a.{k} as varchar)" for k in keys)
        support = f" and p{i}.clk >= {min_clicks}" if min_clicks else ""
        joins.append(f"left join lp p{i} on p{i}.key_set = '{name}' and p{i}.key = {key}{support}")
        for f, p in fields.items():
            value = f"p{i}.{f}"
            if mean:
                value = f"coalesce({value}, (select {f} from lm where key_set = '{name}'))"
            cols.append(f"round({value}, 6) as {p}{i}")
    return f"select a.row_id, {', '.join(cols)} from clicks a {' '.join(joins)}"


LOOKUP_FIELDS = {"clk": "c", "rate": "r", "entropy_6": "h"}


def _looked_up(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c[0] in "crh" and c[1:].isdigit()]
    return rounded(df.select("row_id", *names), names)


@clicks_query("profile_lookup", _lookup_sql(LOOKUP_FIELDS, True, None), *LOOKUP_CTES)
def profile_lookup(clicks: DataFrame) -> DataFrame:
    profile = stored_profile(clicks)
    return _looked_up(profiles.lookup(clicks, profile, LOOKUP_FIELDS, profiles.fallback(profile)))


@clicks_query("profile_lookup_min", _lookup_sql(LOOKUP_FIELDS, True, 5), *LOOKUP_CTES)
def profile_lookup_min(clicks: DataFrame) -> DataFrame:
    profile = stored_profile(clicks)
    mean = profiles.fallback(profile)
    return _looked_up(
        profiles.lookup(clicks, profile, LOOKUP_FIELDS, mean, min_clicks=profiles.MIN_SUPPORT)
    )


@clicks_query("profile_lookup_null", _lookup_sql({"rate": "r"}, False, None), *LOOKUP_CTES)
def profile_lookup_null(clicks: DataFrame) -> DataFrame:
    return _looked_up(profiles.lookup(clicks, stored_profile(clicks), {"rate": "r"}))


@clicks_query(
    "profile_merge",
    """select a.key_set, a.key, a.clk, a.down, round(coalesce(b.rate, 0.0), 6) as rate
       from (select 'ip_app' as key_set, ip || '_' || app as key, count(*) as clk,
                    cast(sum(is_attributed) as bigint) as down from clicks group by ip, app) a
       left join (select ip || '_' || app as key, sum(is_attributed) / count(*)::double as rate
                  from clicks where hour < 9 group by ip, app) b using (key)""",
)
def profile_merge(clicks: DataFrame) -> DataFrame:
    a = profiles.profiles(clicks, [("ip", "app")])
    b = profiles.profiles(clicks.filter(LOOKUP_FILTER), [("ip", "app")])
    merged = profiles.merge_rate(a, b).select("key_set", "key", "clk", "down", "rate")
    return rounded(merged, ["rate"])


@query(
    "concat_columns",
    """select c.row_id, c.ip as "0_ip", c.app as "0_app", p.p_hour as "1_p_hour", p.p_value as "2_p_value"
       from clicks c join preds p on c.row_id = p.click_id""",
)
def concat_columns(spark: SparkSession, folder: str) -> DataFrame:
    preds = predictions(spark, folder).withColumnRenamed("click_id", "row_id")
    return match.concat_columns(
        [(read_clicks(spark, folder), ["ip", "app"]), (preds, ["p_hour"]), (preds, ["p_value"])]
    )


@query("match_ids_consume", MAPPING_SQL)
def match_ids_consume(spark: SparkSession, folder: str) -> DataFrame:
    test, supplement = match_inputs(spark, folder)
    return match.match_consume(test, supplement, ["ip", "app", "device", "day"])


@query(
    "match_ids_pairwise",
    """select b.row_id as supplement_id, a.row_id + 1000000000 as test_id
       from (select *, row_number() over (partition by ip, app, device, day order by row_id) as i
             from clicks where hour in (4,5,9,10,13,14)) a
       join (select *, row_number() over (partition by ip, app, device, day order by row_id) as i from clicks) b
       using (ip, app, device, day, i)""",
)
def match_ids_pairwise(spark: SparkSession, folder: str) -> DataFrame:
    test, supplement = match_inputs(spark, folder)
    return match.match_pairwise(test, supplement, ["ip", "app", "device", "day"])


PAIR_CTE = """
pn as (select row_id, is_attributed > 0 as pos,
              row_number() over (partition by is_attributed > 0 order by row_id) - 1 as i from clicks)
"""


@clicks_query(
    "pair_pos_neg",
    """select p.row_id as pos_id, n.row_id as neg_id
       from (select * from pn where not pos) n join (select * from pn where pos) p
       on p.i = n.i % (select count(*) from pn where pos)""",
    PAIR_CTE,
)
def pair_pos_neg(clicks: DataFrame) -> DataFrame:
    return match.pair_pos_neg(clicks)


@clicks_query(
    "pair_equal",
    "select p.row_id as pos_id, n.row_id as neg_id from pn p join pn n on p.pos and not n.pos and p.i = n.i",
    PAIR_CTE,
)
def pair_equal(clicks: DataFrame) -> DataFrame:
    return match.pair_pos_neg(clicks, mode="equal")


def _shuffled_sql(name: str, where: str) -> str:
    order = "('0x' || substr(md5('7|' || row_id), 1, 15))::bigint, row_id"
    return f"{name} as (select row_id, row_number() over (order by {order}) - 1 as i from clicks where {where})"


@clicks_query(
    "pair_random",
    """select p.row_id as pos_id, n.row_id as neg_id from negatives n
       join positives p on p.i = n.i % (select count(*) from positives)""",
    _shuffled_sql("positives", "is_attributed > 0"),
    _shuffled_sql("negatives", "is_attributed = 0"),
)
def pair_random(clicks: DataFrame) -> DataFrame:
    return match.pair_pos_neg(clicks, seed=7)


@query("blend_join", "select click_id, p_hour, p_channel, p_value from preds")
def blend_join(spark: SparkSession, folder: str) -> DataFrame:
    preds = predictions(spark, folder)
    names = ["p_hour", "p_channel", "p_value"]
    return match.blend_join({n: preds.select("click_id", F.col(n).alias("is_attributed")) for n in names})


# ---- aggregates --------------------------------------------------------------


@clicks_query("agg_count", "select row_id, count(*) over (partition by ip, app) as ip_app_co from clicks")
def agg_count(clicks: DataFrame) -> DataFrame:
    return aggregate.add_count(clicks, ["ip", "app"], "ip_app_co").select("row_id", "ip_app_co")


@clicks_query(
    "agg_count_nonnull",
    "select row_id, count(case when os <> 2 then channel end) over (partition by ip, day, hour) as ip_tcount from clicks",
)
def agg_count_nonnull(clicks: DataFrame) -> DataFrame:
    gappy = clicks.withColumn("channel", F.when(F.col("os") != 2, F.col("channel")))
    return aggregate.add_count_nonnull(gappy, ["ip", "day", "hour"], "channel", "ip_tcount").select(
        "row_id", "ip_tcount"
    )


@clicks_query(
    "agg_count_unique_combo",
    "select row_id, count(*) over (partition by ip, app, os) as ip_app_os_count from clicks",
)
def agg_count_unique_combo(clicks: DataFrame) -> DataFrame:
    return aggregate.add_count(clicks, ["ip", "app", "os"]).select("row_id", "ip_app_os_count")


@clicks_query(
    "agg_countuniq",
    """select row_id, x as ip_cu_c from clicks
       join (select ip, count(distinct channel) as x from clicks group by ip) using (ip)""",
)
def agg_countuniq(clicks: DataFrame) -> DataFrame:
    return aggregate.add_countuniq(clicks, ["ip"], "channel", "ip_cu_c").select("row_id", "ip_cu_c")


@clicks_query("agg_countuniq_approx")
def agg_countuniq_approx(clicks: DataFrame) -> DataFrame:
    return aggregate.add_countuniq(clicks, ["ip"], "channel", "ip_cu_c", approximate=True).select(
        "row_id", "ip_cu_c"
    )


@clicks_query(
    "agg_mean",
    """select row_id, round(sum(hour) over (partition by ip, app, channel)
              / count(hour) over (partition by ip, app, channel)::double, 6) as ip_app_chl_mean_h from clicks""",
)
def agg_mean(clicks: DataFrame) -> DataFrame:
    out = aggregate.add_mean(clicks, ["ip", "app", "channel"], "hour", "ip_app_chl_mean_h")
    return rounded(out.select("row_id", "ip_app_chl_mean_h"), ["ip_app_chl_mean_h"])


@clicks_query(
    "agg_var",
    "select row_id, round(var_samp(hour) over (partition by ip, app), 6) as ip_app_chl_var_h from clicks",
)
def agg_var(clicks: DataFrame) -> DataFrame:
    out = aggregate.add_var(clicks, ["ip", "app"], "hour", "ip_app_chl_var_h")
    return rounded(out.select("row_id", "ip_app_chl_var_h"), ["ip_app_chl_var_h"])


@clicks_query(
    "agg_skew",
    """select row_id, round(x, 5) as ip_skew_h from clicks
       join (select ip, skewness(hour) as x from clicks group by ip) using (ip)""",
)
def agg_skew(clicks: DataFrame) -> DataFrame:
    out = aggregate.add_skew(clicks, ["ip"], "hour", "ip_skew_h")
    return rounded(out.select("row_id", "ip_skew_h"), ["ip_skew_h"], 5)


BY_CODE = [
    spec_by_code("k0", ["ip", "app", "channel"], 0),
    spec_by_code("k1", ["ip", "app", "hour"], 1),
    spec_by_code("k2", ["ip", "app", "hour"], 2),
    spec_by_code("k3", ["ip", "app", "hour"], 3),
    spec_by_code("k3_app", ["app", "channel", "hour"], 3),
    spec_by_code("k4", ["ip", "channel"], 4),
    spec_by_code("k5", ["ip", "os"], 5),
]
_register_specs("agg_by_code", BY_CODE)


@clicks_query(
    "describe_basic",
    " union all ".join(
        f"select '{c}' as \"column\", round(avg({c}), 6) as mean, max({c})::double as max, min({c})::double as min from clicks"
        for c in ("ip", "channel", "hour")
    ),
)
def describe_basic(clicks: DataFrame) -> DataFrame:
    return rounded(describe.describe_basic(clicks, ["ip", "channel", "hour"]), ["mean"])


@query(
    "describe_full",
    " union all ".join(
        f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, "
        f"min({c})::double as min, round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50, "
        f"round(quantile_cont({c}, 0.75), 4) as p75, max({c})::double as max from lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def describe_full(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    out = describe.describe_full(items, ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(out, ["mean", "std", "p25", "p50", "p75"], 4)


@clicks_query(
    "feature_max",
    """select max(a) as ip_app_co, max(b) as ip_d_co, max(c) as ip_c_os from (
         select count(*) over (partition by ip, app) as a, count(*) over (partition by ip, device) as b,
                row_number() over (partition by ip order by row_id) - 1 as c from clicks)""",
)
def feature_max(clicks: DataFrame) -> DataFrame:
    specs = [s for s in CATALOGUE if s.name in ("ip_app_co", "ip_d_co", "ip_c_os")]
    wide = add_features(clicks, specs)
    return describe.feature_max(wide, ["ip_app_co", "ip_d_co", "ip_c_os"])


# ---- sequences ---------------------------------------------------------------


@clicks_query(
    "next_click",
    "select row_id, (lead(s) over (partition by ip, os, device order by row_id) - s) % 86400 as ip_os_device_nextClick from t",
)
def next_click(clicks: DataFrame) -> DataFrame:
    out = sequence.next_click(clicks, ["ip", "os", "device"])
    return out.select("row_id", "ip_os_device_nextClick")


@clicks_query(
    "prev_click",
    "select row_id, (s - lag(s) over (partition by ip, channel order by row_id)) % 86400 as ip_channel_prevClick from t",
)
def prev_click(clicks: DataFrame) -> DataFrame:
    return sequence.prev_click(clicks, ["ip", "channel"]).select("row_id", "ip_channel_prevClick")


@clicks_query(
    "next_click_epoch",
    """select row_id, coalesce(lead(s) over (partition by ip, app, device, os order by row_id), 3000000000) - s as next_click
       from t""",
)
def next_click_epoch(clicks: DataFrame) -> DataFrame:
    return sequence.next_click_epoch(clicks, ["ip", "app", "device", "os"]).select("row_id", "next_click")


@clicks_query(
    "cumcount",
    "select row_id, row_number() over (partition by ip, device, os order by row_id) - 1 as ip_d_os_c_app from clicks",
)
def cumcount(clicks: DataFrame) -> DataFrame:
    return sequence.cumcount(clicks, ["ip", "device", "os"], "ip_d_os_c_app").select("row_id", "ip_d_os_c_app")


@clicks_query(
    "shift_rows",
    "select row_id, lag(hour) over (order by row_id) as hour_shift, lag(ip) over (order by row_id) as ip_shift from clicks",
)
def shift_rows(clicks: DataFrame) -> DataFrame:
    return sequence.shift_rows(clicks, ["hour", "ip"]).select("row_id", "hour_shift", "ip_shift")


@query(
    "row_index",
    "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as row_id from orders",
)
def row_index_query(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate")
    return row_index(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_id")


@query(
    "row_index_files",
    "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as row_id from orders",
)
def row_index_files(spark: SparkSession, folder: str) -> DataFrame:
    """Positions in a table of several files that is in order already."""
    path = new_folder(spark, "ordered")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate")
    order = ["o_orderdate", "o_orderkey"]
    orders.repartitionByRange(6, *order).sortWithinPartitions(*order).write.parquet(path)
    return with_file_positions(spark.read.parquet(path)).select("o_orderkey", "row_id")
