"""Row-wise columns: time parts, keys, encoders, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.functions import encode, timeparts, tokens
from clickfeat.operators.aggregate import add_count
from clickfeat.operators.profiles import HOUR_BUCKETS, filter_min_support, profiles
from clickfeat.operators.sequence import next_click_epoch
from clickfeat.operators.skew import neighbours
from clickfeat.plans.build import add_features
from clickfeat.plans.specs import FeatureSpec
from clickfeat.registry.base import clicks_query, predictions, query, r

COUNT_CTE = "c as (select *, count(*) over (partition by ip, app) as n from t)"


def _counted(clicks: DataFrame) -> DataFrame:
    return add_count(clicks, ["ip", "app"], "n")


@clicks_query(
    "time_parts",
    "select row_id, cast(extract(day from click_time) as int) as day, cast(extract(hour from click_time) as int) as hour from clicks",
)
def time_parts(clicks: DataFrame) -> DataFrame:
    return timeparts.time_parts(clicks.drop("day", "hour")).select("row_id", "day", "hour")


@clicks_query("weekday", "select row_id, cast(isodow(click_time) - 1 as int) as wday from clicks")
def weekday(clicks: DataFrame) -> DataFrame:
    return clicks.select("row_id", timeparts.weekday().alias("wday"))


@clicks_query(
    "time_buckets",
    """select row_id, cast(hour // 4 as int) as hour_4, cast(extract(minute from click_time) // 15 as int) as min_15,
              cast(extract(minute from click_time) // 10 as int) as min_10 from clicks""",
)
def time_buckets(clicks: DataFrame) -> DataFrame:
    return clicks.select(
        "row_id",
        timeparts.hour_bin("hour", 4).alias("hour_4"),
        timeparts.minute_bin("click_time", 15).alias("min_15"),
        timeparts.minute_bin("click_time", 10).alias("min_10"),
    )


@clicks_query(
    "parse_datetime",
    """select row_id, cast(extract(year from click_time) as int) as year, cast(extract(month from click_time) as int) as month,
              day, hour, cast(extract(minute from click_time) as int) as minute,
              cast(extract(second from click_time) as int) as second from clicks""",
)
def parse_datetime(clicks: DataFrame) -> DataFrame:
    text = clicks.select("row_id", F.date_format("click_time", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return text.select("row_id", *[c.alias(n) for n, c in timeparts.parse_datetime("text").items()])


@clicks_query("epoch_seconds", "select row_id, s as epoch from t")
def epoch_seconds(clicks: DataFrame) -> DataFrame:
    return clicks.select("row_id", timeparts.epoch_seconds().alias("epoch"))


@clicks_query(
    "combo_key", "select row_id, ip || '_' || app || '_' || device || '_' || os as key from clicks"
)
def combo_key(clicks: DataFrame) -> DataFrame:
    return clicks.select("row_id", encode.combo_key("ip", "app", "device", "os").alias("key"))


@clicks_query("hash_bucket")
def hash_bucket(clicks: DataFrame) -> DataFrame:
    return clicks.select("row_id", encode.hash_bucket("ip", "app", "device", "os").alias("bucket"))


@clicks_query(
    "narrow_cast",
    "select row_id, n % 256 as n_8, (n * 1000) % 65536 as n_16 from c",
    COUNT_CTE,
)
def narrow_cast(clicks: DataFrame) -> DataFrame:
    return _counted(clicks).select(
        "row_id",
        encode.narrow_wrap("n", 8).alias("n_8"),
        encode.narrow_wrap(F.col("n") * 1000, 16).alias("n_16"),
    )


@clicks_query(
    "log2_int",
    """select row_id, cast(floor(log2(1 + n)) as int) as n_log2, cast(floor(log2(1 + gap)) as int) as gap_log2
       from (select *, coalesce(lead(s) over (partition by ip, app, device, os order by row_id), 3000000000) - s as gap
             from c)""",
    COUNT_CTE,
)
def log2_int(clicks: DataFrame) -> DataFrame:
    gaps = next_click_epoch(_counted(clicks), ["ip", "app", "device", "os"], "gap")
    return gaps.select(
        "row_id",
        encode.log2_int(F.col("n")).alias("n_log2"),
        encode.log2_int(F.col("gap")).alias("gap_log2"),
    )


@clicks_query("log10_1p", "select row_id, round(log10(1 + n), 6) as y from c", COUNT_CTE)
def log10_1p(clicks: DataFrame) -> DataFrame:
    return _counted(clicks).select("row_id", r(encode.log10_1p(F.col("n"))).alias("y"))


@clicks_query(
    "log10_scaled",
    """select row_id, round(log10(1 + n) / log10(1 + 306495), 6) as y_fixed,
              round(log10(1 + n) / log10(1 + (select max(n) from c)), 6) as y_table from c""",
    COUNT_CTE,
)
def log10_scaled(clicks: DataFrame) -> DataFrame:
    counted = _counted(clicks)
    top = clicks.groupBy("ip", "app").count().agg(F.max("count")).scalar()
    n = F.col("n")
    return counted.select(
        "row_id",
        r(encode.log10_scaled(n, encode.CLICK_MAX)).alias("y_fixed"),
        r(encode.log10_scaled(n, top)).alias("y_table"),
    )


@clicks_query("loglog", "select row_id, round(ln(ln(n + 1) + 1), 6) as y from c", COUNT_CTE)
def loglog(clicks: DataFrame) -> DataFrame:
    return _counted(clicks).select("row_id", r(encode.loglog(F.col("n"))).alias("y"))


@clicks_query(
    "inverse_log10",
    "select row_id, cast(trunc(pow(10.0::double, hour / 8.0::double) - 1) as bigint) as y from clicks",
)
def inverse_log10(clicks: DataFrame) -> DataFrame:
    return clicks.select("row_id", encode.inverse_log10(F.col("hour") / 8.0).alias("y"))


@clicks_query(
    "zscore",
    """select row_id,
              round((hour - (select avg(hour) from clicks)) / (select stddev_samp(hour) from clicks), 6) as hour_z,
              round((channel - (select avg(channel) from clicks)) / (select stddev_samp(channel) from clicks), 6) as channel_z,
              round((app - 2.5::double) / 1.25::double, 6) as app_z
       from clicks""",
)
def zscore(clicks: DataFrame) -> DataFrame:
    scaled = encode.zscore(clicks, ["hour", "channel", "app"], {"app": (2.5, 1.25)})
    return scaled.select("row_id", *[r(F.col(c)).alias(c) for c in ("hour_z", "channel_z", "app_z")])


@clicks_query(
    "min_max",
    """select row_id,
              round((hour - (select min(hour) from clicks)) / (select max(hour) - min(hour) from clicks)::double, 6) as hour_mm,
              round((channel - (select min(channel) from clicks)) / (select max(channel) - min(channel) from clicks)::double, 6) as channel_mm
       from clicks""",
)
def min_max(clicks: DataFrame) -> DataFrame:
    scaled = encode.min_max(clicks, ["hour", "channel"])
    return scaled.select("row_id", *[r(F.col(c)).alias(c) for c in ("hour_mm", "channel_mm")])


@clicks_query(
    "null_to_zero",
    "select row_id, coalesce(case when os = 2 then null when os = 3 then 0 else hour end, 0)::double as y from clicks",
)
def null_to_zero(clicks: DataFrame) -> DataFrame:
    gappy = (
        F.when(F.col("os") == 2, F.lit(None))
        .when(F.col("os") == 3, F.lit(float("nan")))
        .otherwise(F.col("hour").cast("double"))
    )
    return clicks.select("row_id", encode.null_to_zero(gappy).alias("y"))


@query(
    "round_trim",
    """select click_id, round(p_value, 4) as y,
              case when p_value = 0 then '0'
                   else regexp_replace(printf('%.4f', p_value), '\\.?0+$', '') end as y_text
       from preds""",
)
def round_trim(spark: SparkSession, folder: str) -> DataFrame:
    return predictions(spark, folder).select(
        "click_id",
        F.round("p_value", 4).alias("y"),
        encode.trimmed_text(F.col("p_value"), 4).alias("y_text"),
    )


@clicks_query(
    "bin_edges",
    f"""select row_id,
              cast((select count(*) from unnest({encode.click_edges()}) e(x) where x < n * n * 20) as int) as click_bin,
              cast((select count(*) from unnest({encode.download_edges()}) e(x) where x < n * n * 7) as int) as down_bin,
              cast((n > 6)::int + (n > 24)::int + (n > 42)::int as int) as n_bin
       from c""",
    COUNT_CTE,
)
def bin_edges(clicks: DataFrame) -> DataFrame:
    """Squares of the counts reach far beyond the even steps of the edge lists."""
    square = F.col("n") * F.col("n")
    counted = _counted(clicks).withColumns({"many": square * 20, "loads": square * 7})
    binned = encode.bin_edges(counted, "many", encode.click_edges(), "click_bin")
    binned = encode.bin_edges(binned, "loads", encode.download_edges(), "down_bin")
    binned = encode.bin_edges(binned, "n", [6, 24, 42], "n_bin")
    return binned.select("row_id", "click_bin", "down_bin", "n_bin")


PROFILE_IP_CTE = """
pf as (select ip, count(*) as clk, cast(sum(is_attributed) as bigint) as down,
         count(*) filter (hour // 4 = 0) as h6_0, count(*) filter (hour // 4 = 1) as h6_1,
         count(*) filter (hour // 4 = 2) as h6_2, count(*) filter (hour // 4 = 3) as h6_3,
         count(*) filter (hour // 4 = 4) as h6_4, count(*) filter (hour // 4 = 5) as h6_5
       from clicks group by ip)
"""


@clicks_query(
    "bucket_share",
    "select ip, " + ", ".join(f"round(h6_{i} / clk::double, 6) as h6_{i}_share" for i in range(6)) + " from pf",
    PROFILE_IP_CTE,
)
def bucket_share(clicks: DataFrame) -> DataFrame:
    profile = profiles(clicks, [("ip",)])
    return profile.select(
        "ip", *[r(c).alias(name) for name, c in encode.shares(HOUR_BUCKETS, "clk").items()]
    )


def _entropy_sql(legacy: bool) -> str:
    terms = [f"case when h6_{i} > 0 then -(h6_{i} / clk::double) * ln(h6_{i} / clk::double) end" for i in range(6)]
    if legacy:
        return "coalesce(" + ", ".join(reversed(terms)) + ", 0)"
    return " + ".join(f"coalesce({x}, 0)" for x in terms)


@clicks_query(
    "entropy",
    f"select ip, round({_entropy_sql(False)}, 6) as entropy, round({_entropy_sql(True)}, 6) as entropy_last from pf",
    PROFILE_IP_CTE,
)
def entropy(clicks: DataFrame) -> DataFrame:
    profile = profiles(clicks, [("ip",)])
    counts, clk = [F.col(c) for c in HOUR_BUCKETS], F.col("clk")
    return profile.select(
        "ip",
        r(encode.entropy(counts, clk)).alias("entropy"),
        r(encode.entropy(counts, clk, legacy=True)).alias("entropy_last"),
    )


@clicks_query(
    "select_blocks",
    """select a.row_id,
              x.clk as clk_0, x.down as down_0, y.clk as clk_2, y.down as down_2
       from clicks a
       join (select app, count(*) as clk, cast(sum(is_attributed) as bigint) as down from clicks group by app) x using (app)
       join (select channel, count(*) as clk, cast(sum(is_attributed) as bigint) as down from clicks group by channel) y using (channel)""",
)
def select_blocks(clicks: DataFrame) -> DataFrame:
    """Three profile blocks; the second block and the bucket columns are dropped."""
    out = clicks
    for block, keys in enumerate((["app"], ["os"], ["channel"])):
        table = clicks.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"clk_{block}"),
            F.sum("is_attributed").alias(f"down_{block}"),
            F.sum((F.col("hour") < 12).cast("long")).alias(f"am_{block}"),
        )
        out = out.join(table, keys, "left")
    return encode.select_blocks(out, ["row_id"], 3, ["clk", "down"], drop=[1])


@clicks_query(
    "select_id",
    "select row_id, case when hour in (4,5,9,10,13,14) then row_id + 1000000000 else is_attributed end as id from clicks",
)
def select_id(clicks: DataFrame) -> DataFrame:
    test = F.col("hour").isin(*encode.TEST_HOURS)
    sets = clicks.withColumns(
        {
            "click_id": F.when(test, F.col("row_id") + 1_000_000_000),
            "label": F.when(~test, F.col("is_attributed")),
        }
    )
    return sets.select("row_id", encode.select_id("click_id", "label").alias("id"))


@clicks_query(
    "row_weight",
    """select row_id, (case when is_attributed = 1 then 1.0 else 0.2 end)::double
                    * (case when hour in (4,5,10,13,14) then 1.0 else 0.5 end)::double as weight from clicks""",
)
def row_weight(clicks: DataFrame) -> DataFrame:
    return clicks.select("row_id", encode.row_weight().alias("weight"))


@clicks_query(
    "filter_hours",
    "select row_id, day, hour from clicks where hour in (4,5,9,10,13,14) and day = 9",
)
def filter_hours(clicks: DataFrame) -> DataFrame:
    kept = clicks.filter(F.col("hour").isin(*encode.TEST_HOURS) & (F.col("day") == 9))
    return kept.select("row_id", "day", "hour")


@clicks_query(
    "filter_min_support",
    "select ip || '_' || app as key, count(*) as clk from clicks group by ip, app having count(*) > 5",
)
def filter_min_support_query(clicks: DataFrame) -> DataFrame:
    return filter_min_support(profiles(clicks, [("ip", "app")])).select("key", "clk")


@clicks_query(
    "token_row",
    "select row_id, 'A' || ip || ' B' || app || ' C' || device || ' D' || os || ' E' || channel as tokens from clicks",
)
def token_row(clicks: DataFrame) -> DataFrame:
    words = tokens.lettered(["ip", "app", "device", "os", "channel"])
    return clicks.select("row_id", F.array_join(words, " ").alias("tokens"))


@clicks_query(
    "token_row_named",
    """select row_id, 'I' || ip || ' A' || app || ' D' || device || ' O' || os || ' C' || channel || ' WD' || day
              || ' H' || hour || ' AXC' || app || '_' || channel || ' OXC' || os || '_' || channel
              || ' AXD' || app || '_' || device || ' IXA' || ip || '_' || app || ' AXO' || app || '_' || os as tokens
       from clicks""",
)
def token_row_named(clicks: DataFrame) -> DataFrame:
    return clicks.select("row_id", F.array_join(tokens.named(), " ").alias("tokens"))


COUNT_KEYS = {col: col.removesuffix("_count").split("_") for _, col in (*tokens.COUNT_TOKENS, *tokens.MORE_COUNT_TOKENS)}
COUNT_KEYS.pop("next_click")


@clicks_query(
    "token_row_counts",
    """select row_id, """
    + " || ' ' || ".join(
        f"'{prefix}' || " + ("coalesce(next_click, -1)" if col == "next_click" else f"cast(floor(log2({col} + 1)) as int)")
        for prefix, col in (*tokens.COUNT_TOKENS, *tokens.MORE_COUNT_TOKENS)
    )
    + " as tokens from wide",
    "wide as (select *, "
    + ", ".join(f"count(*) over (partition by {', '.join(keys)}) as {col}" for col, keys in COUNT_KEYS.items())
    + ", lead(row_id) over (partition by ip, app, device, os order by row_id) - row_id as next_click from clicks)",
)
def token_row_counts(clicks: DataFrame) -> DataFrame:
    """All twelve count tokens; counts are coded as whole base-2 logarithms before."""
    specs = [FeatureSpec(col, "count", tuple(keys)) for col, keys in COUNT_KEYS.items()]
    wide = add_features(clicks, specs)
    after = neighbours(clicks, ["ip", "app", "device", "os"], F.col("row_id")).select(
        "row_id", F.coalesce(F.col("__next") - F.col("row_id"), F.lit(-1)).alias("next_click")
    )
    coded = wide.withColumns({col: encode.log2_int(F.col(col)) for col in COUNT_KEYS}).join(after, "row_id")
    every = tokens.named((*tokens.COUNT_TOKENS, *tokens.MORE_COUNT_TOKENS))
    only = F.slice(every, len(tokens.NAMED_TOKENS) + 1, F.size(every))
    return coded.select("row_id", F.array_join(only, " ").alias("tokens"))


@clicks_query("hash_tokens")
def hash_tokens(clicks: DataFrame) -> DataFrame:
    hashed = tokens.hash_tokens(clicks.withColumn("tokens", tokens.named()), "tokens")
    return hashed.select("row_id", F.col("features").cast("string").alias("features"))


@query(
    "map_label",
    """select event_id, case event_type when 'click' then 'Click' when 'view' then 'View'
              when 'purchase' then 'Purchase' else event_type end as name from events""",
)
def map_label(spark: SparkSession, folder: str) -> DataFrame:
    names = {"click": "Click", "view": "View", "purchase": "Purchase"}
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select("event_id", encode.map_label(F.col("event_type"), names).alias("name"))


@query("truncate_text", "select page_id, substr(url, 1, 80) as url_short, length(url) as n from pages")
def truncate_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return pages.select(
        "page_id",
        encode.truncate_text(F.col("url")).alias("url_short"),
        F.length("url").cast("long").alias("n"),
    )


@query("clip", "select click_id, least(greatest(p_value * 5, 1), 3) as y from preds")
def clip(spark: SparkSession, folder: str) -> DataFrame:
    return predictions(spark, folder).select(
        "click_id", encode.clip(F.col("p_value") * 5).alias("y")
    )
