"""Sources and sinks.  Every file read here was written from the whole click log in the same call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfeat.operators.aggregate import add_count
from clickfeat.operators.describe import clicks_by_url, rank_by_clicks, ranked_report
from clickfeat.operators.match import match_consume
from clickfeat.operators.profiles import fallback, profile_file, profiles, write_profiles
from clickfeat.operators.split import split_position_hour
from clickfeat.registry.base import clicks_query, predictions, query, r
from clickfeat.schema import TEST_LOG, TRAIN_LOG
from clickfeat.session import new_folder
from clickfeat.sources import readers, writers
from clickfeat.sources.readers import read_clicks

# Display names used by the report queries.
NAMES = {"click": "Click", "view": "View", "purchase": "Purchase"}


def train_log(clicks: DataFrame) -> DataFrame:
    """The log in the field order of the training file."""
    attributed = F.when(F.col("is_attributed") == 1, F.col("click_time"))
    return clicks.withColumn("attributed_time", attributed).select(*TRAIN_LOG.fieldNames())


def test_log(clicks: DataFrame) -> DataFrame:
    return clicks.withColumn("click_id", F.col("row_id")).select(*TEST_LOG.fieldNames())


@query(
    "scan_clicks",
    "select ip, app, device, os, channel, s as epoch, is_attributed from t",
)
def scan_clicks(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "train-log")
    writers.write_csv(train_log(read_clicks(spark, folder)), path)
    columns = ["ip", "app", "device", "os", "channel", "click_time", "is_attributed"]
    return readers.scan_csv(spark, path, TRAIN_LOG, columns).select(
        "ip", "app", "device", "os", "channel",
        F.unix_timestamp("click_time").alias("epoch"), "is_attributed",
    )


@clicks_query(
    "scan_row_range",
    """select row_id, ip, app, s as epoch from t
       where row_id >= (select count(*) * 35 // 100 from events)
         and row_id < (select count(*) * 85 // 100 from events)""",
)
def scan_row_range(clicks: DataFrame) -> DataFrame:
    n = clicks.count()
    start, end = n * 35 // 100, n * 85 // 100
    return readers.row_range(clicks, start, end - start).select(
        "row_id", "ip", "app", F.unix_timestamp("click_time").alias("epoch")
    )


@clicks_query(
    "scan_chunked",
    """select row_id, row_id // 400 as chunk_id,
              count(*) over (partition by row_id // 400, ip, app) as chunk_ip_app_count
       from clicks""",
)
def scan_chunked(clicks: DataFrame) -> DataFrame:
    chunked = readers.with_chunk(clicks, 400)
    return add_count(chunked, ["chunk_id", "ip", "app"], "chunk_ip_app_count").select(
        "row_id", "chunk_id", "chunk_ip_app_count"
    )


@query(
    "scan_many_files",
    """select case when hour < 12 then 0 else 1 end as file_ord, row_id as click_id, ip, channel, s as epoch
       from t""",
)
def scan_many_files(spark: SparkSession, folder: str) -> DataFrame:
    clicks = read_clicks(spark, folder)
    paths = [new_folder(spark, f"part{i}") for i in (0, 1)]
    writers.write_csv(test_log(clicks.filter("hour < 12")), paths[0])
    writers.write_csv(test_log(clicks.filter("hour >= 12")), paths[1])
    return readers.scan_many(spark, paths, TEST_LOG).select(
        "file_ord", "click_id", "ip", "channel", F.unix_timestamp("click_time").alias("epoch")
    )


@query(
    "scan_profiles",
    """select concat_ws('_', cast(ip as varchar), cast(app as varchar)) as key,
              cast(count(*) as double) as clk, cast(sum(is_attributed) as double) as down
       from clicks group by ip, app""",
)
def scan_profiles(spark: SparkSession, folder: str) -> DataFrame:
    profile = profiles(read_clicks(spark, folder), [("ip", "app")])
    path = new_folder(spark, "profile-file")
    fields = ["key", "clk", "down", "rate", "entropy_6", "entropy_4"]
    writers.write_csv(profile.select(*fields), path, header=False)
    return readers.scan_profiles(spark, path, ["key", "clk", "down"])


@query(
    "scan_tolerant",
    "select row_id as click_id, ip, app, s as epoch from t where os <> 0 and os <> 3",
)
def scan_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    """A log where the lines of two systems are broken: one cut short, one with a field too many."""
    clicks = test_log(read_clicks(spark, folder))
    time = F.date_format("click_time", readers.TIME_FORMAT)
    fields = [F.col(c).cast("string") for c in TEST_LOG.fieldNames() if c != "click_time"]
    line = F.concat_ws(",", *fields, time)
    broken = (
        F.when(F.col("os") == 0, F.lit(","))
        .when(F.col("os") == 3, F.concat(line, F.lit(",x")))
        .otherwise(line)
    )
    path = new_folder(spark, "broken-log")
    clicks.select(broken.alias("value")).write.text(path)
    return readers.scan_tolerant(spark, path, TEST_LOG).select(
        "click_id", "ip", "app", F.unix_timestamp("click_time").alias("epoch")
    )


@query(
    "write_features",
    """select row_id, ip, hour, ip_app_count,
              case when row_id >= (select count(*) * 6 // 10 from events)
                    and hour in (4,5,9,10,13,14) then 'test' else 'train' end as split
       from (select *, count(*) over (partition by ip, app) as ip_app_count from clicks)""",
)
def write_features(spark: SparkSession, folder: str) -> DataFrame:
    clicks = read_clicks(spark, folder)
    first = clicks.count() * 6 // 10
    features = add_count(split_position_hour(clicks, first), ["ip", "app"])
    path = new_folder(spark, "features")
    writers.write_features(features.select("row_id", "ip", "hour", "ip_app_count", "split"), path)
    return spark.read.parquet(path)


@query(
    "write_submission",
    "select click_id, printf('%.9f', p_value) as is_attributed from preds",
)
def write_submission(spark: SparkSession, folder: str) -> DataFrame:
    path = writers.write_submission(
        predictions(spark, folder), new_folder(spark, "submissions"), "p_value", "p_value"
    )
    schema = T.StructType([T.StructField("click_id", T.LongType()), T.StructField("is_attributed", T.StringType())])
    return readers.scan_csv(spark, path, schema)


@query(
    "write_gzip",
    "select row_id as click_id, ip, app, device, os, channel, s as epoch from t",
)
def write_gzip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "gzip-log")
    writers.write_gzip(test_log(read_clicks(spark, folder)), path)
    return readers.scan_csv(spark, path, TEST_LOG).select(
        "click_id", "ip", "app", "device", "os", "channel",
        F.unix_timestamp("click_time").alias("epoch"),
    )


@query(
    "write_chunks",
    "select cast(row_id // 2500 as int) as chunk_id, row_id, ip from clicks",
)
def write_chunks(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "chunks")
    chunked = readers.with_chunk(read_clicks(spark, folder), 2500)
    writers.write_chunks(chunked.select("chunk_id", "row_id", "ip"), path)
    return spark.read.parquet(path).select(F.col("chunk_id").cast("int"), "row_id", "ip")


@query(
    "write_profiles",
    """select key_set, key, clk, down, round(rate, 6) as rate
       from (select 'app_hour' as key_set, app || '_' || hour as key, cast(count(*) as double) as clk,
                    cast(sum(is_attributed) as double) as down, sum(is_attributed) / count(*)::double as rate
             from clicks group by app, hour
             union all
             select 'app_hour', 'mean', round(sum(n) / count(*)::double, 6), round(sum(d) / count(*)::double, 6),
                    sum(d) / sum(n)::double
             from (select count(*) as n, sum(is_attributed) as d from clicks group by app, hour) where n <= 10000)""",
)
def write_profiles_query(spark: SparkSession, folder: str) -> DataFrame:
    profile = profiles(read_clicks(spark, folder), [("app", "hour")])
    path = new_folder(spark, "profiles")
    write_profiles(profile_file(profile, fallback(profile)), path)
    back = spark.read.parquet(path)
    return back.select("key_set", "key", r(F.col("clk")).alias("clk"), r(F.col("down")).alias("down"), r(F.col("rate")).alias("rate"))


@query(
    "cached_feature",
    "select row_id, count(*) over (partition by ip, app) as ip_app_count from clicks",
)
def cached_feature(spark: SparkSession, folder: str) -> DataFrame:
    clicks = read_clicks(spark, folder)
    store = new_folder(spark, "feature-store")

    def compute(df: DataFrame) -> DataFrame:
        return add_count(df, ["ip", "app"]).select("row_id", "ip_app_count")

    spec = ["count", "ip", "app"]
    writers.cached_feature(clicks, store, "ip_app_count", spec, folder, compute)
    # The second call finds the stored file.
    return writers.cached_feature(clicks, store, "ip_app_count", spec, folder, compute)


MAPPING_SQL = """
select f.supplement_id, a.row_id + 1000000000 as test_id
from clicks a join (
  select ip, app, device, day, min(row_id) as supplement_id from clicks group by ip, app, device, day) f
using (ip, app, device, day)
where a.hour in (4,5,9,10,13,14)"""


def match_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(test, supplement): the test set is part of the supplement, under other ids."""
    clicks = read_clicks(spark, folder)
    test = clicks.filter(F.col("hour").isin(4, 5, 9, 10, 13, 14))
    return (
        test.withColumn("click_id", F.col("row_id") + 1_000_000_000),
        clicks.withColumn("click_id", F.col("row_id")),
    )


@query("write_mapping", MAPPING_SQL)
def write_mapping(spark: SparkSession, folder: str) -> DataFrame:
    test, supplement = match_inputs(spark, folder)
    path = new_folder(spark, "mapping")
    writers.write_mapping(match_consume(test, supplement, ["ip", "app", "device", "day"]), path)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("supplement_id", "test_id")])
    return readers.scan_csv(spark, path, schema, header=False, sep="\t")


@clicks_query(
    "sequence_rows",
    """select row_id, concat_ws(',', ip, app, device, os, channel, day, hour,
              cast(extract(minute from click_time) as int) // 10, hour // 4) as features,
              cast(is_attributed as bigint) as label
       from clicks""",
)
def sequence_rows(clicks: DataFrame) -> DataFrame:
    rows = writers.sequence_rows(clicks)
    return rows.withColumn("features", F.array_join(F.col("features").cast("array<string>"), ","))


def page_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks per key of the events, which stand in for the page table of an ad report."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    pages = events.withColumn("url", F.concat(F.lit("http://host/u?id="), F.col("user_id").cast("string")))
    pages = pages.withColumn("clicks", F.length("event_type"))
    return clicks_by_url(pages, "url", "clicks", ["event_type", "props"], "event_id")


URL_CTE = """
urls as (
  select 'http://host/u?id=' || user_id as url, cast(sum(length(event_type)) as bigint) as clicks,
         arg_max(event_type, event_id) as event_type, arg_max(props, event_id) as props
  from events group by user_id)
"""


@query("clicks_by_url", "select url, clicks, event_type, props from urls", URL_CTE)
def clicks_by_url_query(spark: SparkSession, folder: str) -> DataFrame:
    return page_totals(spark, folder)


@query(
    "rank_by_clicks",
    "select url, clicks, row_number() over (order by clicks desc, url) as rank from urls",
    URL_CTE,
)
def rank_by_clicks_query(spark: SparkSession, folder: str) -> DataFrame:
    return rank_by_clicks(page_totals(spark, folder)).select("url", "clicks", "rank")


@query(
    "ranked_report",
    """select 'No. ' || row_number() over (order by clicks desc, url) || ' | ' || clicks || ' | ' || props
              || ' | ' || substr(url, 1, 80) || ' | '
              || case event_type when 'click' then 'Click' when 'view' then 'View'
                                 when 'purchase' then 'Purchase' else event_type end as line
       from urls""",
    URL_CTE,
)
def ranked_report_query(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rank_by_clicks(page_totals(spark, folder))
    path = new_folder(spark, "report")
    report = ranked_report(ranked, F.col("props"), NAMES, "event_type")
    report.select("line").write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "sort_desc",
    "select url, clicks from urls order by clicks desc, url",
    URL_CTE,
)
def sort_desc(spark: SparkSession, folder: str) -> DataFrame:
    return page_totals(spark, folder).select("url", "clicks").orderBy(F.desc("clicks"), "url")


