"""Registry of runnable operators, each with the SQL its result can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.sources.readers import read_clicks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The click log and a table of three model scores, over the whole events table.
CLICKS_SQL = """
clicks as (
  select event_id as row_id,
         user_id as ip,
         cast(case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
                              when 'signup' then 4 else 5 end as int) as app,
         cast(cast(regexp_extract(props,'([0-9]+)',1) as int) % 3 as int) as device,
         cast(event_id % 5 as int) as os,
         cast(cast(regexp_extract(props,'([0-9]+)',1) as int) % 20 as int) as channel,
         date_trunc('second', ts) as click_time,
         cast(extract(day from ts) as int) as day,
         cast(extract(hour from ts) as int) as hour,
         cast(case when value >= 100 then 1 else 0 end as int) as is_attributed
  from events),
t as (select *, cast(epoch(click_time) as bigint) as s from clicks),
preds as (
  select event_id as click_id,
         cast(case when value >= 100 then 1 else 0 end as int) as is_attributed,
         extract(hour from ts) / 24.0::double as p_hour,
         (cast(regexp_extract(props,'([0-9]+)',1) as int) % 20) / 20.0::double as p_channel,
         least(value / 500.0::double, 1.0::double) as p_value
  from events)
"""


def with_views(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([CLICKS_SQL, *ctes]) + "\n" + body


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query; ``sql`` may use the views ``clicks``, ``t`` and ``preds``."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Hours and epoch seconds of the log are UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *ctes)
        return fn

    return register


def clicks_query(name: str, sql: str | None = None, *ctes: str):
    """Register a query over the click log."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        query(name, sql, *ctes)(lambda spark, folder: fn(read_clicks(spark, folder)))
        return fn

    return register


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select(
        F.col("event_id").alias("click_id"),
        F.when(F.col("value") >= 100, 1).otherwise(0).cast("int").alias("is_attributed"),
        (F.hour("ts") / F.lit(24.0)).alias("p_hour"),
        ((k % 20) / F.lit(20.0)).alias("p_channel"),
        F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("p_value"),
    )


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def r(col: Column, digits: int = 6) -> Column:
    return F.round(col.cast("double"), digits)
