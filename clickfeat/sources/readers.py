"""Scans: typed files, row ranges, chunks, several files in order, tolerant text, JDBC, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfeat.schema import PROFILE_FILE
from clickfeat.session import broadcast_rows, materialise

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def clicks_from_events(events: DataFrame) -> DataFrame:
    """Click log in the columns of this package, made from the ``events`` table.

    ``event_id`` is contiguous and in time order, so it is the row number.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    app = (
        F.when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "error", 2)
        .when(F.col("event_type") == "purchase", 3)
        .when(F.col("event_type") == "signup", 4)
        .otherwise(5)
    )
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("ip"),
        app.cast("int").alias("app"),
        (k % 3).cast("int").alias("device"),
        (F.col("event_id") % 5).cast("int").alias("os"),
        (k % 20).cast("int").alias("channel"),
        F.date_trunc("second", "ts").alias("click_time"),
        F.dayofmonth("ts").cast("int").alias("day"),
        F.hour("ts").cast("int").alias("hour"),
        F.when(F.col("value") >= 100, 1).otherwise(0).cast("int").alias("is_attributed"),
    )


def read_clicks(spark: SparkSession, folder: str) -> DataFrame:
    return clicks_from_events(spark.read.parquet(f"{folder}/events.parquet"))


def scan_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    columns: Sequence[str] | None = None,
    *,
    header: bool = True,
    sep: str = ",",
) -> DataFrame:
    """Typed CSV scan; the column list is pruned inside the CSV reader."""
    df = spark.read.csv(
        paths if isinstance(paths, str) else list(paths),
        schema=schema,
        header=header,
        sep=sep,
        timestampFormat=TIME_FORMAT,
        mode="FAILFAST",
    )
    return df.select(*columns) if columns else df


def scan_many(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, columns: Sequence[str] | None = None
) -> DataFrame:
    """Several files of one schema; ``file_ord`` keeps the order they were given in."""
    parts = [
        scan_csv(spark, path, schema, columns).withColumn("file_ord", F.lit(i))
        for i, path in enumerate(paths)
    ]
    return reduce(DataFrame.unionByName, parts)


def scan_tolerant(
    spark: SparkSession, path: str, schema: T.StructType, *, header: bool = False, min_length: int = 3
) -> DataFrame:
    """CSV scan that drops lines shorter than ``min_length`` or with the wrong number of fields.

    A bad value in a well-formed line is kept as null, as text readers without types do.
    """
    lines = spark.read.text(path)
    if header:
        names = ",".join(schema.fieldNames())
        lines = lines.filter(F.col("value") != names)
    fields = F.split("value", ",", -1)
    good = lines.filter(
        (F.length(F.trim("value")) >= min_length) & (F.size(fields) == len(schema.fields))
    )
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("value", ddl, {"timestampFormat": TIME_FORMAT})
    return good.select(parsed.alias("r")).select("r.*")


def with_file_positions(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the position of each row in a table whose files, in the order of their paths, are in order already.

    ``df`` is a scan of Parquet files.  A row's place in its file comes with the scan and the files' offsets are sums of
    their counts, one row per file: no sort, no exchange of rows and no copy of the table.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    sizes = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    # One row per file.
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    few = starts.count() <= broadcast_rows(df.sparkSession)
    joined = placed.join(F.broadcast(starts) if few else starts, "__file")
    return joined.select(*df.columns, (F.col("__start") + F.col("__place")).cast("long").alias(name))


def row_range(df: DataFrame, start: int, length: int | None = None, row: str = "row_id") -> DataFrame:
    """Rows ``start`` to ``start + length - 1``; a plain range filter, so it reaches the scan."""
    kept = df.filter(F.col(row) >= start)
    return kept if length is None else kept.filter(F.col(row) < start + length)


def tail_range(df: DataFrame, length: int, row: str = "row_id") -> DataFrame:
    """The last ``length`` rows."""
    total = df.agg(F.max(row) + 1).scalar()
    return df.filter(F.col(row) >= total - F.lit(length))


def with_chunk(df: DataFrame, size: int, row: str = "row_id") -> DataFrame:
    """Add ``chunk_id``, the block of ``size`` rows a row is in, to use as a leading group key."""
    return df.withColumn("chunk_id", F.floor(F.col(row) / F.lit(size)).cast("long"))


def scan_profiles(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Headerless profile file: key text and five positional numbers."""
    return scan_csv(spark, path, PROFILE_FILE, columns, header=False)


def jdbc_filter(**equal: object) -> str:
    """``a = 'x' AND b = 1`` with quotes in values doubled."""
    def literal(value: object) -> str:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return str(value)
        return "'" + str(value).replace("'", "''") + "'"

    for name in equal:
        if not name.isidentifier():
            raise ValueError(f"not a column name: {name!r}")
    return " AND ".join(f"{name} = {literal(value)}" for name, value in equal.items())


def scan_jdbc(spark: SparkSession, table: str, options: dict[str, str], **equal: object) -> DataFrame:
    """Database table filtered by column values; the filter runs in the database.

    ``options`` holds the url, driver, user and password, and for large tables
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    df = reader.load()
    return df.filter(jdbc_filter(**equal)) if equal else df
