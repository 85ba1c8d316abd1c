"""Time parts of a click."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def time_parts(df: DataFrame, time: str = "click_time") -> DataFrame:
    return df.withColumns(
        {"day": F.dayofmonth(time).cast("int"), "hour": F.hour(time).cast("int")}
    )


def weekday(time: str = "click_time") -> Column:
    """Monday is 0."""
    return F.weekday(time).cast("int")


def hour_bin(hour: str = "hour", width: int = 4) -> Column:
    return F.floor(F.col(hour) / F.lit(width)).cast("int")


def minute_bin(time: str = "click_time", width: int = 15) -> Column:
    return F.floor(F.minute(time) / F.lit(width)).cast("int")


def parse_datetime(text: str) -> dict[str, Column]:
    """Integer parts of ``y-m-d h:m:s`` text."""
    t = F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss")
    return {
        "year": F.year(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "hour": F.hour(t),
        "minute": F.minute(t),
        "second": F.second(t),
    }


def epoch_seconds(time: str = "click_time") -> Column:
    return F.unix_timestamp(time)


def gap_seconds(later: Column, earlier: Column, wrap_day: bool = True) -> Column:
    """Seconds between two epoch-second columns; by default only the part below one day (0..86399)."""
    gap = later - earlier
    return F.pmod(gap, F.lit(DAY_SECONDS)).cast("long") if wrap_day else gap.cast("long")
