"""Rows as word lists and hashed bags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token prefix and the columns joined behind it.
NAMED_TOKENS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("I", ("ip",)),
    ("A", ("app",)),
    ("D", ("device",)),
    ("O", ("os",)),
    ("C", ("channel",)),
    ("WD", ("day",)),
    ("H", ("hour",)),
    ("AXC", ("app", "channel")),
    ("OXC", ("os", "channel")),
    ("AXD", ("app", "device")),
    ("IXA", ("ip", "app")),
    ("AXO", ("app", "os")),
)
# Prefix and count column of the wider forms.
COUNT_TOKENS: tuple[tuple[str, str], ...] = (
    ("IDHC", "ip_day_hour_count"),
    ("IAC", "ip_app_count"),
    ("AOC", "ip_app_os_count"),
    ("IDC", "ip_device_count"),
    ("AC", "app_channel_count"),
    ("NC", "next_click"),
)
# The further count tokens of the widest form.
MORE_COUNT_TOKENS: tuple[tuple[str, str], ...] = (
    ("IAH", "ip_app_hour_count"),
    ("IAOH", "ip_app_os_hour_count"),
    ("IDH", "ip_device_hour_count"),
    ("ACHH", "app_channel_hour_count"),
    ("IACH", "ip_app_channel_count"),
    ("IACH", "ip_app_channel_hour_count"),
)


def lettered(cols: Sequence[str]) -> Column:
    """A<first> B<second> ...: the column's letter followed by its value."""
    return F.array(
        *[F.concat(F.lit(chr(ord("A") + i)), F.col(c).cast("string")) for i, c in enumerate(cols)]
    )


def named(counts: Sequence[tuple[str, str]] = ()) -> Column:
    """Prefixed tokens of the id columns and their crosses, then those of the listed count columns."""
    parts = [*NAMED_TOKENS, *((prefix, (col,)) for prefix, col in counts)]
    return F.array(
        *[
            F.concat(F.lit(prefix), F.concat_ws("_", *[F.col(c).cast("string") for c in cols]))
            for prefix, cols in parts
        ]
    )


def hash_tokens(df: DataFrame, tokens: str, slots: int = 1 << 20, name: str = "features") -> DataFrame:
    """Binary hashed bag of the tokens as a sparse vector."""
    return HashingTF(inputCol=tokens, outputCol=name, numFeatures=slots, binary=True).transform(df)
