"""Declared schemas and the fixed lists of key sets."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_BASE = (
    ("ip", T.LongType()),
    ("app", T.IntegerType()),
    ("device", T.IntegerType()),
    ("os", T.IntegerType()),
    ("channel", T.IntegerType()),
    ("click_time", T.TimestampType()),
)

TRAIN_LOG = _struct(
    *_BASE, ("attributed_time", T.TimestampType()), ("is_attributed", T.IntegerType())
)
TEST_LOG = _struct(("click_id", T.LongType()), *_BASE)

# Headerless profile file: key text, then positional numbers.
PROFILE_FILE = _struct(
    ("key", T.StringType()),
    ("clk", T.DoubleType()),
    ("down", T.DoubleType()),
    ("rate", T.DoubleType()),
    ("entropy_6", T.DoubleType()),
    ("entropy_4", T.DoubleType()),
)

# The 24 counted key sets, in their order.
PROFILE_KEY_SETS: tuple[tuple[str, ...], ...] = (
    ("ip",),
    ("app",),
    ("os",),
    ("device",),
    ("channel",),
    ("ip", "app"),
    ("ip", "app", "hour"),
    ("ip", "os"),
    ("ip", "device"),
    ("ip", "channel"),
    ("app", "os"),
    ("app", "os", "hour"),
    ("app", "device"),
    ("app", "device", "hour"),
    ("app", "channel"),
    ("app", "channel", "hour"),
    ("os", "device"),
    ("os", "device", "hour"),
    ("device", "channel"),
    ("ip", "app", "os"),
    ("ip", "app", "device"),
    ("ip", "app", "channel"),
    ("app", "os", "device"),
    ("app", "device", "channel"),
)

# The 15 looked-up key sets, numbered 1..15 in this order.
LOOKUP_KEY_SETS: tuple[tuple[str, ...], ...] = (
    ("app",),
    ("ip",),
    ("os",),
    ("device",),
    ("channel",),
    ("app", "os", "hour"),
    ("app", "os"),
    ("app", "device", "hour"),
    ("app", "device"),
    ("app", "channel", "hour"),
    ("app", "channel"),
    ("ip", "app", "hour"),
    ("ip", "app"),
    ("os", "device", "hour"),
    ("os", "device"),
)
