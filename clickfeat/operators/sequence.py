"""Order-dependent columns: gaps to the neighbouring clicks, running counts, shifted rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfeat.functions.timeparts import epoch_seconds, gap_seconds
from clickfeat.operators.skew import neighbours, sliced_neighbours

# Fixed value: the far-future epoch second used when there is no next click.
NO_NEXT_CLICK = 3_000_000_000


def gap_name(keys: Sequence[str], suffix: str) -> str:
    return f"{'_'.join(keys)}_{suffix}"


def sequence_columns(names: Mapping[str, str | None], now: Column, wrap_day: bool, place: str = "") -> dict[str, Column]:
    """Columns by name from the neighbours of key set ``place``."""
    before, behind = F.col(f"__prev{place}"), F.col(f"__next{place}")
    made = {
        "next_name": gap_seconds(behind, now, wrap_day),
        "prev_name": gap_seconds(now, before, wrap_day),
        "next_epoch_name": F.coalesce(behind, F.lit(NO_NEXT_CLICK)) - now,
        "cumcount_name": F.col(f"__pos{place}"),
    }
    return {name: made[kind] for kind, name in names.items() if name}


def add_sliced_sequences(
    df: DataFrame,
    wanted: Sequence[tuple[Sequence[str], Mapping[str, str]]],
    *,
    time: str = "click_time",
    row: str = "row_id",
    wrap_day: bool = True,
    source: DataFrame | None = None,
) -> DataFrame:
    """Sequence columns of many key sets from one pass over the clicks in row-number ranges.

    ``wanted`` has key sets with the arguments of ``add_sequence`` that name their columns.
    """
    now = epoch_seconds(time)
    near = sliced_neighbours(df, [keys for keys, _ in wanted], now, row=row, source=source)
    added: dict[str, Column] = {}
    for i, (_, names) in enumerate(wanted):
        added |= sequence_columns(names, now, wrap_day, str(i))
    return near.select(*df.columns, *[c.alias(name) for name, c in added.items()])


def add_sequence(
    df: DataFrame,
    keys: Sequence[str],
    *,
    next_name: str | None = None,
    prev_name: str | None = None,
    next_epoch_name: str | None = None,
    cumcount_name: str | None = None,
    time: str = "click_time",
    row: str = "row_id",
    wrap_day: bool = True,
    limit: int | None = None,
    skewed: bool | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """All sequence columns of one key set from one pass over the ordered clicks."""
    # A running count needs no time column.
    timed = next_name or prev_name or next_epoch_name
    now = epoch_seconds(time) if timed else F.lit(0)
    near = neighbours(df, keys, now, row=row, limit=limit, skewed=skewed, source=source)
    names = {"next_name": next_name, "prev_name": prev_name, "next_epoch_name": next_epoch_name, "cumcount_name": cumcount_name}
    added = sequence_columns(names, now, wrap_day)
    return near.select(*df.columns, *[c.alias(name) for name, c in added.items()])


def next_click(df: DataFrame, keys: Sequence[str], name: str | None = None, **options) -> DataFrame:
    """Seconds to the next click of the key; null on its last click."""
    return add_sequence(df, keys, next_name=name or gap_name(keys, "nextClick"), **options)


def prev_click(df: DataFrame, keys: Sequence[str], name: str | None = None, **options) -> DataFrame:
    """Seconds since the previous click of the key; null on its first click."""
    return add_sequence(df, keys, prev_name=name or gap_name(keys, "prevClick"), **options)


def next_click_epoch(df: DataFrame, keys: Sequence[str], name: str = "next_click", **options) -> DataFrame:
    """Total seconds to the next click; the last click of a key counts to a far-future second."""
    return add_sequence(df, keys, next_epoch_name=name, **options)


def cumcount(df: DataFrame, keys: Sequence[str], name: str, **options) -> DataFrame:
    """0-based running number of a click within its key."""
    return add_sequence(df, keys, cumcount_name=name, **options)


def shift_rows(df: DataFrame, cols: Sequence[str], suffix: str = "_shift", row: str = "row_id") -> DataFrame:
    """The previous row's values over the whole table, without one global window."""
    near = neighbours(df, [], F.struct(*cols), row=row, skewed=True)
    return near.select(
        *df.columns, *[F.col("__prev").getField(c).alias(f"{c}{suffix}") for c in cols]
    )
