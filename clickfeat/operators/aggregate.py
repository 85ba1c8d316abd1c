"""Per-key measures, as aggregates or window columns, and joining them back onto every click."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfeat.operators.skew import attach_by_key
from clickfeat.session import materialise


def corrected_skewness(n: Column, population: Column) -> Column:
    """Bias-corrected skewness from the population form.

    Null for fewer than three values, 0 for equal values, where the population
    form is null.
    """
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n > 2, F.coalesce(population, F.lit(0.0)) * factor)


def measure(kind: str, value: str | None) -> Column:
    """Aggregate column of one measure kind."""
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "count_nonnull":
        return F.count(F.col(value))
    if kind == "nunique":
        return F.count_distinct(F.col(value))
    if kind == "nunique_approx":
        return F.approx_count_distinct(F.col(value))
    v = F.col(value).cast("double")
    if kind == "mean":
        return F.avg(v)
    if kind == "var":
        return F.var_samp(v)
    if kind == "skew":
        return corrected_skewness(F.count(v).cast("double"), F.skewness(v))
    raise ValueError(f"unknown measure kind {kind!r}")


def add_measures(
    df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[str, str | None]], *, limit: int | None = None
) -> DataFrame:
    """Attach ``{name: (kind, value column)}`` measures of one key set to every row.

    Distinct counts of different columns are computed apart: in one aggregate
    each of them would multiply the shuffled rows.
    """
    keys = list(keys)
    plain = {n: m for n, m in measures.items() if m[0] != "nunique"}
    distinct = {n: m for n, m in measures.items() if m[0] == "nunique"}
    if len(distinct) == 1 and not plain:
        plain, distinct = distinct, {}
    table = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[measure(kind, value).alias(name) for name, (kind, value) in plain.items()],
    )
    for name, (_, value) in distinct.items():
        one = df.groupBy(*keys).agg(F.count_distinct(F.col(value)).alias(name))
        table = table.join(one, keys, "inner")
    return attach_by_key(df, table, keys, "__n", limit=limit)


def weighted_measure(kind: str, value: str | None, weight: str, origin: float | Column = 0.0) -> Column:
    """The same measure over a table of distinct value combinations with their row counts.

    Power sums are taken in doubles around ``origin``.  For a mean any value in the middle of the column does; variance
    and skewness need the mean of the group itself (see ``with_group_means``), else the sums of a narrow group far
    from the origin cancel.
    """
    w = F.col(weight)
    if kind == "count":
        return F.sum(w)
    v = F.col(value).cast("double")
    rows = F.sum(F.when(v.isNotNull(), w).otherwise(0))
    if kind == "count_nonnull":
        return rows
    if kind == "nunique":
        return F.count_distinct(F.col(value))
    origin = origin if isinstance(origin, Column) else F.lit(float(origin))
    v = v - origin
    n, s, ss = rows.cast("double"), F.sum(w * v), F.sum(w * v * v)
    some = F.nullif(n, F.lit(0.0))
    if kind == "mean":
        return s / some + origin
    spread = n * ss - s * s
    if kind == "var":
        return F.when(n > 1, F.greatest(spread, F.lit(0.0)) / F.nullif(n * (n - 1), F.lit(0.0)))
    if kind == "skew":
        mean, second = s / some, spread / (some * some)
        third = F.sum(w * v * v * v) / some - 3 * mean * ss / some + 2 * mean * mean * mean
        population = F.when(second > 0, third / F.pow(F.nullif(second, F.lit(0.0)), F.lit(1.5)))
        return corrected_skewness(n, population)
    raise ValueError(f"unknown measure kind {kind!r}")


def with_group_means(
    base: DataFrame, keys: Sequence[str], values: Mapping[str, float], weight: str, *, small: bool, limit: int | None = None
) -> DataFrame:
    """Add ``__m_<value>``, the mean of the row's group, for each value column (with a value in its middle).

    A first roll-up gives the means; a ``small`` table of them is broadcast, another is joined with salts for groups of
    many combinations.
    """
    means = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__c"),
        *[weighted_measure("mean", c, weight, middle).alias(f"__m_{c}") for c, middle in values.items()],
    )
    if small:
        return base.join(F.broadcast(means.drop("__c")), list(keys), "left")
    mixed = base.withColumn("__mix", F.xxhash64(*base.columns))
    return attach_by_key(mixed, materialise(means), keys, "__c", spread_by="__mix", limit=limit).drop("__mix")


def add_count(df: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    return add_measures(df, keys, {name or f"{'_'.join(keys)}_count": ("count", None)})


def add_count_nonnull(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return add_measures(df, keys, {name: ("count_nonnull", value)})


def add_countuniq(df: DataFrame, keys: Sequence[str], value: str, name: str, approximate: bool = False) -> DataFrame:
    return add_measures(df, keys, {name: ("nunique_approx" if approximate else "nunique", value)})


def add_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return add_measures(df, keys, {name: ("mean", value)})


def add_var(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return add_measures(df, keys, {name: ("var", value)})


def add_skew(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return add_measures(df, keys, {name: ("skew", value)})
