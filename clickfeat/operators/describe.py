"""Column summaries and ranked lists."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from clickfeat.functions.encode import map_label, truncate_text
from clickfeat.operators.skew import row_index, running_totals

# Accuracy of the sketches, and how far from a quantile its bracket's ends are aimed.
SKETCH = 4000
BRACKET = 1 / 2000


def describe_basic(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, max and min per column, from one pass and one row; columns without values are left out."""
    measures = {"mean": F.avg, "max": F.max, "min": F.min}
    row = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{name}_{i}") for i, c in enumerate(cols) for name, f in measures.items()]
    )
    each = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in measures])
        for i, c in enumerate(cols)
    ]
    unpivoted = row.select(F.explode(F.array(*each)).alias("p"))
    return unpivoted.select("p.column", *[f"p.{name}" for name in measures]).filter("mean is not null")


@dataclass(frozen=True)
class _Mark:
    """A quantile of one column: its position ``at`` among ``n`` sorted values lies between two known values.

    ``below`` values are smaller than ``low``, ``upto`` not larger, ``under`` smaller than ``high``.  Without values to
    bracket it, ``low`` and ``high`` are None and every value is inside.
    """

    column: int
    name: str
    at: float
    low: float | None
    high: float | None
    below: int
    upto: int
    under: int

    @property
    def positions(self) -> tuple[int, int]:
        return floor(self.at), ceil(self.at)

    def known(self, position: int) -> float | None:
        """The value at a position, if it is an end of the bracket."""
        if self.low is not None and self.below <= position < self.upto:
            return self.low
        return self.high if self.high is not None and position >= self.under else None

    def holds(self, v: Column) -> Column:
        return F.lit(True) if self.low is None else (v > F.lit(self.low)) & (v < F.lit(self.high))


def _marks(df: DataFrame, values: Sequence[Column], probs: Sequence[float], sizes: Sequence[int], sketch: Row) -> list[_Mark]:
    """Brackets from the sketches, counted exactly; one whose counts miss the position is opened to all values."""
    ends = {
        (i, j): (sketch[f"q{i}"][2 * j], sketch[f"q{i}"][2 * j + 1])
        for i, size in enumerate(sizes) if size for j in range(len(probs))
    }
    if not ends:
        return []
    tests = {"below": lambda v, a, b: v < a, "upto": lambda v, a, b: v <= a, "under": lambda v, a, b: v < b, "all": lambda v, a, b: v <= b}
    counted = df.agg(
        *[
            F.count_if(test(values[i], F.lit(low), F.lit(high))).alias(f"{name}_{i}_{j}")
            for (i, j), (low, high) in ends.items() for name, test in tests.items()
        ]
    ).first()
    out = []
    for (i, j), (low, high) in ends.items():
        at = (sizes[i] - 1) * probs[j]
        below, upto, under, last = (counted[f"{name}_{i}_{j}"] for name in tests)
        good = below <= floor(at) and ceil(at) < last
        bracket = (low, high, below, upto, under) if good else (None, None, 0, 0, sizes[i])
        out.append(_Mark(i, f"p{round(probs[j] * 100)}", at, *bracket))
    return out


def _inside(df: DataFrame, values: Sequence[Column], marks: Sequence[_Mark]) -> dict[tuple[int, int], float]:
    """Values at the (mark, position) pairs that lie inside brackets."""
    wanted = {(m, p) for m, mark in enumerate(marks) for p in mark.positions if mark.known(p) is None}
    if not wanted:
        return {}
    open_ = sorted({m for m, _ in wanted})
    hits = F.array(
        *[
            F.when(marks[m].holds(values[marks[m].column]), F.struct(F.lit(m).alias("m"), values[marks[m].column].alias("v")))
            for m in open_
        ]
    )
    # Rows without a value inside a bracket end here; the others give their values inside brackets only.
    kept = df.select(F.array_compact(hits).alias("hits")).filter(F.size("hits") > 0)
    counts = kept.select(F.inline("hits")).filter("v is not null").groupBy("m", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, "v", ["n"], ["m"])
    # One row per column and probability, two at most.
    places = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(p).alias("p"), F.lit(p - marks[m].upto).cast("long").alias("i")) for m, p in sorted(wanted)])
    asked = df.sparkSession.range(1).select(F.inline(places))
    found = ranked.join(F.broadcast(asked), "m").filter((F.col("n_before") <= F.col("i")) & (F.col("i") < F.col("n_before") + F.col("n")))
    return {(r["m"], r["p"]): r["v"] for r in found.select("m", "p", "v").collect()}


def describe_full(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles, max per column; columns without values are left out.

    The quartiles are exact, with linear interpolation, and no row is multiplied by the columns.  One pass takes the
    plain summaries and a sketch of each column, which puts each quartile between two values; the next counts how
    many values lie below them; the last keeps only values strictly between.  Those are a few thousandths of the rows
    whatever the ties, since values equal to an end of a bracket are counted, not kept.
    """
    probs = (0.25, 0.5, 0.75)
    values = [F.col(c).cast("double") for c in cols]
    ends = [min(max(p + side * BRACKET, 0.0), 1.0) for p in probs for side in (-1, 1)]
    plain = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    summary = df.agg(
        *[f(v).alias(f"{name}_{i}") for i, v in enumerate(values) for name, f in plain.items()],
        *[F.percentile_approx(v, ends, SKETCH).alias(f"q{i}") for i, v in enumerate(values)],
    ).first()
    marks = _marks(df, values, probs, [summary[f"count_{i}"] for i in range(len(cols))], summary)
    inside = _inside(df, values, marks)
    quartiles: dict[int, dict[str, float]] = defaultdict(dict)
    for m, mark in enumerate(marks):
        low, high = (inside[m, p] if mark.known(p) is None else mark.known(p) for p in mark.positions)
        part = mark.at - mark.positions[0]
        quartiles[mark.column][mark.name] = low + (high - low) * part if low != high else low
    # One row per column.
    rows = [
        (cols[i], *[summary[f"{name}_{i}"] for name in ("count", "mean", "std", "min")], *own.values(), summary[f"max_{i}"])
        for i, own in quartiles.items()
    ]
    fields = ["mean", "std", "min", *next(iter(quartiles.values()), {f"p{round(p * 100)}": 0 for p in probs}), "max"]
    return df.sparkSession.createDataFrame(rows, "column string, count long, " + ", ".join(f"{f} double" for f in fields))


def feature_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.max(c).alias(c) for c in cols])


def clicks_by_url(df: DataFrame, url: str, clicks: str, attributes: Sequence[str], row: str) -> DataFrame:
    """Sum of clicks per url and the attributes last seen with it."""
    last = F.max_by(F.struct(*attributes), F.col(row))
    grouped = df.groupBy(F.col(url).alias("url")).agg(
        F.sum(clicks).alias("clicks"), last.alias("__last")
    )
    return grouped.select("url", "clicks", *[F.col("__last").getField(a).alias(a) for a in attributes])


def rank_by_clicks(totals: DataFrame, clicks: str = "clicks", tie: str = "url") -> DataFrame:
    """Number items from 1 by clicks, most first."""
    ranked = row_index(totals, [F.desc(clicks), F.asc(tie)], "__i")
    return ranked.withColumn("rank", F.col("__i") + 1).drop("__i")


def ranked_report(ranked: DataFrame, title: Column, names: Mapping[str, str], platform: str) -> DataFrame:
    """One text line per ranked item."""
    line = F.format_string(
        "No. %d | %d | %s | %s | %s",
        F.col("rank"),
        F.col("clicks"),
        title,
        truncate_text(F.col("url")),
        map_label(F.col(platform), names),
    )
    return ranked.select("rank", line.alias("line"))


def top_by_correlation(df: DataFrame, cols: Sequence[str], target: str, k: int) -> DataFrame:
    """The k columns most correlated with the target, by absolute value; one row each."""
    one = df.agg(*[F.abs(F.corr(c, target)).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("strength")) for c in cols])
    # One row per column.
    return one.select(F.inline(pairs)).orderBy(F.desc_nulls_last("strength"), "feature").limit(k)


def feature_union(lists: Sequence[DataFrame]) -> DataFrame:
    """Distinct names over several tables with a ``feature`` column, and how many tables have each."""
    named = [df.select("feature").distinct() for df in lists]
    return reduce(DataFrame.unionByName, named).groupBy("feature").agg(F.count(F.lit(1)).alias("lists"))
