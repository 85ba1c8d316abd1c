"""Encoders: logs, scaling, bins, rounding, weights, keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfeat.functions.edges import CLICK_EDGES, DOWNLOAD_EDGES

# Hours kept as validation and test hours.
TEST_HOURS = (4, 5, 9, 10, 13, 14)
# Hours with full row weight.
WEIGHT_HOURS = (4, 5, 10, 13, 14)
# Fixed value: largest click total, as scaled by log10.
CLICK_MAX = 306_495


def click_edges() -> list[float]:
    """1,020 click bin edges; another list is a parameter of ``bin_edges``."""
    return [float(e) for e in CLICK_EDGES]


def download_edges() -> list[float]:
    """235 download bin edges."""
    return [float(e) for e in DOWNLOAD_EDGES]


def combo_key(*cols: str) -> Column:
    """Values joined by ``_``; null if any of them is null, so that different keys stay different."""
    parts = [F.col(c).cast("string") for c in cols]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("_"), part)
    return joined


def hash_bucket(*cols: str, slots: int = 1 << 26) -> Column:
    """Reproducible hash of the key columns into ``slots`` buckets."""
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("long")


def narrow_wrap(col: Column | str, bits: int) -> Column:
    """Value an unsigned integer of ``bits`` bits would hold."""
    value = F.col(col) if isinstance(col, str) else col
    return F.pmod(value.cast("long"), F.lit(1 << bits)).cast("long")


def log2_int(col: Column) -> Column:
    return F.floor(F.log2(col + F.lit(1))).cast("int")


def log10_1p(col: Column) -> Column:
    return F.log10(col + F.lit(1))


def log10_scaled(col: Column, top: Column | int) -> Column:
    """``log10(1+x) / log10(1+top)``."""
    top = F.lit(top) if isinstance(top, int) else top
    return F.log10(col + F.lit(1)) / F.log10(top + F.lit(1))


def loglog(col: Column) -> Column:
    return F.log(F.log(col + F.lit(1)) + F.lit(1))


def inverse_log10(col: Column) -> Column:
    """Whole part of ``10**x - 1``."""
    return (F.pow(F.lit(10.0), col) - 1).cast("long")


def null_to_zero(col: Column) -> Column:
    value = col.cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def trimmed_text(col: Column, digits: int = 4) -> Column:
    """Fixed-point text without trailing zeros."""
    text = F.format_string(f"%.{digits}f", col.cast("double"))
    return F.when(col == 0, F.lit("0")).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def zscore(df: DataFrame, cols: Sequence[str], constants: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``<c>_z``.  Without constants, mean and standard deviation come from the table."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]
    )
    added = {}
    for c in cols:
        if constants and c in constants:
            mean, std = (F.lit(float(v)) for v in constants[c])
        else:
            mean, std = stats.select(f"m_{c}").scalar(), stats.select(f"s_{c}").scalar()
        added[f"{c}_z"] = (F.col(c) - mean) / F.nullif(std, F.lit(0.0))
    return df.withColumns(added)


def min_max(df: DataFrame, cols: Sequence[str], constants: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``<c>_mm`` in 0..1; null where the column is constant."""
    stats = df.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in cols],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in cols],
    )
    added = {}
    for c in cols:
        if constants and c in constants:
            low, high = (F.lit(float(v)) for v in constants[c])
        else:
            low, high = stats.select(f"lo_{c}").scalar(), stats.select(f"hi_{c}").scalar()
        added[f"{c}_mm"] = (F.col(c) - low) / F.nullif(high - low, F.lit(0.0))
    return df.withColumns(added)


def bin_edges(df: DataFrame, col: str, edges: Sequence[float], name: str) -> DataFrame:
    """Index of the first edge >= x, or the number of edges past the end.

    ``Bucketizer`` searches ranges closed on the left; on negated values they
    are closed on the right, which is the tie rule wanted here.
    """
    ordered = sorted(set(float(e) for e in edges))
    cuts = [float("-inf"), *(-e for e in reversed(ordered)), float("inf")]
    negated = df.withColumn("__x", -F.col(col).cast("double"))
    bucketed = Bucketizer(splits=cuts, inputCol="__x", outputCol="__k").transform(negated)
    index = (F.lit(len(ordered)) - F.col("__k")).cast("int")
    return bucketed.select(*df.columns, index.alias(name))


def shares(counts: Iterable[str], total: str) -> dict[str, Column]:
    """Each bucket count divided by the total."""
    return {f"{c}_share": F.col(c) / F.nullif(F.col(total), F.lit(0)) for c in counts}


def entropy(counts: Sequence[Column], total: Column, legacy: bool = False) -> Column:
    """``-sum p ln p`` over non-empty buckets, in nats; ``legacy`` keeps only the last term."""
    terms = []
    for count in counts:
        p = count / F.nullif(total, F.lit(0))
        terms.append(F.when(count > 0, -p * F.log(p)))
    if legacy:
        return F.coalesce(*reversed(terms), F.lit(0.0))
    result = F.lit(0.0)
    for term in terms:
        result = result + F.coalesce(term, F.lit(0.0))
    return result


def row_weight(label: str = "is_attributed", hour: str = "hour", hours: Sequence[int] = WEIGHT_HOURS) -> Column:
    """1.0 / 0.2 by label times 1.0 / 0.5 by hour; 1 where there is no label."""
    by_label = F.when(F.col(label) == 1, 1.0).otherwise(0.2)
    by_hour = F.when(F.col(hour).isin(*hours), 1.0).otherwise(0.5)
    return F.when(F.col(label).isNull(), 1.0).otherwise(by_label * by_hour)


def select_id(click_id: str = "click_id", label: str = "is_attributed") -> Column:
    """``click_id`` of test rows, the label of training rows."""
    return F.coalesce(F.col(click_id).cast("long"), F.col(label).cast("long"))


def map_label(col: Column, names: Mapping[str, str]) -> Column:
    """Display name of a code, by default the code itself."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def truncate_text(col: Column, length: int = 80) -> Column:
    return F.substring(col, 1, length)


def clip(col: Column, low: float = 1.0, high: float = 3.0) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def select_blocks(df: DataFrame, head: Sequence[str], blocks: int, keep: Sequence[str], drop: Sequence[int] = ()) -> DataFrame:
    """Keep ``<field>_<block>`` columns of the listed fields for every block not dropped."""
    kept = [f"{f}_{b}" for b in range(blocks) if b not in set(drop) for f in keep]
    return df.select(*head, *kept)


def group_fields(df: DataFrame, head: Sequence[str], blocks: int, fields: Sequence[str]) -> DataFrame:
    """Reorder block-wise columns so that all columns of one field stand together."""
    return df.select(*head, *[f"{f}_{b}" for f in fields for b in range(blocks)])
