"""Joins, running positions and running totals that hold up when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfeat.session import broadcast_rows, dealt, hot_rows, materialise, slice_rows, task_rows

# Rows are spread over this many equal ranges of a 64-bit hash when an exact
# rank in hash order is needed.  It bounds the offset table (rows per group).
HASH_BUCKETS_LOG2 = 16
# Bits of the hash that random orders follow.
HASH_BITS = 60


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def largest_group(df: DataFrame, keys: Sequence[str], weight: str | None = None) -> int:
    """Rows of the biggest key.  One pass over the key columns, pre-aggregated map-side.

    ``weight`` names a column of row counts if ``df`` is already counted.
    """
    if not keys:
        return df.count()
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys).agg(rows.alias("__n")).agg(F.max("__n")).first()[0] or 0


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the biggest key, and all rows, from one pass."""
    row = key_counts(df, keys).agg(F.max("__n"), F.sum("__n")).first()
    return row[0] or 0, row[1] or 0


def is_skewed(
    df: DataFrame, keys: Sequence[str], limit: int | None = None, weight: str | None = None
) -> bool:
    return largest_group(df, keys, weight) > hot_rows(df.sparkSession, limit)


def attach_by_key(
    df: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    counts: DataFrame | str | None = None,
    *,
    spread_by: str = "row_id",
    limit: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Join one-row-per-key ``dim`` onto ``df``.

    ``counts`` tells how many rows of ``df`` each key has: the name of a column
    of ``dim``, a table with the keys and ``__n``, or nothing, and then they are
    counted.  A key above the limit is hot: its rows get a salt and its ``dim``
    row is repeated once per salt.  There are at most rows/limit hot keys, so
    that list is the only thing broadcast by hint.
    """
    keys = list(keys)
    limit = hot_rows(df.sparkSession, limit)
    salts_of = F.ceil(F.col("__n") / F.lit(limit)).cast("int")
    if isinstance(counts, str):
        sized = dim.withColumnRenamed(counts, "__n")
        hot = sized.filter(F.col("__n") > limit).select(*keys, salts_of.alias("__salts"))
        right = sized.withColumn("__salts", salts_of).drop("__n")
    else:
        counts = key_counts(df, keys) if counts is None else counts
        hot = counts.filter(F.col("__n") > limit).select(*keys, salts_of.alias("__salts"))
        right = dim.join(F.broadcast(hot), keys, "left")
    salts = F.coalesce(F.greatest(F.col("__salts"), F.lit(1)), F.lit(1))
    left = df.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(F.col(spread_by)), salts).cast("int")
    )
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return (
        left.drop("__salts")
        .join(right.drop("__salts"), [*keys, "__salt"], how)
        .drop("__salt")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return left.join(renamed, match, how).drop(*[f"__k_{k}" for k in keys])


def _with_slice(df: DataFrame, hot: DataFrame | None, keys: list[str], row: str) -> DataFrame:
    """Add ``__hot`` and ``__slice``; only hot keys get more than one slice."""
    width = slice_rows(df.sparkSession)
    ranged = F.floor(F.col(row) / F.lit(width)).cast("long")
    if hot is None:
        return df.withColumns({"__hot": F.lit(True), "__slice": ranged})
    flagged = df.join(F.broadcast(hot), keys, "left")
    return flagged.withColumn("__slice", F.when(F.col("__hot"), ranged).otherwise(F.lit(0)))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    *,
    row: str = "row_id",
    limit: int | None = None,
    skewed: bool | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``__prev`` and ``__next`` (the value on the rows before and after within the key,
    in row order) and ``__pos`` (0-based position within the key).

    With no key above the limit this is one window.  Otherwise hot keys are cut
    into row-number slices of bounded length; the windows run per slice, and the
    slice edges are stitched from a summary of one row per (hot key, slice).
    ``source``, when given, has the same rows as ``df`` and fewer columns; counts
    and the summary are taken from it, so that chained calls do not recompute
    each other.
    """
    keys = list(keys)
    source = df if source is None else source
    limit = hot_rows(df.sparkSession, limit)
    if skewed is None:
        skewed = is_skewed(source, keys, limit)
    if not skewed and keys:
        w = Window.partitionBy(*keys).orderBy(row)
        return df.withColumn("__v", value).select(
            *df.columns,
            F.lag("__v").over(w).alias("__prev"),
            F.lead("__v").over(w).alias("__next"),
            (F.row_number().over(w) - 1).cast("long").alias("__pos"),
        )
    # The struct tells "no row there" (null struct) from "a row with a null value".
    boxed = F.struct(value.alias("x"))
    hot = None
    if keys:
        # At most rows/limit keys.
        over = key_counts(source, keys).filter(F.col("__n") > limit)
        hot = materialise(over.select(*keys, F.lit(True).alias("__hot")))
    cut = _with_slice(df, hot, keys, row).withColumn("__v", boxed)
    narrow = _with_slice(source, hot, keys, row).withColumn("__v", boxed)
    group = [*keys, "__slice"]
    w = Window.partitionBy(*group).orderBy(row)
    inside = cut.select(
        *df.columns,
        "__slice",
        F.lag("__v").over(w).alias("__prev"),
        F.lead("__v").over(w).alias("__next"),
        (F.row_number().over(w) - 1).cast("long").alias("__pos"),
    )
    summary = (
        narrow.filter(F.col("__hot"))
        .groupBy(*group)
        .agg(
            F.min_by("__v", row).alias("__first"),
            F.max_by("__v", row).alias("__last"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    # One row per (hot key, slice): at most rows/slice_rows rows per key.
    across = Window.partitionBy(*keys).orderBy("__slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = materialise(
        summary.select(
            *group,
            F.lag("__last").over(across).alias("__edge_prev"),
            F.lead("__first").over(across).alias("__edge_next"),
            F.sum("__n").over(before).alias("__offset"),
        )
    )
    joined = inside.join(edges, group, "left")
    return joined.select(
        *df.columns,
        F.coalesce("__prev", "__edge_prev").getField("x").alias("__prev"),
        F.coalesce("__next", "__edge_next").getField("x").alias("__next"),
        (F.col("__pos") + F.coalesce("__offset", F.lit(0))).alias("__pos"),
    )


def sliced_neighbours(
    df: DataFrame, key_sets: Sequence[Sequence[str]], value: Column, *, row: str = "row_id", source: DataFrame | None = None
) -> DataFrame:
    """``neighbours`` for many key sets of few and large keys: adds ``__prev<i>``, ``__next<i>``, ``__pos<i>`` for set i.

    Rows are dealt by row-number range once, whatever the keys; the windows of every set run inside a range and need no
    further exchange.  What lies before and after a range comes from a summary of one row per (set, key, range), made
    from the narrow ``source`` in the same way and put in order by one exchange for all sets.
    """
    source = df if source is None else source
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (source.agg(F.max(row)).first()[0] or 0) + 1
    width = max(1, min(slice_rows(spark), task_rows(spark), -(-rows // (2 * parts))))
    boxed = F.struct(value.alias("x"))
    place = F.floor(F.col(row) / F.lit(width)).cast("long")
    columns = sorted({c for keys in key_sets for c in keys})
    narrow = source.select(row, *columns, place.alias("__slice"), boxed.alias("__v")).repartition("__slice")
    types = dict(source.select(*columns).dtypes)
    summaries = [
        narrow.groupBy("__slice", *keys)
        .agg(F.min_by("__v", row).alias("__first"), F.max_by("__v", row).alias("__last"), F.count(F.lit(1)).alias("__n"))
        .select(
            F.lit(i).alias("__set"),
            *[(F.col(c) if c in keys else F.lit(None).cast(types[c])).alias(c) for c in columns],
            "__slice", "__first", "__last", "__n",
        )
        for i, keys in enumerate(key_sets)
    ]
    across = Window.partitionBy("__set", *columns).orderBy("__slice")
    edges = materialise(
        reduce(DataFrame.unionAll, summaries).select(
            "__set", *columns, "__slice",
            F.lag("__last").over(across).alias("__before"),
            F.lead("__first").over(across).alias("__behind"),
            F.sum("__n").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("__offset"),
        )
    )
    # One row per set.
    sizes = {r["__set"]: r["count"] for r in edges.groupBy("__set").count().collect()}
    out = dealt(df.withColumns({"__slice": place, "__v": boxed}), rows, "__slice")
    for i, keys in enumerate(key_sets):
        w = Window.partitionBy("__slice", *keys).orderBy(row)
        out = out.withColumns(
            {f"__prev{i}": F.lag("__v").over(w), f"__next{i}": F.lead("__v").over(w), f"__pos{i}": F.row_number().over(w) - 1}
        )
    # All sets of which the summaries are small together go by broadcast; the others by key and range.
    held, most = 0, broadcast_rows(spark)
    for i in sorted(range(len(key_sets)), key=lambda i: (sizes.get(i, 0), i)):
        held += sizes.get(i, 0)
        own = edges.filter(F.col("__set") == i).select(*key_sets[i], "__slice", "__before", "__behind", "__offset")
        out = out.join(F.broadcast(own) if held <= most else own, [*key_sets[i], "__slice"], "left").withColumns(
            {
                f"__prev{i}": F.coalesce(f"__prev{i}", "__before").getField("x"),
                f"__next{i}": F.coalesce(f"__next{i}", "__behind").getField("x"),
                f"__pos{i}": (F.col(f"__pos{i}") + F.coalesce("__offset", F.lit(0))).cast("long"),
            }
        ).drop("__before", "__behind", "__offset")
    return out.select(*df.columns, *[f"{p}{i}" for i in range(len(key_sets)) for p in ("__prev", "__next", "__pos")])


def seeded_hash(seed: int, col: Column) -> Column:
    """Non-negative 60-bit number from the MD5 of ``seed|value``: any SQL engine can repeat the order it gives."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), col.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_bucket_columns(df: DataFrame, row: str, seed: int) -> DataFrame:
    """Add ``__h`` (``seeded_hash`` of the row id) and ``__b`` (its leading bits)."""
    return df.withColumn("__h", seeded_hash(seed, F.col(row))).withColumn(
        "__b", F.shiftright("__h", HASH_BITS - HASH_BUCKETS_LOG2)
    )


def hash_offsets(bucketed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (group, hash bucket): rows, rows in earlier buckets, rows of the group."""
    by = list(by)
    counts = bucketed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    # At most 2**HASH_BUCKETS_LOG2 rows per group.
    w = Window.partitionBy(*by).orderBy("__b")
    return counts.select(
        *by,
        "__b",
        "__n",
        F.coalesce(
            F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__total"),
    )


def hash_position(
    df: DataFrame, seed: int, *, by: Sequence[str] = (), row: str = "row_id", name: str = "pos"
) -> DataFrame:
    """Add the exact 0-based rank of each row in seeded hash order, within ``by``."""
    by = list(by)
    bucketed = hash_bucket_columns(df, row, seed)
    w = Window.partitionBy(*by, "__b").orderBy("__h", row)
    ranked = bucketed.withColumn("__rn", F.row_number().over(w) - 1)
    offsets = hash_offsets(bucketed, by).select(*by, "__b", "__offset")
    joined = null_safe_join(ranked, offsets, [*by, "__b"])
    return joined.select(
        *df.columns, (F.col("__offset") + F.col("__rn")).cast("long").alias(name)
    )


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """Number rows 0..n-1 in the given order, which must be total for a stable result.

    A range shuffle on the whole order key splits ties too, so no partition is
    hot.  Range bounds come from sampling, so the sorted table is checkpointed
    to the shared folder before it is read twice (sizes, then rows).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialise(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    mono = F.monotonically_increasing_id()
    tagged = ordered.withColumn("__m", mono).select(
        "*",
        F.shiftright("__m", 33).alias("__p"),
        F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)).alias("__i"),
    )
    sizes = tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # One row per shuffle partition.
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    return tagged.join(F.broadcast(starts), "__p").select(
        *df.columns, (F.col("__start") + F.col("__i")).cast("long").alias(name)
    )


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), ready: bool = False
) -> DataFrame:
    """Add ``<c>_before``: the sum of c over rows of the group with a smaller order value.

    ``df`` has one row per (group, order value).  Values are cut into ranges of
    about equal row count, so the running sum needs neither a global sort nor a
    single task; the range totals are a table of at most one row per range.
    The input is read several times and is therefore written first, unless it
    is ``ready`` (a stored table).
    """
    by = list(by)
    df = df if ready else materialise(df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / parts for i in range(1, parts)]
    # The error shrinks with the number of ranges: at most a quarter of one.
    bounds = sorted(set(df.approxQuantile(order, probs, 1 / (4 * parts)))) if probs else []
    if bounds:
        cuts = [float("-inf"), *bounds, float("inf")]
        bucketed = Bucketizer(splits=cuts, inputCol=order, outputCol="__r").transform(df)
    else:
        bucketed = df.withColumn("__r", F.lit(0.0))
    inside = Window.partitionBy(*by, "__r").orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*by, "__r").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    starts = totals.select(
        *by, "__r", *[F.coalesce(F.sum(f"__t_{c}").over(across), F.lit(0)).alias(f"__s_{c}") for c in sums]
    )
    ranked = bucketed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__w_{c}") for c in sums]
    )
    return null_safe_join(ranked, starts, [*by, "__r"]).select(
        *df.columns, *[(F.col(f"__w_{c}") + F.col(f"__s_{c}")).alias(f"{c}_before") for c in sums]
    )
