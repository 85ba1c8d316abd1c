"""Turning a list of feature specs into one plan with few shuffles.

Key sets that contain the anchor (normally ``ip``) can all be computed once the
clicks are partitioned by the anchor: a window partitioned by (ip, app) needs no
shuffle on data already partitioned by ip.  So they share one shuffle, and key
sets that nest share one sort.  Clicks of anchors with more rows than the hot
limit do not take that road; for them every key set is aggregated and joined
back with salts, and sequences run over row-number slices.

Key sets without the anchor have few keys and huge groups: they are aggregated
(map-side first) and joined back, which adaptive execution turns into broadcast
joins when the group table is small, and their sequences share one exchange by
row-number range.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfeat.functions.timeparts import epoch_seconds, gap_seconds
from clickfeat.operators.aggregate import corrected_skewness, weighted_measure, with_group_means
from clickfeat.operators.sequence import NO_NEXT_CLICK, add_sequence, add_sliced_sequences
from clickfeat.operators.skew import attach_by_key, group_sizes, key_counts
from clickfeat.plans.specs import SEQUENCE_KINDS, FeatureSpec
from clickfeat.session import broadcast_rows, dealt, hot_rows, materialise

# (partition columns as a set, ordering columns behind them)
Layout = tuple[frozenset[str], tuple[str, ...]]


def layout_of(spec: FeatureSpec, row: str) -> Layout:
    """Sort layout a spec's window needs inside an anchor partition."""
    if spec.kind in SEQUENCE_KINDS:
        return frozenset(spec.keys), (row,)
    if spec.kind == "nunique":
        return frozenset(spec.keys), (spec.value,)
    return frozenset(spec.keys), ()


def _prefix_sets(layout: Layout) -> list[frozenset[str]]:
    keys, order = layout
    return [keys | frozenset(order[:i]) for i in range(len(order) + 1)]


def sort_chains(layouts: Iterable[Layout]) -> list[tuple[list[str], list[Layout]]]:
    """Group layouts so that each group is served by one sort.

    Layouts fit together when all their leading column sets are nested; the sort
    lists the columns in the order the nested sets grow.  First fit, widest first.
    """
    chains: list[tuple[set[frozenset[str]], list[Layout]]] = []
    ranked = sorted(set(layouts), key=lambda x: (-len(x[0]) - len(x[1]), sorted(x[0]), x[1]))
    for layout in ranked:
        mine = _prefix_sets(layout)
        for sets, members in chains:
            if all(a <= b or b <= a for a in mine for b in sets):
                sets.update(mine)
                members.append(layout)
                break
        else:
            chains.append((set(mine), [layout]))
    out = []
    for sets, members in chains:
        columns: list[str] = []
        for prefix in sorted(sets, key=len):
            columns += sorted(prefix - set(columns))
        out.append((columns, members))
    return out


def _window_columns(spec: FeatureSpec, w_all: Window, w_ordered: Window | None, time: str, wrap_day: bool) -> Column:
    """Column of one spec over the anchor-partitioned, sorted clicks."""
    v = F.col(spec.value) if spec.value else None
    if spec.kind == "count":
        return F.count(F.lit(1)).over(w_all)
    if spec.kind == "count_nonnull":
        return F.count(v).over(w_all)
    if spec.kind == "mean":
        return F.avg(v).over(w_all)
    if spec.kind == "var":
        return F.var_samp(v).over(w_all)
    if spec.kind == "skew":
        n = F.count(v).over(w_all).cast("double")
        return corrected_skewness(n, F.skewness(v).over(w_all))
    now = epoch_seconds(time)
    if spec.kind == "cumcount":
        return (F.row_number().over(w_ordered) - 1).cast("long")
    if spec.kind == "next":
        return gap_seconds(F.lead(now).over(w_ordered), now, wrap_day)
    if spec.kind == "prev":
        return gap_seconds(now, F.lag(now).over(w_ordered), wrap_day)
    return F.coalesce(F.lead(now).over(w_ordered), F.lit(NO_NEXT_CLICK)) - now


def add_anchored(
    df: DataFrame, specs: Sequence[FeatureSpec], anchor: str, time: str, row: str, wrap_day: bool, rows: int
) -> DataFrame:
    """One shuffle of the ``rows`` clicks by the anchor, one sort per chain of nested key sets."""
    by_layout: dict[Layout, list[FeatureSpec]] = defaultdict(list)
    for spec in specs:
        by_layout[layout_of(spec, row)].append(spec)
    out = dealt(df, rows, anchor)
    for columns, members in sort_chains(by_layout):
        out = out.sortWithinPartitions(*columns)
        for keys, order in sorted(members, key=lambda m: -len(m[0]) - len(m[1])):
            part = [c for c in columns if c in keys]
            w_all = Window.partitionBy(*part)
            w_ordered = w_all.orderBy(*order) if order else None
            group = by_layout[keys, order]
            if group[0].kind != "nunique":
                out = out.withColumns(
                    {s.name: _window_columns(s, w_all, w_ordered, time, wrap_day) for s in group}
                )
                continue
            # Distinct values of a sorted group: the highest dense rank, without the null rank.
            value = F.col(order[0])
            ranked = out.withColumn("__dr", F.dense_rank().over(w_ordered))
            distinct = F.max("__dr").over(w_all) - F.max(value.isNull().cast("int")).over(w_all)
            out = ranked.withColumns({s.name: distinct.cast("long") for s in group}).drop("__dr")
    return out


def combination_counts(df: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """Rows per combination of all columns the specs group by or aggregate, written once."""
    used = sorted({c for s in specs for c in (*s.keys, *([s.value] if s.value else []))})
    return materialise(df.groupBy(*used).agg(F.count(F.lit(1)).alias("__w")))


def add_group_tables(
    df: DataFrame, base: DataFrame, specs: Sequence[FeatureSpec], limit: int
) -> DataFrame:
    """Aggregate features of any key sets, rolled up from the counted combinations.

    The clicks are not scanned again per key set.  Group tables are counted:
    small ones are broadcast, the others joined with salts for hot keys.
    """
    by_keys: dict[tuple[str, ...], list[FeatureSpec]] = defaultdict(list)
    for spec in specs:
        by_keys[tuple(sorted(spec.keys))].append(spec)
    moments = sorted({s.value for s in specs if s.kind in ("mean", "var", "skew")})
    sizes = base.agg(
        *[
            F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*keys), 14)).alias(f"k{i}")
            for i, keys in enumerate(by_keys)
        ],
        *[F.round(F.avg(F.col(c).cast("double"))).alias(f"o_{c}") for c in moments],
    ).first()
    origin = {c: sizes[f"o_{c}"] or 0.0 for c in moments}
    most = broadcast_rows(df.sparkSession)
    out = df
    for i, (keys, group) in enumerate(by_keys.items()):
        # The sketch is off by under one percent.
        small = sizes[f"k{i}"] * 1.1 <= most
        # Variance and skewness are summed around the mean of each group.
        spread = {s.value: origin[s.value] for s in group if s.kind in ("var", "skew")}
        rows = with_group_means(base, keys, spread, "__w", small=small, limit=limit) if spread else base
        table = rows.groupBy(*keys).agg(
            F.sum("__w").alias("__n"),
            *[
                weighted_measure(
                    s.kind, s.value, "__w", F.col(f"__m_{s.value}") if s.kind in ("var", "skew") else origin.get(s.value, 0.0)
                ).alias(s.name)
                for s in group
            ],
        )
        if small:
            out = out.join(F.broadcast(table.drop("__n")), list(keys), "left")
        else:
            out = attach_by_key(out, table, keys, "__n", limit=limit)
    return out


def add_joined(
    df: DataFrame, specs: Sequence[FeatureSpec], time: str, row: str, wrap_day: bool, limit: int, skewed: bool
) -> DataFrame:
    """Sequences, then aggregates from group tables.

    Key sets of few keys share one pass over row-number ranges; ``skewed`` ones (of hot anchors) are sliced one by one.
    """
    sequences: dict[tuple[str, ...], dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    argument = {"next": "next_name", "prev": "prev_name", "next_epoch": "next_epoch_name", "cumcount": "cumcount_name"}
    aggregates = [s for s in specs if s.kind not in SEQUENCE_KINDS]
    for spec in specs:
        if spec.kind in SEQUENCE_KINDS:
            sequences[tuple(sorted(spec.keys))][argument[spec.kind]].append(spec.name)
    base = combination_counts(df, aggregates) if aggregates else None
    out = df
    # Counts and slice summaries come from the narrow input, not from the widened result.
    if sequences and not skewed:
        wanted = [(keys, {arg: same[0] for arg, same in names.items()}) for keys, names in sequences.items()]
        out = add_sliced_sequences(out, wanted, time=time, row=row, wrap_day=wrap_day, source=df)
    for keys, names in sequences.items():
        if skewed:
            out = add_sequence(
                out,
                keys,
                **{arg: same[0] for arg, same in names.items()},
                time=time,
                row=row,
                wrap_day=wrap_day,
                limit=limit,
                skewed=True,
                source=df,
            )
        copies = {twin: F.col(same[0]) for same in names.values() for twin in same[1:]}
        out = out.withColumns(copies) if copies else out
    return add_group_tables(out, base, aggregates, limit) if aggregates else out


def add_features(
    df: DataFrame,
    specs: Sequence[FeatureSpec],
    *,
    anchor: str = "ip",
    time: str = "click_time",
    row: str = "row_id",
    wrap_day: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Add every feature of the specs to every click."""
    limit = hot_rows(df.sparkSession, limit)
    names = [s.name for s in specs]
    doubled = {n for n in names if names.count(n) > 1 or n in df.columns}
    if doubled:
        raise ValueError(f"feature names taken: {sorted(doubled)}")
    anchored = [s for s in specs if anchor in s.keys]
    others = [s for s in specs if anchor not in s.keys]
    out = add_joined(df, others, time, row, wrap_day, limit, False) if others else df
    if anchored:
        largest, rows = group_sizes(df, [anchor])
        if largest <= limit:
            out = add_anchored(out, anchored, anchor, time, row, wrap_day, rows)
        else:
            # At most rows/limit anchors.
            over = key_counts(df, [anchor]).filter(F.col("__n") > limit)
            hot = F.broadcast(materialise(over.select(anchor)))
            cold = out.join(hot, anchor, "left_anti")
            cold = add_anchored(cold, anchored, anchor, time, row, wrap_day, rows)
            # Features of the hot anchors are worked out on the narrow clicks.
            heavy = df.join(hot, anchor, "left_semi")
            heavy = add_joined(heavy, anchored, time, row, wrap_day, limit, True)
            if others:
                heavy = _attach_rows(heavy, out.join(hot, anchor, "left_semi"), others, row)
            out = cold.unionByName(heavy)
    return out.select(*df.columns, *names)


def _attach_rows(df: DataFrame, wide: DataFrame, specs: Sequence[FeatureSpec], row: str) -> DataFrame:
    return df.join(wide.select(row, *[s.name for s in specs]), row)
