"""Hard negatives: anchor spanning-tree bounds decide which candidates are scored.

Vectors become whole numbers, ``floor(scale * x)``, and a score is an exact integer inner product.  Anchors are packed
into blocks of a bounded size; a minimum spanning tree over a block's anchors orders them.  For a candidate c, an anchor
b at distance d from its parent a in the tree has ``|b.c - a.c| <= d * |c|``: from the interval of the parent's score
follows one for the child.  Each anchor asks for windows of scores, and a candidate is scored against it only if its
interval meets one of them; else the interval is handed on.

Two searches run over all candidates.  The first takes, per anchor, the best rows of the same label: the window starts
at the best rows of a bounded sample and narrows as better rows are met.  The second takes, per anchor and positive, the
best rows of other labels whose score is within the given share of the positive's.  Tasks report their own best rows
and Spark merges them.  Anchor blocks are broadcast a group at a time, each of at most ``GROUP_BYTES``.

Defined cases: rows with a null label, a null vector or a null, NaN or infinite component take no part; shorter vectors
are filled up with zeros; higher scores come first and equal ones by smaller id, repeated ids by their place; rows with
the anchor's id are not its positives; a row with a null id takes part as a candidate that comes last among equals and
is never an anchor; an anchor without positives, or a positive whose window is empty, has no rows; a negative positive
score has an empty window.  Scores are exact if they fit 64 bits.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfeat.llm.common import kept, slices

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score is at least this share (in hundredths) of the positive's, and at most all of it.
SHARE = 80
# Anchors of one tree, bytes of anchors that are broadcast at once, candidates scored at once, rows of the sample.
BLOCK_ROWS = 1024
GROUP_BYTES = 32 << 20
BATCH_ROWS = 2048
SAMPLE_ROWS = 4096
# Numbers that a block leaves for its anchors' keys.
MAX_BLOCK = 1 << 20
# Doubles hold whole numbers exactly below this.
EXACT = float(1 << 53)
# From this share of scores asked for on, a level of the tree is scored as one matrix.
DENSE = 0.1
# Bounds are widened by this share and by one, far beyond rounding.
SLACK = 1e-9

LOW = np.iinfo(np.int64).min
HIGH = np.iinfo(np.int64).max


def vectors_of(df: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, v: rows that take part, with whole-number components."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("x")
    ).filter(F.col("label").isNotNull() & F.col("x").isNotNull())
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.filter(finite).select("id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def matrix_of(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``width``."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all their inner products are exact in doubles, else as they are (modulo 2**64)."""
    x, y = a.astype(float), b.astype(float)
    largest = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * a.shape[1]
    return (x, y) if largest < EXACT else (a, b)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 for the root, the first point) and distance to it of a minimum spanning tree, by Prim's method."""
    n = len(points)
    p = points.astype(float)
    parent, length = np.full(n, -1), np.zeros(n)
    if n < 2:
        return parent, length
    square = (p * p).sum(axis=1)
    near, by = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    left = np.ones(n, dtype=bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        d = np.maximum(square + square[at] - 2 * (p @ p[at]), 0)
        closer = left & (d < near)
        near[closer], by[closer] = d[closer], at
        at = int(np.where(left, near, np.inf).argmin())
        parent[at] = by[at]
    # Distances anew from the differences: products of near points cancel.
    child = np.flatnonzero(parent >= 0)
    length[child] = np.sqrt(((p[child] - p[parent[child]]) ** 2).sum(axis=1))
    return parent, length


def levels_of(parent: np.ndarray) -> list[np.ndarray]:
    """Points by depth in the tree."""
    depth = np.full(len(parent), -1)
    depth[parent < 0] = 0
    out = [np.flatnonzero(depth == 0)]
    while len(out[-1]):
        here = (depth < 0) & np.isin(parent, out[-1])
        depth[here] = len(out)
        out.append(np.flatnonzero(here))
    return out[:-1]


@dataclass
class AnchorBlock:
    """Anchors of one tree and the score windows each asks for."""

    keys: np.ndarray  # unique, even where ids repeat
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    parent: np.ndarray
    length: np.ndarray
    # anchors x windows: least and greatest score asked for; a least score above the greatest is no window.
    low: np.ndarray
    high: np.ndarray

    def scores(
        self, batch: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and which are known, of anchors x candidates; unknown ones are unwanted or in none of the windows."""
        n, m = len(self.ids), len(batch)
        points, vectors = comparable(self.points, batch)
        norm = np.sqrt((batch.astype(float) ** 2).sum(axis=1))
        size = np.sqrt((self.points.astype(float) ** 2).sum(axis=1))
        out, known = np.zeros((n, m), dtype=np.int64), np.zeros((n, m), dtype=bool)
        least, most = np.full((n, m), -np.inf), np.full((n, m), np.inf)
        for level in levels_of(self.parent):
            up = self.parent[level]
            if up[0] >= 0:
                step = self.length[level] * (1 + SLACK) + (size[level] + size[up]) * SLACK
                reach = step[:, None] * norm[None, :] + 1
                least[level], most[level] = least[up] - reach, most[up] + reach
            asked = np.zeros((len(level), m), dtype=bool)
            for w in range(low.shape[1]):
                asked |= (least[level] <= high[level, w, None]) & (most[level] >= low[level, w, None])
            asked &= wanted[level]
            if not asked.any():
                continue
            if asked.mean() > DENSE:
                out[level] = points[level] @ vectors.T
                known[level] = True
                least[level] = most[level] = out[level]
                continue
            for r in np.flatnonzero(asked.any(axis=1)):
                anchor, columns = level[r], np.flatnonzero(asked[r])
                out[anchor, columns] = vectors[columns] @ points[anchor]
                known[anchor, columns] = True
                least[anchor, columns] = most[anchor, columns] = out[anchor, columns]
        return out, known


class BestRows:
    """The best candidates of every window of a block, and the least score that can still enter."""

    def __init__(self, block: AnchorBlock, keep: int, same: bool):
        self.block, self.keep, self.same = block, keep, same
        self.best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.low, self.high = block.low.copy(), block.high

    def add(self, ids: np.ndarray, labels: np.ndarray, batch: np.ndarray) -> None:
        block = self.block
        wanted = (block.labels[:, None] == labels[None, :]) == self.same
        if self.same:
            wanted &= block.ids[:, None] != ids[None, :]
        score, known = block.scores(batch, self.low, self.high, wanted)
        fits = known & wanted
        for w in range(block.low.shape[1]):
            inside = fits & (score >= self.low[:, w, None]) & (score <= self.high[:, w, None])
            for a in np.flatnonzero(inside.any(axis=1)):
                at = np.flatnonzero(inside[a])
                s, i = score[a, at], ids[at]
                if len(at) > self.keep:
                    order = np.lexsort((i, -s))[: self.keep]
                    s, i = s[order], i[order]
                found = self.best.get((a, w), []) + list(zip(s.tolist(), i.tolist(), strict=True))
                found = heapq.nsmallest(self.keep, found, key=lambda x: (-x[0], x[1]))
                self.best[a, w] = found
                if len(found) == self.keep:
                    self.low[a, w] = max(self.low[a, w], found[-1][0])

    def rows(self) -> pa.RecordBatch:
        keys = [(a, w) for (a, w), found in self.best.items() for _ in found]
        found = [x for rows in self.best.values() for x in rows]
        anchors = np.array([a for a, _ in keys], dtype=np.int64)
        windows = np.array([w for _, w in keys], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.block.keys[anchors], pa.int64()),
                pa.array(self.block.ids[anchors], pa.int64()),
                pa.array(windows, pa.int64()),
                pa.array([i if i != HIGH else None for _, i in found], pa.int64()),
                pa.array([s for s, _ in found], pa.int64()),
            ],
            names=["key", "anchor_id", "window", "id", "score"],
        )


def search(candidates: DataFrame, blocks: list[AnchorBlock], keep: int, same: bool, width: int) -> DataFrame:
    """key, anchor_id, window, id, score: the best rows of every task in every window."""
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [BestRows(block, keep, same) for block in shared.value]
        for part in slices(batches, BATCH_ROWS):
            ids = part.column(0).fill_null(HIGH).to_numpy(zero_copy_only=False)
            labels = part.column(1).to_numpy(zero_copy_only=False)
            batch = matrix_of(part.column(2), width)
            for one in best:
                one.add(ids, labels, batch)
        for one in best:
            yield one.rows()

    return candidates.select("id", "label", "v").mapInArrow(run, "key long, anchor_id long, window long, id long, score long")


def first_rows(rows: DataFrame, by: list[str], keep: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= keep)


def pack_anchors(anchors: DataFrame, width: int, block_rows: int) -> DataFrame:
    """block, ids, labels, points, parent, length: anchors in blocks, each with its spanning tree, made in Spark tasks.

    Blocks are cut along the direction of the first components' signs, so that near anchors tend to share a tree.
    """
    parts = max(1, -(-anchors.count() // block_rows))
    signs = F.transform(F.slice("v", 1, 16), lambda c: F.when(c < 0, 0).otherwise(1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, block_rows):
            points = matrix_of(part.column(2), width)
            parent, length = spanning_tree(points)
            yield pa.RecordBatch.from_pydict(
                {
                    "ids": [part.column(0).to_numpy().tobytes()],
                    "labels": [part.column(1).to_numpy().astype(np.int64).tobytes()],
                    "points": [points.tobytes()],
                    "parent": [parent.astype(np.int64).tobytes()],
                    "length": [length.tobytes()],
                }
            )

    near = anchors.repartitionByRange(parts, signs, "id").sortWithinPartitions(signs, "id").select("id", "label", "v")
    packed = near.mapInArrow(pack, "ids binary, labels binary, points binary, parent binary, length binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


def unpack(row, width: int) -> AnchorBlock:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    none = np.zeros((len(ids), 0), dtype=np.int64)
    return AnchorBlock(
        row["block"] * MAX_BLOCK + np.arange(len(ids)),
        ids,
        np.frombuffer(row["labels"], dtype=np.int64),
        np.frombuffer(row["points"], dtype=np.int64).reshape(len(ids), width),
        np.frombuffer(row["parent"], dtype=np.int64),
        np.frombuffer(row["length"], dtype=np.float64),
        none,
        none,
    )


def open_windows(block: AnchorBlock, least: dict[int, int]) -> AnchorBlock:
    """One window per anchor, upwards from the score already reached."""
    low = np.array([least.get(k, LOW) for k in block.keys.tolist()], dtype=np.int64).reshape(-1, 1)
    return replace(block, low=low, high=np.full_like(low, HIGH))


def positive_windows(block: AnchorBlock, positives: dict[int, list[tuple[int, int]]], most: int, share: int) -> AnchorBlock:
    """A window per positive (place, score) of each anchor."""
    low, high = np.full((len(block.ids), most), HIGH), np.full((len(block.ids), most), LOW)
    for a, key in enumerate(block.keys.tolist()):
        for place, score in positives.get(key, []):
            low[a, place], high[a, place] = -(-share * score // 100), score
    return replace(block, low=low, high=high)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    *,
    label: Column,
    id_col: str = "id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: int = SHARE,
    block_rows: int = BLOCK_ROWS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``; ``label`` is a column of the input.
    """
    rows = kept(vectors_of(df, label, id_col, vector_col, scale))
    spark = rows.sparkSession
    size = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    width, total = max(size[0] or 0, 1), size[1]
    anchors = rows.filter(F.col("id").isNotNull() & is_anchor)
    packed = kept(pack_anchors(anchors, width, block_rows))
    sizes = packed.select("block", (F.length("points") + 3 * F.length("ids")).alias("bytes")).orderBy("block").collect()
    groups: list[list[int]] = [[]]
    held = 0
    for row in sizes:  # one row per block
        if groups[-1] and held + row["bytes"] > group_bytes:
            groups.append([])
            held = 0
        groups[-1].append(row["block"])
        held += row["bytes"]
    cut = int(min(1.0, SAMPLE_ROWS / max(total, 1)) * 1_000_000)
    sample = rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1_000_000)) < cut)
    out = None
    for group in groups:
        found = packed.filter(F.col("block").isin(group)).orderBy("block").collect()
        blocks = [unpack(row, width) for row in found]
        # Where the sample's best rows are is where windows start, so that tasks report few rows.
        tried = first_rows(search(sample, [open_windows(b, {}) for b in blocks], positives, True, width), ["key"], positives, "place")
        least = {
            r["key"]: r["score"]
            for r in tried.filter(F.col("place") == positives).select("key", "score").collect()  # anchors of the group
        }
        best = search(rows, [open_windows(b, least) for b in blocks], positives, True, width)
        near = kept(first_rows(best, ["key"], positives, "place"))
        wanted: dict[int, list[tuple[int, int]]] = {}
        for r in near.select("key", "place", "score").collect():  # positives x anchors of the group
            wanted.setdefault(r["key"], []).append((r["place"] - 1, r["score"]))
        windows = [positive_windows(b, wanted, positives, share) for b in blocks]
        hard = first_rows(search(rows, windows, negatives, False, width), ["key", "window"], negatives, "rank")
        named = near.select(
            "key", (F.col("place") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        joined = hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["key", "window"])
        part = kept(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        out = part if out is None else out.unionByName(part)
    return out
