"""What both near-duplicate operators share: word shingles, min-hashes, verified links and their components.

Every id has a list of roots; ids with an equal root, at the same place of the list, share a node and may be similar.
``linked_components`` compares them in two steps, so that a group of many copies costs a few comparisons per member
and not one per pair:

1. every member with ``HUBS`` members of its node; what passes is verified on full sets and gives components;
2. in nodes that still hold more than one component, members outside the node's largest component with all members
   of other components.  Every pair across components has such a member, so no link between components is missed.
   Where ``split`` sends large root nodes on to smaller ones, those are not compared; a pair is reported in the first
   shared node that is.  Large nodes with a large component hold a family of edited copies; there
   ``family_pairs`` looks for pairs by their rare shingles, so that the work grows with the family and not its square.

``bits`` holds two bits of each of 256 min-hashes.  Sets of similarity s agree in both bits of 256 * (1 + 3 s) / 4
positions on average; at 0.8 fewer than ``AGREE`` agree with a probability below 3e-6, so this test may run before
sets are fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from clickfeat.llm.common import kept, slices

HASHES = 256
AGREE = 190
HUBS = 4
# A shingle of at most so many members of a family is rare: its members meet each other directly.
RARE = 32
# A large node whose main component holds one in so many of its rows is a family.
FAMILY = 8
# Sizes within 2 percent share a bucket where members of like size are looked up.
SIZE_STEPS = 50
# Words whose hash a task remembers, in some 8 MB.
KNOWN_WORDS = 40_000
# Shingles hashed at once.
HASH_STEP = 128
# Shingles of several sets hashed at once, by one function after the other.
RUN_STEP = 8192

_MULTIPLY, _ADD = np.random.default_rng(77).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it holds ``KNOWN_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of ``size`` neighbouring words; of fewer words, the whole sequence is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    return np.unique(shingle_values(each, min(size, n)))


def shingle_values(each: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` neighbouring words, which are given as their hashes."""
    count = max(len(each) - size + 1, 0)
    value = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + each[i : count + i]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value


def min_hashes(shingles: np.ndarray, count: int) -> np.ndarray:
    out = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    multiply, add = _MULTIPLY[:count, None], _ADD[:count, None]
    # Steps that stay in the cache; a large array would be fetched from the system and given back each time.
    for start in range(0, len(shingles), HASH_STEP):
        part = shingles[None, start : start + HASH_STEP] * multiply
        part += add
        np.minimum(out, part.min(axis=1), out=out)
    # The low bits of a product are weak; fold the high ones in.
    return out ^ (out >> np.uint64(29))


def min_hashes_of_each(shingles: np.ndarray, counts: np.ndarray, count: int) -> np.ndarray:
    """``min_hashes`` of many sets, a row each: the sets stand one after the other and have ``counts`` shingles."""
    out = np.full((len(counts), count), np.iinfo(np.uint64).max, dtype=np.uint64)
    ends = np.cumsum(counts)
    filled = np.flatnonzero(counts)
    cuts = np.flatnonzero(np.diff(ends[filled] // RUN_STEP)) + 1
    for run in np.split(filled, cuts) if len(filled) else []:
        starts = ends[run] - counts[run]
        part = shingles[starts[0] : ends[run[-1]]]
        least = [np.minimum.reduceat(part * _MULTIPLY[k] + _ADD[k], starts - starts[0]) for k in range(count)]
        out[run] = np.stack(least, axis=1)
    return out ^ (out >> np.uint64(29))


def two_bits(hashes: np.ndarray) -> list[int]:
    """Two bits of each min-hash: for each 64 of them, the low ones and the high ones as signed 64-bit numbers."""
    mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)
    low, high = (np.packbits(((mixed >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)).view(">i8") for k in (0, 1))
    return np.stack([low, high], axis=1).ravel().tolist()


def agreement(mine: str = "bits", other: str = "hub_bits", longs: int = HASHES // 32):
    """In how many positions both bits of two rows agree."""
    total = F.lit(longs * 32)
    for k in range(0, longs, 2):
        low, high = (F.col(mine)[i].bitwiseXOR(F.col(other)[i]) for i in (k, k + 1))
        total = total - F.bit_count(low.bitwiseOR(high))
    return total


def agree():
    return agreement() >= AGREE


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (smallest id reachable) of every id in ``edges`` (a, b), by alternating large and small stars.

    Each round pre-aggregates minima and is written to the shared folder, so that plans stay short.
    """
    now = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        # Sums of hashes as 32-bit parts cannot overflow.
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first())

    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # Large star: each larger neighbour of a node is joined to the node's smallest neighbour (or itself).
        both = now.union(now.select("v", "u"))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        up = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
        large = kept(up.filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: smaller neighbours of a node, and the node, are joined to the smallest of them.
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        down = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(down.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, state(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def hub_pairs(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of every member with the hubs of its node, where the bits agree.

    Edited copies are often nearer to what they were copied from than to each other.  So one hub is the member that
    agrees most with the node's consensus, the majority of each bit; the others are chosen by hash.
    Sums and extremes are pre-aggregated, and at most ``HUBS`` rows leave a node.
    """
    shared = kept(keys.join(heads.select("id", "bits"), "id").select("node", "id", "bits"))
    lanes = F.lit((1 << 32) | 1)
    # The first 64 positions are enough for a consensus.
    sums = [F.sum(F.shiftrightunsigned(F.col("bits")[k], j).bitwiseAND(lanes)).alias(f"s{k}_{j}") for k in (0, 1) for j in range(32)]
    counted = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *sums)

    def majority(k: int):
        out = F.lit(0).cast("long")
        for j in range(32):
            column = F.col(f"s{k}_{j}")
            for lane, bit in ((column.bitwiseAND(F.lit(0xFFFFFFFF)), j), (F.shiftrightunsigned(column, 32), j + 32)):
                mask = (1 << bit) - ((1 << 64) if bit == 63 else 0)
                out = out.bitwiseOR(F.when(lane * 2 > F.col("n"), F.lit(mask)).otherwise(F.lit(0)))
        return out

    consensus = kept(counted.select("node", F.array(majority(0), majority(1)).alias("hub_bits")))
    ranked = shared.join(consensus, "node").select("node", "id", agreement(longs=2).alias("near"))
    central = F.max(F.struct("near", F.xxhash64("id").alias("h"), "id")).alias("h0")
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(h)).alias("h"), "id")).alias(f"h{h}") for h in range(1, HUBS)]
    nodes = ranked.groupBy("node").agg(central, *drawn)
    each = nodes.select("node", F.explode(F.array_distinct(F.array(*[F.col(f"h{h}.id") for h in range(HUBS)]))).alias("id"))
    hubs = each.join(heads.select("id", "bits"), "id")
    hubs = kept(hubs.select("node", F.col("id").alias("hub"), F.col("bits").alias("hub_bits")))
    found = shared.join(hubs, "node").filter((F.col("id") != F.col("hub")) & agree())
    return found.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def with_components(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of nodes that hold more than one component, with ``component``, the node's largest component ``major``,
    its rows ``n`` and those outside the largest component, ``rest``."""
    labelled = keys.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"))
    nodes = sizes.groupBy("node").agg(
        F.count(F.lit(1)).alias("components"), F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("m")
    )
    mixed = nodes.filter("components > 1").select(
        "node", "n", F.col("m.component").alias("major"), (F.col("n") - F.col("m.c")).alias("rest")
    )
    return labelled.join(kept(mixed), "node")


def cross_pairs(mixed: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, across components of a node where the bits agree: see the module's second step."""
    # Root nodes that branch on are not compared here and must not count as a pair's first node.
    compared = kept(mixed.groupBy("id").agg(F.expr("bit_or(shiftleft(1L, place))").alias("compared")))
    signed = mixed.join(compared, "id").join(heads.select("id", "bits", "roots"), "id")
    roots = F.transform("roots", lambda root, place: F.when(F.getbit("compared", place) == 1, root))
    full = kept(signed.withColumn("roots", roots).drop("compared"))
    others = full.filter("component <> major").select(
        "node", *[F.col(c).alias(f"hub_{c}") for c in ("id", "bits", "component", "roots")]
    )
    # Two members outside the largest component meet in both orders; one is enough.
    once = (F.col("component") == F.col("major")) | (F.col("id") < F.col("hub_id"))
    same = F.zip_with("roots", "hub_roots", lambda a, b: a == b)
    first = (F.col("place") < 0) | (F.array_position(same, True) == F.col("place") + 1)
    near = (F.col("component") != F.col("hub_component")) & once & agree() & first
    found = others.join(full, "node").filter(near)
    return found.select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b")).distinct()


def family_pairs(
    families: DataFrame, heads: DataFrame, sets_of: Callable[[DataFrame], DataFrame], numerator: int, denominator: int
) -> DataFrame:
    """Pairs (a, b), a < b, across components within a family that may be linked and whose bits agree.

    ``families`` has family (its main component), id and component.  A shingle is rare if at most ``RARE`` members of
    the family hold it; a member of ``size`` shingles has ``common`` others.  A linked pair either shares a rare shingle, and
    the equi-join on those finds it with at most ``RARE`` rows per shingle, or its whole intersection is common.  Then
    the smaller ``common`` bounds the intersection, and ``(denominator + numerator) * common >= numerator * (sum of
    sizes)`` must hold for it: that leaves each member a narrow range of partner sizes, which are joined by bucket.
    Edits of their own take most members out of the second case; for the others a bit map of the common shingles
    bounds the intersection from above.  No pair is lost: all are bounds of the exact test.
    """
    members = kept(families.join(heads.select("id", "bits", "size"), "id"))
    sets = sets_of(members.select("id").distinct())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            keys = []
            for salt, shingles in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                found = np.frombuffer(shingles, dtype=np.uint64)
                # A family's own key of each shingle.
                mixed = (found ^ np.uint64(salt & ((1 << 64) - 1))) * np.uint64(0x9E3779B97F4A7C15)
                keys.append((mixed ^ (mixed >> np.uint64(29))).view(np.int64))
            if keys:
                rows = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                columns = [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(keys))]
                yield pa.RecordBatch.from_arrays(columns, ["family", "id", "key"])

    named = members.select("family", "id").schema
    held = members.select("family", "id").join(sets, "id").select("family", "id", F.xxhash64("family"), "shingles")
    postings = kept(held.mapInArrow(post, StructType([*named, StructField("key", LongType())])))
    counted = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = kept(postings.join(kept(counted), "key"))

    def sides(rows: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
        renamed = [F.col(c).alias(c if c in on else f"hub_{c}") for c in rows.columns]
        return rows.filter("component <> family"), rows.select(*renamed)

    def pairs(left: DataFrame, right: DataFrame, on: list[str], *more) -> DataFrame:
        # Two members outside the main component meet in both orders; one is enough.
        once = (F.col("hub_component") == F.col("family")) | (F.col("id") < F.col("hub_id"))
        near = once & (F.col("component") != F.col("hub_component")) & agree()
        for condition in more:
            near = near & condition
        return left.join(right, on).filter(near).select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b"))

    rare = shared.filter(F.col("n") <= RARE).select("family", "id", "key")
    rare = kept(rare.join(members.drop("size"), ["family", "id"]))
    by_shingle = pairs(*sides(rare, ["family", "key"]), ["family", "key"])

    # Common shingles are marked in a bit map of at least four bits per shingle of an average member.
    average = members.groupBy("family").agg(F.pow(2, F.ceil(F.log2(F.avg("size") / 16 + 1))).cast("long").alias("longs"))
    marked = shared.filter(F.col("n") > RARE).join(kept(average), "family")
    place = F.shiftrightunsigned("key", 6)
    marked = marked.withColumn("at", F.pmod(place, F.col("longs")).cast("int"))
    parts = marked.groupBy("family", "id", "longs", "at").agg(
        F.count(F.lit(1)).alias("c"), F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("word")
    )
    common = parts.groupBy("family", "id", "longs").agg(F.sum("c").alias("common"), F.collect_list(F.struct("at", "word")).alias("words"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            maps = []
            for longs, words in zip(part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True):
                out = np.zeros(longs, dtype=np.int64)
                out[[w["at"] for w in words]] = [w["word"] for w in words]
                maps.append(out)
            columns = [part.column(i) for i in (0, 1, 3)] + [pa.array(maps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["family", "id", "common", "map"])

    mapped = [StructField("common", LongType()), StructField("map", ArrayType(LongType()))]
    common = common.mapInArrow(dense, StructType([*named, *mapped]))
    total = numerator + denominator
    wide = members.join(common, ["family", "id"]).filter(F.col("common") * denominator >= F.col("size") * numerator)

    def bucket(size):
        return F.floor(F.log(size) * SIZE_STEPS)

    def shared_at_most(mine: str, its: str, count: str):
        # A bit that only one side has set stands for a shingle, or several, that the other side lacks.
        lone = F.zip_with(mine, its, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.col(count) - F.aggregate(lone, F.lit(0), lambda x, y: x + y)

    wide = kept(wide.withColumn("bucket", bucket(F.col("size"))))
    left, right = sides(wide, ["family", "bucket"])
    least = F.greatest(F.ceil(F.col("size") * numerator / denominator), F.lit(1))
    most = F.floor(F.col("common") * total / numerator) - F.col("size")
    reach = left.filter(most >= least).withColumn("bucket", F.explode(F.sequence(bucket(least), bucket(most))))
    needed = (F.col("size") + F.col("hub_size")) * numerator
    fits = [
        bound * total >= needed
        for bound in (
            F.least("common", "hub_common"),
            shared_at_most("map", "hub_map", "common"),
            shared_at_most("hub_map", "map", "hub_common"),
        )
    ]
    by_size = pairs(reach, right, ["family", "bucket"], *fits)
    return by_shingle.union(by_size).distinct()


def verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs whose full sets have ``denominator * |intersection| >= numerator * |union|``.

    ``sets`` has id and ``shingles`` (sorted distinct 64-bit hashes as binary).  The pairs are joined with the sets
    of b, then of a: a member that many pairs share is a hot key of the second join, which is split at run time.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            passed = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if min(len(p), len(q)) * denominator < max(len(p), len(q)) * numerator:
                    passed.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                passed.append(denominator * both >= numerator * (len(p) + len(q) - both) and both > 0)
            yield part.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "left", "right")
    return joined.mapInArrow(check, pairs.select("a", "b").schema)


def linked_components(
    heads: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    numerator: int,
    denominator: int,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None,
    rounds: int = 4,
    small: int | None = None,
) -> DataFrame:
    """id, component of every id with a verified link.

    ``heads`` is a stored table of id, roots and bits.  With ``small``, nodes of more rows that hold a family
    are looked through by ``family_pairs``; ``heads`` then has ``size``, the number of shingles, too.
    ``sets_of`` gives the sets of the ids in a one-column table.
    ``split``, if given, takes the rows of mixed nodes and returns those to compare now and the rows (node, place -1,
    id) of smaller nodes to look at in the next round.
    """

    def links(pairs: DataFrame) -> DataFrame:
        pairs = kept(pairs)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        return kept(verified(pairs, sets_of(ids), numerator, denominator))

    placed = heads.select("id", F.posexplode("roots").alias("place", "root"))
    keys = placed.select(F.xxhash64("place", "root").alias("node"), "place", "id")
    # Most nodes have one member and are gone after this narrow count.
    several = keys.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    keys = kept(keys.join(kept(several), "node"))
    edges = links(hub_pairs(keys, heads))
    comp = kept(components(edges))
    found, families, rest = [], [], keys
    for i in range(rounds):
        mixed = kept(with_components(rest, comp))
        if small is not None:
            # A main component of some size marks a family; what still is large after the last round is treated alike.
            family = F.col("n") > small
            if split and i + 1 < rounds:
                family = family & (FAMILY * (F.col("n") - F.col("rest")) >= F.col("n"))
            families.append(mixed.filter(family).select(F.col("major").alias("family"), "id", "component"))
            mixed = mixed.filter(~family)
        now, rest = split(mixed) if split and i + 1 < rounds else (mixed, None)
        found.append(cross_pairs(now, heads))
        if rest is None or rest.isEmpty():
            break
    if families:
        members = kept(reduce(DataFrame.union, families).distinct())
        if not members.isEmpty():
            found.append(family_pairs(members, heads, sets_of, numerator, denominator))
    pairs = reduce(DataFrame.union, found)
    more = links(pairs.distinct())
    if more.isEmpty():
        return comp
    return kept(components(edges.union(more)))
