"""Packing token pieces into sequences: a configuration linear program over the length histogram.

Documents become ids and an end id; documents longer than a sequence are cut into full pieces, the first piece being
the shorter one.  The histogram of piece lengths has at most ``capacity`` entries whatever the number of documents,
so it is what the driver plans on.  A configuration is a multiset of lengths that fits one sequence; the linear
program asks for the fewest configurations that cover the histogram.  It is solved by multiplicative weights: each
length has a price, a knapsack dynamic program finds the configurations of highest total price, prices fall for what they
cover, and prices also bound the optimum from below: rounds end when the solution is close to it.  The fractional solution
is rounded to units of whole copies, and what is left is packed best fit, largest first.

The plan comes back as ranges: per length, pieces of rank a to b go to sequences s, s+1, ... at a known offset.  A
piece's rank within its length is its number in a slice (length, hash of its id) plus the pieces of earlier slices, so
a length that a third of all pieces have is spread over many tasks.

Defined cases: null text is empty and its piece is the end id alone; equal texts and repeated rows are packed as often
as they occur; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickfeat.llm.common import slices, stored, texts_of

CAPACITY = 2048
END_ID = 0
SLICES = 256
GAP = 0.05  # of the linear program's optimum
NEAR_BEST = 0.02  # configurations used together with the best one are worth less by at most this share
NO_PRICE = 1e-6  # a length's price below this share of its first one is none
SMOOTH = 25  # rounds
UNITS = 20_000  # placements of the linear program's solution are at most about so many

Placement = list[tuple[int, int, int, int, int, int]]  # length, first rank, copies, sequence, per sequence, offset


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """Function from text to ids, equal to the file's own encoder with special strings as special ids.

    Where the file is a plain byte-level model whose ids follow its merges, the same ranks run in a faster library.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    from clickfeat.llm.bpe import WORDS, Vocabulary

    voc = Vocabulary(path)
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    merged = [i for i in sorted(voc.bytes_of) if i in voc.rank]
    before = data["pre_tokenizer"] or {}
    plain = (
        [voc.rank[i] for i in merged] == sorted(voc.rank[i] for i in merged)
        and data["normalizer"] is None
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and not data["model"].get("ignore_merges")
    )
    if plain:
        ranks = {b: i for i, b in voc.bytes_of.items() if i not in voc.special.values()}
        own = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=voc.special)
        return lambda text: own.encode(text, allowed_special="all")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def pieces_of(
    df: DataFrame,
    vocabulary: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit, as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(vocabulary)
        for part in slices(batches, 256):
            out: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                start = 0
                for piece in range(-(-len(ids) // capacity)):
                    size = (len(ids) - 1) % capacity + 1 if piece == 0 else capacity
                    data = ids[start : start + size].tobytes()
                    out.append((doc, piece, start, size, zlib.crc32(data), data if with_ids else None))
                    start += size
            doc, piece, start, size, crc, data = zip(*out, strict=True) if out else [()] * 6
            columns = [
                pa.array(doc, pa.int64()),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(size, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(data, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return texts_of(df, id_col, text_col).mapInArrow(run, schema)


def priced_rooms(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repetition: the highest total price that fits each room, and the length to take there.

    A length taken that has no price, or that no piece has, is room left free.
    """
    worth_of = np.zeros(capacity)
    worth_of[capacity - lengths] = prices
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        worth = worth_of[capacity - room :] + best[:room]  # by the room that is left: of equals, the longest is taken
        rest = int(worth.argmax())
        best[room], choice[room] = worth[rest], room - rest
    return best, choice


def solve_configurations(
    histogram: dict[int, int], capacity: int, rounds: int | None = None
) -> list[tuple[tuple[int, ...], float]]:
    """Fractional covering of the histogram by configurations, as (lengths, amount), within ``GAP`` of the fewest.

    In each round a length's price is its size times exp(-covered).  For each length the best configuration that holds it
    is looked up, and all that are worth about as much as the best of all are used together: each in proportion to what
    covers its scarcest length, and less for a length that is ahead.  The price of all pieces over that of the best
    configuration is a lower bound of any covering; rounds go on until the amounts, scaled so that every length is covered
    at least once, are that close to the bound.  ``rounds`` ends them early, and lengths may then stay uncovered.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[n] for n in lengths.tolist()], dtype=float)
    if not len(lengths):
        return []
    need_of = np.full(capacity + 1, np.inf)
    need_of[lengths] = need
    own = {n: n for n in lengths.tolist()}  # one object per length, however many configurations hold it
    covered = np.zeros(len(lengths))
    smooth = np.zeros(len(lengths))
    amounts: dict[tuple[int, ...], float] = defaultdict(float)
    total = bound = 0.0
    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        fall = np.exp(covered.min() - covered)
        fall[fall < NO_PRICE] = 0
        prices = lengths * fall
        best, choice = priced_rooms(prices, lengths, capacity)
        bound = max(bound, float((need * prices).sum() / best[capacity]))
        smooth += prices / best[capacity]
        if turn % SMOOTH == 0:  # prices of one round swing; those of many together bound closer
            bound = max(bound, float((need * smooth).sum() / priced_rooms(smooth, lengths, capacity)[0][capacity]))
            smooth /= 2
        used = np.flatnonzero((prices > 0) & (prices + best[capacity - lengths] >= (1 - NEAR_BEST) * best[capacity]))
        columns = [lengths[used]]
        room = capacity - lengths[used]
        while room.any():
            columns.append(choice[room])
            room = room - choice[room]
        configs = np.stack(columns, axis=1)
        configs[~np.isin(configs, lengths[prices > 0])] = 0
        configs.sort(axis=1)
        starts = np.ones(configs.shape, dtype=bool)
        starts[:, 1:] = configs[:, 1:] != configs[:, :-1]
        run = np.cumsum(starts.ravel()) - 1
        times = np.bincount(run)[run].reshape(configs.shape)
        weight = fall[used] * (need_of[configs] / times).min(axis=1)
        held = configs > 0
        uses = np.bincount(configs[held], weights=np.broadcast_to(weight[:, None], configs.shape)[held], minlength=capacity + 1)
        gain = uses[lengths] / need
        # Steps shrink, so that the prices settle; lengths that are covered amply do not hold them up.
        size = 1 / (gain * np.maximum(fall, 0.05)).max() / math.sqrt(1 + turn / 50)
        for config, amount in zip(configs.tolist(), (weight * size).tolist(), strict=True):
            amounts[tuple(own[n] for n in config if n)] += amount
        covered += gain * size
        total += float(weight.sum()) * size
        if total <= (1 + GAP) * bound * covered.min():
            break
    scale = covered.min() or covered[covered > 0].min()
    return [(c, a / scale) for c, a in amounts.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> Placement:
    """Where the pieces of each length go; covers every piece of the histogram exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0 and n < capacity}
    rank: dict[int, int] = defaultdict(int)
    out: Placement = []
    sequence = 0
    if histogram.get(capacity):
        out.append((capacity, 0, histogram[capacity], 0, 1, 0))
        sequence = histogram[capacity]

    def use(config: tuple[int, ...], copies: int) -> None:
        nonlocal sequence
        offset = 0
        for n in sorted(set(config), reverse=True):
            times = config.count(n)
            out.append((n, rank[n], copies, sequence, times, offset))
            rank[n] += copies * times
            left[n] -= copies * times
            offset += n * times
        sequence += copies

    solved = solve_configurations(left, capacity, rounds)
    # Amounts far below one are common: they add up along configurations in order, and each full unit is used.
    unit = max(1, int(sum(amount for _, amount in solved)) // UNITS)
    due = 0.0
    for config, amount in sorted(solved, key=lambda x: x[0][::-1], reverse=True):
        due += amount / unit
        copies = min([int(due) * unit, *(left[n] // config.count(n) for n in set(config))])
        due -= int(due)
        if copies > 0 and sum(config) >= capacity - 8:
            use(config, copies)
    # What rounding leaves, best fit: the fullest configuration that starts with the largest piece left, used as often
    # as it can be.
    while any(left.values()):
        config = []
        spare = dict(left)
        sizes = sorted((n for n, c in spare.items() if c > 0), reverse=True)
        first = sizes[0]
        config.append(first)
        spare[first] -= 1
        config += _fill(capacity - first, {n: c for n, c in spare.items() if c > 0})
        counts = {n: config.count(n) for n in set(config)}
        use(tuple(config), max(1, min(left[n] // c for n, c in counts.items())))
    return out


def _fill(room: int, have: dict[int, int]) -> list[int]:
    """Pieces that fill ``room`` as far as possible, each length at most as often as there are pieces."""
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    made = np.zeros(room + 1, dtype=np.int64)
    for n in sorted(have, reverse=True):
        if n > room:
            continue
        count = min(have[n], room // n)
        span = 1
        while count > 0:  # counts as sums of powers of two: each is one more or less item
            take = min(span, count)
            size = n * take
            if size <= room:
                new = np.zeros_like(reach)
                new[size:] = reach[:-size] if size else reach
                new &= ~reach
                made[new] = n << 20 | take
                reach |= new
            count -= take
            span *= 2
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    out = []
    while at:
        n, take = int(made[at]) >> 20, int(made[at]) & 0xFFFFF
        out += [n] * take
        at -= n * take
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of a stored table of pieces, with sequence_id and offset.  It is read three times."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, first, copies, sequence, times, offset in plan(histogram, capacity):
        by_length[length].append((first, sequence, times, offset))
    table = {}
    for length, ranges in by_length.items():
        ranges.sort()
        table[length] = np.array(ranges, dtype=np.int64)
    shared = spark.sparkContext.broadcast(table)

    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SLICES)))
    own = ["length", "__slice"]
    counts = sliced.groupBy(*own).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*own, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ordered = Window.partitionBy(*own).orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("__rank", F.row_number().over(ordered) - 1).join(starts, own)
    ranked = ranked.withColumn("__rank", (F.col("__rank") + F.col("__start")).cast("long")).drop("__slice", "__start")

    @F.pandas_udf("sequence_id long, offset long")
    def where(length, rank):
        import pandas as pd

        sequence = np.zeros(len(length), dtype=np.int64)
        offset = np.zeros(len(length), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            ranges = shared.value[int(n)]
            row = np.searchsorted(ranges[:, 0], ranks[at], side="right") - 1
            inside = ranks[at] - ranges[row, 0]
            times = ranges[row, 2]
            sequence[at] = ranges[row, 1] + inside // times
            offset[at] = ranges[row, 3] + inside % times * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("__at", where("length", "__rank"))
    return placed.select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack(
    df: DataFrame,
    vocabulary: str,
    *,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece with its place; the pieces are stored once in the shared folder."""
    pieces = pieces_of(df, vocabulary, capacity=capacity, id_col=id_col, text_col=text_col, with_ids=with_ids)
    return place(stored(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences of ``pack(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.expr("array_join(transform(parts, p -> hex(p.ids)), '')").alias("ids_hex"))
