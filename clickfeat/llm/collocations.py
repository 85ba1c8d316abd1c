"""Phrase collocations: multikey three-way quicksort of suffix pointers, routed by leading words.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``.  A word
travels as a 64-bit hash; the table of all distinct words proves that no two of a language share one (else another
seed is taken), so counts of hashes are counts of words.

1. Words are counted per language; pairs of frequent words are counted by a hash.  Both are summed per task first.
2. A suffix is up to five words from one place of a piece, cut before the first pair that is infrequent.  Frequent
   words and pairs are looked up in bit tables of at most ``FILTER_BITS`` bits: a false hit costs work, never a count.
   Tasks merge equal suffixes into one row with a weight, and the rows are stored.
3. Suffixes are routed to buckets by language and their leading two words.  A pair with more rows than the limit is
   routed by three words, a triple by four, and so on; there are at most rows/limit such prefixes of a length.
4. Each bucket runs the quicksort: pointers are split into less, equal and greater by the word at the current depth;
   equal ones go on one word deeper and their total weight is the count of that phrase; a part below ``min_count`` is
   abandoned.  Only the counts of prefixes that routing has split are summed up again behind it.
5. Every cut of a candidate is looked up by equi-joins on its two parts; scores are exact decimals.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count each time; equal
scores of two cuts go to the shorter first part, equal ranks follow score, count and the bytes of the phrase; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickfeat.llm.common import kept, shuffle_partitions, slices
from clickfeat.session import broadcast_rows

UNDETERMINED = "und"
MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
# Largest bit table that tells frequent words or pairs: 8 MB.
FILTER_BITS = 1 << 26
# Tokens a task merges at once, suffix rows of a bucket, and words a task remembers.
MERGE_TOKENS = 2_000_000
BUCKET_ROWS = 250_000
MEMO_WORDS = 500_000

# The characters that end a piece, and upper-case letters.
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes.maketrans(_UPPER + _BREAKS, _UPPER.lower() + b"." * len(_BREAKS))

Rows = tuple[str, list[bytes]]


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in order; ``.`` stands between pieces and texts."""
    joined = b".".join(texts).translate(_PLAIN)
    return joined.replace(b".", b" . ").split()


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """(language, tokens) of slices of documents."""
    for part in slices(batches):
        groups: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            groups.setdefault(lang, []).append(text)
        for lang, texts in groups.items():
            yield lang, tokens(texts)


class WordHashes:
    """Hashes of words; 0 stands for the end of a piece and for words that ``frequent`` does not hold."""

    def __init__(self, seed: int, frequent: np.ndarray | None = None):
        self.seed, self.frequent = seed, frequent
        self.memo: dict[bytes, int] = {b".": 0}

    def of(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) > MEMO_WORDS:
                memo.clear()
                memo[b"."] = 0
                new = set(words).difference(memo)
            found = list(new)
            memo.update(zip(found, (word_hash(w, self.seed) for w in found), strict=True))
        out = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        if self.frequent is not None and len(out):
            out[~holds(self.frequent, out)] = 0
        return out


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed) or 1


def pair_keys(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed = (mixed + second) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set; the table has a power of two of bits."""
    slot = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def documents_of(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, h, n, word and another word of the same hash if there is one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counter in sums.items():
                words = list(counter)
                for at in range(0, len(words), 20_000):
                    some = words[at : at + 20_000]
                    hashes = np.fromiter((word_hash(w, seed) for w in some), dtype=np.uint64, count=len(some))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some)),
                            signed(hashes),
                            pa.array(some, pa.binary()),
                            pa.array([counter[w] for w in some], pa.int64()),
                        ],
                        names=["lang", "h", "word", "n"],
                    )
            sums.clear()

        for lang, words in by_language(batches):
            counter = sums.setdefault(lang, Counter())
            counter.update(words)
            del counter[b"."]
            if sum(map(len, sums.values())) > MEMO_WORDS:
                yield from flush()
        yield from flush()

    counted = docs.mapInArrow(count, "lang string, h long, word binary, n long")
    return counted.groupBy("lang", "h").agg(
        F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other")
    )


def bit_table(keys: DataFrame, rows: int) -> np.ndarray:
    """Bits of the column ``key``, 16 for a row, at most ``FILTER_BITS``: collected in pieces of 8 KB."""
    bits = 1 << 16
    while bits < min(16 * rows, FILTER_BITS):
        bits *= 2

    def piece(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 16, dtype=np.uint8)
        own[table.column("slot").to_numpy() & 0xFFFF] = 1
        packed = np.packbits(own, bitorder="little").tobytes()
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([packed], pa.binary())})

    slots = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("slot")).distinct()
    pieces = slots.withColumn("piece", F.shiftright("slot", 16)).groupBy("piece").applyInArrow(piece, "piece long, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in pieces.collect():
        out[row["piece"] * 8192 : (row["piece"] + 1) * 8192] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def count_pairs(docs: DataFrame, seed: int, frequent) -> DataFrame:
    """key, n of all pairs of neighbouring frequent words; the key is a hash of language and words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed, frequent.value)
        waiting: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                keys, n = np.unique(np.concatenate(waiting), return_counts=True)
                waiting.clear()
                for at in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [signed(keys[at : at + 100_000]), pa.array(n[at : at + 100_000], pa.int64())], names=["key", "n"]
                    )

        for lang, words in by_language(batches):
            ids = hashes.of(words)
            first, second = ids[:-1], ids[1:]
            both = (first != 0) & (second != 0)
            if both.any():
                waiting.append(pair_keys(lang, first[both], second[both]))
            if sum(map(len, waiting)) > MERGE_TOKENS:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def suffixes_of(lang: str, ids: np.ndarray, pairs: np.ndarray, depth: int) -> np.ndarray:
    """Rows of ``depth`` hashes, one per place with a frequent pair; 0 behind the first infrequent pair."""
    if len(ids) < 2:
        return np.zeros((0, depth), dtype=np.uint64)
    good = (ids[:-1] != 0) & (ids[1:] != 0)
    good[good] = holds(pairs, pair_keys(lang, ids[:-1][good], ids[1:][good]))
    start = np.flatnonzero(good)
    out = np.zeros((len(start), depth), dtype=np.uint64)
    out[:, 0] = ids[start]
    padded = np.concatenate([good, np.zeros(depth, dtype=bool)])
    alive = np.ones(len(start), dtype=bool)
    for k in range(1, depth):
        alive &= padded[start + k - 1]
        out[alive, k] = ids[start[alive] + k]
    return out


def merged(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one with their summed weight."""
    if not len(rows):
        return rows, weight
    order = np.lexsort(rows.T[::-1])
    rows, weight = rows[order], weight[order]
    first = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[first], np.add.reduceat(weight, np.flatnonzero(first))


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of hashes as byte strings of eight bytes a word, without the zeros at the end."""
    size = (rows != 0).sum(axis=1) * 8
    raw = rows.astype(">u8").view(np.uint8).reshape(len(rows), -1)
    keep = np.arange(raw.shape[1])[None, :] < size[:, None]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[keep].tobytes())]
    )


def unpacked(strings: pa.Array, depth: int) -> np.ndarray:
    values = strings.to_pylist()
    raw = b"".join(v.ljust(depth * 8, b"\0") for v in values)
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(len(values), depth)


def suffix_rows(docs: DataFrame, seed: int, frequent, pairs, depth: int) -> DataFrame:
    """lang, s (packed words), n: the suffixes of all documents, merged per task."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed, frequent.value)
        waiting: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in waiting.items():
                rows = np.concatenate(parts)
                rows, n = merged(rows, np.ones(len(rows), dtype=np.int64))
                for at in range(0, len(rows), 50_000):
                    some = rows[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), packed(some), pa.array(n[at : at + 50_000])], names=["lang", "s", "n"]
                    )
            waiting.clear()

        held = 0
        for lang, words in by_language(batches):
            rows = suffixes_of(lang, hashes.of(words), pairs.value, depth)
            if len(rows):
                waiting.setdefault(lang, []).append(rows)
                held += len(rows)
            if held > MERGE_TOKENS // 2:
                yield from flush()
                held = 0
        yield from flush()

    return docs.mapInArrow(collect, "lang string, s binary, n long")


def frequent_prefixes(
    words: np.ndarray, weight: np.ndarray, routed: np.ndarray, least: int
) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort: (pointer, depth, count) of each prefix that reaches ``least``.

    A prefix shorter than ``routed`` has rows elsewhere too, so its part is reported however small it is.
    """
    depth = words.shape[1]
    parts = [(np.arange(len(words)), 0)]
    while parts:
        at, d = parts.pop()
        total = weight[at].sum()
        if total < least and not (routed[at] > d + 1).any():
            continue
        value = words[at, d]
        pivot = np.partition(value[:: max(1, len(value) // 9)][:9], min(4, (len(value) - 1) // 2))[min(4, (len(value) - 1) // 2)]
        less, equal = value < pivot, value == pivot
        if less.any():
            parts.append((at[less], d))
        greater = ~(less | equal)
        if greater.any():
            parts.append((at[greater], d))
        if pivot == 0:
            continue
        same = at[equal]
        count = int(weight[same].sum())
        if count >= least or routed[same[0]] > d + 1:
            yield int(same[0]), d + 1, count
            if d + 1 < depth:
                parts.append((same, d + 1))


def routes(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """Add ``routed``: by how many leading words a suffix is dealt, from two on while the prefix has too many rows.

    At most rows/limit prefixes of each length are over the limit: those lists are broadcast.
    """
    out = rows.withColumn("routed", F.lit(2))
    for size in range(2, depth):
        over = (
            out.filter((F.col("routed") == size) & (F.length("s") > size * 8))
            .groupBy("lang", F.substring("s", 1, size * 8).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > limit)
            .select("lang", "prefix")
        )
        over = kept(over)
        if over.isEmpty():
            break
        hot = over.select("lang", "prefix", F.lit(True).alias("hot"))
        out = (
            out.withColumn("prefix", F.substring("s", 1, size * 8))
            .join(F.broadcast(hot), ["lang", "prefix"], "left")
            .withColumn("routed", F.when(F.col("hot"), size + 1).otherwise(F.col("routed")))
            .drop("hot", "prefix")
        )
    return out


def count_phrases(rows: DataFrame, least: int, depth: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """lang, s, n of all phrases of two words and more with at least ``least`` occurrences."""
    spark = rows.sparkSession
    total = rows.count()
    buckets = max(shuffle_partitions(spark), -(-total // bucket_rows))
    routed = routes(rows, max(1000, total // (4 * buckets)), depth)
    lead = F.expr("substring(s, 1, routed * 8)")
    dealt = routed.withColumn("bucket", F.pmod(F.xxhash64("lang", lead), F.lit(buckets)).cast("int"))

    def sort(table: pa.Table) -> pa.Table:
        langs, found, counts = [], [], []
        codes = table.column("lang").combine_chunks().dictionary_encode()
        code = codes.indices.to_numpy()
        strings = table.column("s").combine_chunks()
        weights, routes_ = table.column("n").to_numpy(), table.column("routed").to_numpy()
        for c, lang in enumerate(codes.dictionary.to_pylist()):
            at = np.flatnonzero(code == c)
            words = unpacked(strings.take(pa.array(at)), depth)
            for row, d, count in frequent_prefixes(words, weights[at], routes_[at], least):
                if d > 1:
                    langs.append(lang)
                    found.append(words[row, :d].astype(">u8").tobytes())
                    counts.append(count)
        return pa.table({"lang": pa.array(langs, pa.string()), "s": pa.array(found, pa.binary()), "n": pa.array(counts, pa.int64())})

    counted = dealt.groupBy("bucket").applyInArrow(sort, "lang string, s binary, n long")
    return counted.groupBy("lang", "s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def without_inner(phrases: DataFrame) -> DataFrame:
    """Phrases that lie in no longer phrase as frequent as themselves; one word longer is enough to look at."""
    size = F.length("s")
    inner = F.array(F.expr("substring(s, 1, length(s) - 8)"), F.expr("substring(s, 9)"))
    over = (
        phrases.filter(size > 16)
        .select("lang", F.explode(F.array_distinct(inner)).alias("s"), F.col("n").alias("outer"))
        .groupBy("lang", "s")
        .agg(F.max("outer").alias("outer"))
    )
    joined = phrases.join(over, ["lang", "s"], "left")
    return joined.filter(F.col("outer").isNull() | (100 * F.col("outer") < 100 * F.col("n"))).drop("outer")


def best_cuts(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, s, a, l, r, n, score: the lowest-scoring cut of each candidate."""
    cuts = candidates.select(
        "lang", "s", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), (F.length("s") / 8 - 1).cast("int"))).alias("k")
    )
    cuts = cuts.withColumn("head", F.expr("substring(s, 1, k * 8)")).withColumn("rest", F.expr("substring(s, k * 8 + 1)"))
    left = counts.select("lang", F.col("s").alias("head"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("s").alias("rest"), F.col("n").alias("r"))
    # One row per language: broadcast when counted small, for a language may hold most candidates.
    small = totals.count() <= broadcast_rows(totals.sparkSession)
    found = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    found = found.join(F.broadcast(totals) if small else totals, "lang")

    def exact(c: str) -> Column:
        return F.col(c).cast("decimal(16,0)")

    over = F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")
    scored = found.withColumn("over", over).withColumn("under", exact("l") * exact("r")).withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best")
    return scored.groupBy("lang", "s").agg(best).select("lang", "s", *[f"best.{c}" for c in ("a", "l", "r", "n", "score")])


def with_text(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``phrase``: the words of ``s``, joined by spaces."""
    places = rows.select("lang", "s", F.explode(F.expr("sequence(1, cast(length(s) div 8 as int))")).alias("k"))
    piece = F.conv(F.hex(F.expr("substring(s, k * 8 - 7, 8)")), 16, -10).cast("long")
    named = places.withColumn("h", piece).join(words.select("lang", "h", "word"), ["lang", "h"])
    texts = named.groupBy("lang", "s").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"))
    phrase = F.array_join(F.transform("w", lambda x: x["word"].cast("string")), " ").alias("phrase")
    return rows.join(texts.select("lang", "s", phrase), ["lang", "s"])


def top_rows(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; parts are ranked first and merged by 32, so that no task sorts a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = 4 * shuffle_partitions(rows.sparkSession)
    out = rows.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(parts)))
    while True:
        within = Window.partitionBy("lang", "part").orderBy(*order)
        out = out.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= top)
        if parts == 1:
            return out.drop("part")
        parts = -(-parts // 32)
        out = out.withColumn("part", F.pmod(F.col("part"), F.lit(parts)))


def collocations(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    bucket_rows: int = BUCKET_ROWS,
    hasher: Callable[[int], int] = lambda attempt: attempt,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language.  ``hasher`` gives the seed of an attempt."""
    spark: SparkSession = df.sparkSession
    docs = documents_of(df, text_col, lang_col)
    attempt = 0
    while True:
        seed = hasher(attempt)
        words = kept(count_words(docs, seed))
        if words.filter(F.col("word") != F.col("other")).isEmpty():
            break
        attempt += 1  # two words of a language share a hash
    share = spark.sparkContext.broadcast
    often = words.filter(F.col("n") >= min_count)
    frequent = share(bit_table(often.select(F.col("h").alias("key")), often.count()))
    pairs = kept(count_pairs(docs, seed, frequent).filter(F.col("n") >= min_count))
    linked = share(bit_table(pairs, pairs.count()))
    rows = kept(suffix_rows(docs, seed, frequent, linked, max_words))
    phrases = kept(count_phrases(rows, min_count, max_words, bucket_rows))
    single = often.select("lang", F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("s"), "n")
    totals = kept(words.groupBy("lang").agg(F.sum("n").alias("n")))
    scored = kept(best_cuts(without_inner(phrases), phrases.unionByName(single), totals))
    best = top_rows(with_text(scored, often), top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
