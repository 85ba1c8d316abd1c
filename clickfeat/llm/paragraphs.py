"""Substring dedup: paragraphs that repeat, nearly or exactly, across documents.

Two kinds of unit are compared.  A *paragraph* is a line of at least ``MIN_WORDS`` words: min-hashes of its word
shingles are cut into bands, paragraphs that collide in a band are joined, the exact Jaccard similarity of the full
shingle sets decides, and connected components give the clusters.  With 16 bands of 3 a pair at similarity 0.8 is
missed with a probability of 1e-5.

A passage pasted into the middle of other text shares no line with its copies.  So the second kind of unit is a
*window* of ``WINDOW`` words that starts at an anchor: the least of ``SPREAD`` neighbouring shingle hashes.  Anchors
depend on nothing but the words around them, and every run of ``SPREAD + WINDOW - 1`` = 51 shared words holds at
least one window that both documents have; windows are compared by a 128-bit hash of their words.  Runs of fewer
than 32 words are never reported.

Only clusters that span two documents or more are returned, with all their members; the member that comes first by
(doc_id, position) is kept, the others are to be removed.

Defined cases: null text is empty and has no unit; words are taken between ASCII white space and A-Z lower-cased;
repeated rows (same id) do not repeat "across documents"; rows with a null id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.llm.common import kept, pruned, slices, stored, texts_of
from clickfeat.llm.similar import HASHES, linked_components, min_hashes_of_each, shingle_values, two_bits, words_of

MIN_WORDS = 50
SHINGLE = 5
BANDS, ROWS = 16, 3
NUMERATOR, DENOMINATOR = 80, 100
WINDOW, SPREAD = 32, 20
# Rows of a band above which its pairs are looked for by their rare shingles.
SMALL = 64
# Bytes of text, or of sets, a task works on at once; one row may have more.
BLOCK_BYTES = 1 << 20

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


def blocks(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices that hold few bytes in a column, or one row: their words are worked on together."""
    for part in slices(batches):
        place = np.cumsum(pc.binary_length(part.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), part.num_rows]
        for start, end in pairwise(cuts):
            yield part.slice(start, end - start)


def hashes_of(words: list[bytes]) -> bytes:
    """64-bit hashes of words; most words of a text are rare, so that remembering them costs more than it spares."""
    return b"".join(map(xxhash.xxh64_digest, words))


def joined(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64)


def anchored_windows(each: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts of ``counts`` words, given as the hashes of their words, one text after the other.

    Returns the text of each window, its start there, and a 128-bit hash of its words as two columns.
    """
    count = len(each) - SHINGLE + 1
    if count < SPREAD or len(each) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.uint64)
    value = np.zeros(count, dtype=np.uint64)
    for i in range(SHINGLE):
        value = (value ^ (value >> np.uint64(29))) * _BASES[0] + each[i : count + i]
    least = (value ^ (value >> np.uint64(32))) * _BASES[1]
    # The first of the least values among 2, 4, 8, 16 and at last SPREAD neighbours.
    at, width = np.arange(count), 1
    while width < SPREAD:
        step = min(width, SPREAD - width)
        left, right = least[:-step], least[step:]
        at = np.where(right < left, at[step:], at[:-step])
        least = np.minimum(left, right)
        width += step
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    # Neighbours of one text only; their anchors never step back, so equal ones stand together.
    at = at[text[: len(at)] == text[SPREAD + SHINGLE - 2 :]]
    starts = at[np.diff(at, prepend=-1) != 0]
    starts = starts[starts + WINDOW <= ends[text[starts]]]
    hashes = np.empty((len(starts), 2), dtype=np.uint64)
    for k, (base, inverse) in enumerate(zip(_BASES, _INVERSES, strict=True)):
        powers = np.full(len(each), base, dtype=np.uint64)
        powers[0] = 1
        mixed = (each ^ (each >> np.uint64(31 + k))) * (base + np.uint64(2))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * np.cumprod(powers))])
        back = np.full(len(each), inverse, dtype=np.uint64)
        back[0] = 1
        hashes[:, k] = (sums[starts + WINDOW] - sums[starts]) * np.cumprod(back)[starts]
    text = text[starts]
    return text, starts - (ends - counts)[text], hashes


def window_table(rows: DataFrame) -> DataFrame:
    """doc_id, start, key1, key2 of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            hashes = [hashes_of(words_of(text)) for text in part.column(1).to_pylist()]
            text, starts, keys = anchored_windows(joined(hashes), np.array([len(x) // 8 for x in hashes], dtype=np.int64))
            docs = part.column(0).to_numpy(zero_copy_only=False)[text]
            keys = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs), pa.array(starts), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                ["doc_id", "start", "key1", "key2"],
            )

    return rows.mapInArrow(run, "doc_id long, start long, key1 long, key2 long")


def lines_of(text: str, min_words: int) -> list[tuple[int, list[bytes]]]:
    """(first word, words) of the lines with enough words."""
    out, at = [], 0
    for line in text.split("\n"):
        words = words_of(line)
        if len(words) >= min_words:
            out.append((at, words))
        at += len(words)
    return out


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def line_shingles(each: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of lines of ``sizes`` words, given as the hashes of their words, and how many shingles each line has.

    Of fewer than ``SHINGLE`` words, the whole line is one shingle.  Shingles may repeat within a line.
    """
    counts = np.where(sizes < SHINGLE, np.minimum(sizes, 1), sizes - SHINGLE + 1)
    line = np.repeat(np.arange(len(sizes)), sizes)
    values = shingle_values(each, SHINGLE)
    values = values[line[: len(values)] == line[SHINGLE - 1 :]]
    short = np.flatnonzero((sizes < SHINGLE) & (sizes > 0))
    if len(short):
        ends = np.cumsum(sizes)
        whole = [shingle_values(each[ends[i] - sizes[i] : ends[i]], int(sizes[i])) for i in short]
        values = np.insert(values, (np.cumsum(counts) - counts)[short] - np.arange(len(short)), np.concatenate(whole))
    return values, counts


def line_columns(part: pa.RecordBatch, min_words: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Columns doc_id, start, n_words and class of the lines of a block, their shingles and the counts of these."""
    docs, starts, sizes, classes, hashes = [], [], [], [], []
    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
        for start, words in lines_of(text, min_words):
            docs.append(doc)
            starts.append(start)
            sizes.append(len(words))
            classes.append(digest_of(words))
            hashes.append(hashes_of(words))
    columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary())]
    return columns, *line_shingles(joined(hashes), np.array(sizes, dtype=np.int64))


def paragraph_table(rows: DataFrame, min_words: int) -> DataFrame:
    """doc_id, start, n_words, class (digest of the words), bands of every paragraph; bands need few of the min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            columns, shingles, counts = line_columns(part, min_words)
            tokens = min_hashes_of_each(shingles, counts, BANDS * ROWS).reshape(-1, BANDS, ROWS)
            bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(tokens), 1))
            for row in range(ROWS):
                bands = (bands ^ (bands >> np.uint64(29))) * _BASES[0] + tokens[:, :, row]
            places = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * BANDS)
            bands = pa.ListArray.from_arrays(places, pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, bands], ["doc_id", "start", "n_words", "class", "bands"])

    return rows.mapInArrow(run, "doc_id long, start long, n_words long, class binary, bands array<long>")


def paragraph_sets(rows: DataFrame, min_words: int) -> DataFrame:
    """class, id (doc_id, start) and shingles of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            (docs, starts, _, classes), shingles, counts = line_columns(part, min_words)
            places = np.concatenate([[0], np.cumsum(counts)]).tolist()
            sets = [np.unique(shingles[a:b]).tobytes() for a, b in pairwise(places)]
            columns = [docs, starts, classes, pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "class", "shingles"])

    made = rows.mapInArrow(run, "doc_id long, start long, class binary, shingles binary")
    return made.select("class", F.struct("doc_id", "start").alias("id"), "shingles")


def bits_of(sets: DataFrame) -> DataFrame:
    """class, id, two bits of each min-hash of a set, and its size, once for rows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 2):
            found = part.column(2).to_pylist()
            counts = np.array([len(x) // 8 for x in found], dtype=np.int64)
            hashes = min_hashes_of_each(np.frombuffer(b"".join(found), dtype=np.uint64), counts, HASHES)
            columns = [part.column(0), part.column(1), pa.array([two_bits(x) for x in hashes], pa.list_(pa.int64())), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, ["class", "id", "bits", "size"])

    made = sets.mapInArrow(run, "class binary, id struct<doc_id: long, start: long>, bits array<long>, size long")
    return made.dropDuplicates(["class", "id"])


def in_shared_bands(classes: DataFrame) -> DataFrame:
    """The classes that share a band with another one (and a few others); most share none and are compared with nothing."""
    bands = classes.select("class", F.posexplode("roots").alias("place", "root"))
    bands = bands.select("class", F.xxhash64("place", "root").alias("node"))
    several = bands.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    near = pruned(bands, kept(several), "node").select("class").distinct()
    return pruned(classes, kept(near), "class")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_words, first (doc_id, start of the first member), n_docs, for windows of two documents or more."""
    windows = stored(window_table(rows), "windows")
    keys = ["key1", "key2"]
    # Half of the key, and a bit map of those that repeat, leave few windows to compare by the whole key.
    ends = windows.groupBy("key1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    repeated = kept(ends.filter("lo <> hi").select("key1"))
    members = stored(pruned(windows, repeated, "key1"), "repeated")
    # A document counts once; the first member comes from its counts, so that members are dealt by their key once here.
    docs = members.groupBy(*keys, "doc_id").agg(F.min("start").alias("start"))
    described = docs.groupBy(*keys).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n_docs"))
    described = kept(described.filter("n_docs > 1"))
    return members.join(described, keys).select("doc_id", "start", F.lit(WINDOW).cast("long").alias("n_words"), "first", "n_docs")


def repeated_paragraphs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The same columns for paragraphs at similarity 0.8 or more, by components."""
    units = stored(paragraph_table(rows, min_words), "paragraphs")
    # Paragraphs of the same words have the same bands; the first of them stands for all.
    first = F.min(F.struct("doc_id", "start")).alias("id")
    classes = units.groupBy("class").agg(first, F.max("doc_id").alias("last"), F.first("bands").alias("roots"))
    classes = stored(classes, "classes")
    heads = kept(in_shared_bands(classes).select("class", "id", "roots"))
    # Texts stay where they are: only sets of these heads (and of a few others) are worked out and moved.
    docs = heads.select(F.col("id.doc_id").alias("doc_id")).distinct()
    sets = stored(pruned(paragraph_sets(pruned(rows, docs, "doc_id"), min_words), heads.select("id"), "id"), "shingles")
    heads = stored(heads.join(bits_of(sets), ["class", "id"]).select("id", "roots", "bits", "size"), "heads")

    def sets_of(ids: DataFrame) -> DataFrame:
        return pruned(sets.select("id", "shingles"), ids, "id")

    comp = linked_components(heads, sets_of, NUMERATOR, DENOMINATOR, small=SMALL)
    linked = classes.select("class", "id", "last").join(comp.withColumnRenamed("component", "first"), "id", "left")
    # A class of one document without a link is in no result.
    linked = linked.filter(F.col("first").isNotNull() | (F.col("last") != F.col("id.doc_id")))
    named = kept(linked.select("class", F.coalesce("first", "id").alias("first")))
    members = pruned(units.select("doc_id", "start", "n_words", "class"), named.select("class"), "class").join(named, "class")
    members = stored(members.select("doc_id", "start", "n_words", "first"), "members")
    docs = members.select("first", "doc_id").distinct().groupBy("first").agg(F.count(F.lit(1)).alias("n_docs"))
    return members.join(kept(docs.filter("n_docs > 1")), "first").select("doc_id", "start", "n_words", "first", "n_docs")


def repeated_passages(
    df: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, kind, start_word, n_words, first_doc_id, first_start_word, n_docs, kept: every member of every cluster."""
    rows = texts_of(df, id_col, text_col).filter(F.col("doc_id").isNotNull())
    kinds = [
        repeated_paragraphs(rows, min_words).withColumn("kind", F.lit("paragraph")),
        repeated_windows(rows).withColumn("kind", F.lit("window")),
    ]
    both = kinds[0].unionByName(kinds[1])
    return both.select(
        "doc_id",
        "kind",
        F.col("start").alias("start_word"),
        "n_words",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.start").alias("first_start_word"),
        "n_docs",
        ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))).alias("kept"),
    )
