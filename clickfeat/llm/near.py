"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Each of several independent trees sends a document along a path
that its own minwise tokens choose: at the root one token position per tree, below it ``BRANCHES`` positions that a
hash of the path selects, so that two similar sets stay together with high probability and others part.  Nodes of at
most ``SMALL`` documents are compared exhaustively, larger nodes that hold a family of copies, or that stay large at
the end, by the rare shingles of their members; other nodes branch on.  Every candidate pair is confirmed on the full sets.

Recall: at similarity 0.8 a pair misses a tree's root node with probability 0.2 and each of at most three lower nodes
with 0.2**2, so it misses all 10 trees with a probability below 5e-6.  Rows with the same words are one class and need no comparison.

Defined cases: a document without words (or with null text) is empty, linked with nothing and kept; rows that repeat a
document are in its class; a row with a null id takes no part, has a null component and is kept; other columns are
ignored; an empty table gives no rows.  Ids name documents: rows that repeat an id with other words are linked by the
words of each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.llm.common import kept, pruned, slices, stored, texts_of
from clickfeat.llm.similar import HASHES, WordHashes, linked_components, two_bits, min_hashes, shingle_set, words_of

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
TREES = 10
TOKENS = 64
BRANCHES = 2
SMALL = 16


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class (digest of the words), roots (a root token per tree), sketch (16 bits per position), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            sizes, classes, roots, sketches, bits = [], [], [], [], []
            for text in part.column(1).to_pylist():
                found = words_of(text)
                shingles = shingle_set(found, words, hashes)
                tokens = min_hashes(shingles, HASHES)
                sizes.append(len(shingles))
                classes.append(hashlib.blake2b(b" ".join(found), digest_size=16).digest())
                tree = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                roots.append(((tokens[:TREES] + tree) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
                sketches.append((tokens[:TOKENS] >> np.uint64(20)).astype(np.uint16).tobytes())
                bits.append(two_bits(tokens))
            columns = [
                part.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(classes, pa.binary()),
                pa.array(roots, pa.list_(pa.int64())),
                pa.array(sketches, pa.binary()),
                pa.array(bits, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "roots", "sketch", "bits"])

    return rows.mapInArrow(
        run, "doc_id long, n_shingles long, class binary, roots array<long>, sketch binary, bits array<long>"
    )


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """id, shingles of each row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            sets = [shingle_set(words_of(t), words, hashes).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles binary")


def near_groups(
    df: DataFrame,
    *,
    words: int = WORDS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = texts_of(df, id_col, text_col)
    signed = stored(signatures(rows, words), "signatures")
    # The first id of each class stands for it.
    classes = kept(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("id"))
    )
    heads = signed.join(classes.select("class", F.col("id").alias("doc_id")), ["class", "doc_id"], "left_semi")
    heads = heads.dropDuplicates(["class", "doc_id"])
    heads = heads.select(F.col("doc_id").alias("id"), "roots", "sketch", "bits", F.col("n_shingles").alias("size"))
    heads = stored(heads, "heads")

    def sets_of(ids: DataFrame) -> DataFrame:
        # Texts stay where they are; only sets of the ids (and of a few others) are moved, by the joins that use them.
        return stored(shingle_sets(pruned(rows, ids, "doc_id"), words), "shingles")

    def split(mixed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        few = F.col("n") <= SMALL
        large = mixed.filter(~few).select("node", "id").join(heads.select("id", "sketch"), "id")
        spare = TOKENS - TREES
        start = F.pmod(F.col("node"), F.lit(spare))
        children = []
        for b in range(BRANCHES):
            position = F.lit(TREES) + F.pmod(start + b * (spare // BRANCHES), F.lit(spare))
            token = F.col("sketch").substr((position * 2 + 1).cast("int"), F.lit(2))
            children.append(F.xxhash64("node", position, token))
        below = large.select(F.explode(F.array(*children)).alias("node"), F.lit(-1).alias("place"), "id")
        return mixed.filter(few), kept(below)

    comp = linked_components(heads, sets_of, numerator, denominator, split, small=SMALL)
    named = kept(
        classes.join(comp.select("id", "component"), "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    )
    linked = signed.join(named, "class", "left")
    inside = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return linked.select(
        "doc_id", "n_shingles", F.when(inside, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
