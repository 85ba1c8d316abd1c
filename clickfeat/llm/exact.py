"""Exact dedup by content-defined chunk recipes.

Texts are equal when identical after deleting all ASCII white space.  A rolling hash over the normalised bytes
cuts them into chunks; a chunk's identifier is a 128-bit digest, verified by comparing the contents of all chunks
that share it.  A document's recipe is the ordered list of its chunk identifiers.  Only chunk contents (once per
task and distinct chunk) and recipes are shuffled; documents stay where they are.

Two chunks of different content under one identifier would be told apart by a number added to the identifier; the
table of such contents is all that reaches the driver, and is empty unless 128-bit digests collide.

Defined cases: null text is empty; all texts without a letter or sign are equal to the empty text; of equal texts
the row with the most code points stays, then the smallest doc_id (a null id comes last); of rows that repeat both
id and text one stays; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.llm.common import kept, slices, stored, texts_of

WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 32  # bytes a cut depends on; below MIN_CHUNK, so a cut never depends on the text before the document
MIN_CHUNK = 256
MEAN_BITS = 10
MAX_CHUNK = 8192
DIGEST = 16
SEEN = 300_000  # distinct chunks a task remembers at once

_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, size=256, dtype=np.uint32)

Collisions = dict[bytes, list[bytes]]


def cut_points(normalised: list[bytes]) -> list[list[int]]:
    """For each text, the ends of its chunks; an empty text has one empty chunk."""
    joined = np.frombuffer(b"".join(normalised), dtype=np.uint8)
    rolled = _GEAR[joined]
    width = 1
    while width < WINDOW:
        rolled[width:] += rolled[:-width] << np.uint32(width)
        width *= 2
    marks = np.flatnonzero(rolled >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, at = [], 0
    for text in normalised:
        end = at + len(text)
        lo, hi = np.searchsorted(marks, (at, end))
        cuts, last = [], 0
        for mark in (marks[lo:hi] - at).tolist():
            while mark - last > MAX_CHUNK:
                last += MAX_CHUNK
                cuts.append(last)
            if mark - last >= MIN_CHUNK:
                cuts.append(last := mark)
        while len(text) - last > MAX_CHUNK:
            last += MAX_CHUNK
            cuts.append(last)
        if not cuts or last < len(text):
            cuts.append(len(text))
        out.append(cuts)
        at = end
    return out


def _chunked(texts: list[str], digest: int) -> Iterator[tuple[bytes, list[tuple[bytes, bytes]]]]:
    """Normalised bytes and (identifier, content) of the chunks, for each text."""
    normalised = [t.encode("utf-8", "surrogatepass").translate(None, WHITE) for t in texts]
    for text, cuts in zip(normalised, cut_points(normalised), strict=True):
        parts, last = [], 0
        for cut in cuts:
            part = text[last:cut]
            parts.append((hashlib.blake2b(part, digest_size=digest).digest(), part))
            last = cut
        yield text, parts


def colliding_chunks(rows: DataFrame, digest: int = DIGEST) -> Collisions:
    """Compare the contents of all chunks with equal identifiers; what differs, by identifier."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches):
            ids, contents = [], []
            for _, parts in _chunked(part.column(0).to_pylist(), digest):
                for chunk_id, content in parts:
                    key = chunk_id if digest >= DIGEST else chunk_id + content
                    if key not in seen:
                        seen.add(key)
                        ids.append(chunk_id)
                        contents.append(content)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], ["id", "data"])

    found = rows.select("text").mapInArrow(chunks, "id binary, data binary")
    differing = (
        found.groupBy("id").agg(F.min("data").alias("lo"), F.max("data").alias("hi")).filter(F.col("lo") != F.col("hi"))
    ).select("id").collect()
    if not differing:
        return {}
    contents = found.join(F.broadcast(rows.sparkSession.createDataFrame(differing, "id binary")), "id").distinct()
    out: Collisions = {}
    for chunk_id, data in contents.orderBy("id", "data").collect():
        out.setdefault(bytes(chunk_id), []).append(bytes(data))
    return out


def recipes(rows: DataFrame, collisions: Collisions, digest: int = DIGEST) -> DataFrame:
    """doc_id, n_chars, text_sha256 (normalised text), recipe (identifiers, joined)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            shas, lists = [], []
            for text, parts in _chunked(texts, digest):
                shas.append(hashlib.sha256(text).hexdigest())
                lists.append(
                    b"".join(
                        i + collisions[i].index(data).to_bytes(4, "big") if i in collisions else i for i, data in parts
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array(lists, pa.binary()),
                ],
                ["doc_id", "n_chars", "text_sha256", "recipe"],
            )

    return rows.mapInArrow(build, "doc_id long, n_chars long, text_sha256 string, recipe binary")


def exact_groups(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: int = DIGEST
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    rows = texts_of(df, id_col, text_col)
    listed = stored(recipes(rows, colliding_chunks(rows, digest), digest), "recipes")
    groups = kept(
        listed.groupBy("recipe").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id")).alias("best"),
        )
    )
    # Rows that repeat id and text differ in nothing: they are counted, and the first of them can stay.
    repeated = listed.groupBy("doc_id", "recipe", "n_chars", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    joined = repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).join(groups, "recipe")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.c")) & (F.col("copy") == 1)
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        stays.alias("kept"),
        "text_sha256",
        (F.length("recipe") / digest).cast("long").alias("n_chunks"),
    )
