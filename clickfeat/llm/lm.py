"""Cross-entropy difference of two matched n-gram models.

The tokens are characters.  The background model counts all documents, the target model the labelled ones among them;
both share one vocabulary, order and smoothing and are counted in one pass over whole texts.  An n-gram's
probability is its frequency after its context, smoothed towards the probability of the shorter n-gram
(``WEIGHT`` pseudo counts), down to a uniform vocabulary.  A document's score is its mean over tokens of
(target loss - background loss), in nats: the lower, the more it reads like the target.  A document is scored by counts
without its own, in both models, so that it cannot vouch for itself and labelled documents fare no worse or better
than equal ones without a label.  The uniform vocabulary is the distinct characters counted, the boundary included.

Counts are exact and stay in Spark: one row (n-gram, background count, target count) for each distinct n-gram, however
many the corpus has.  Documents are dealt into blocks of about ``BLOCK`` characters.  A block's distinct n-grams, with
their counts in it, are summed over all blocks and joined with the sums; a task holds one block and its n-grams only.
``train`` and ``ngram_slots`` are the same models with hashed slots in memory (``BITS``), for small corpora.

Defined cases: null or empty text has no tokens, n_tokens 0 and null losses; a document belongs to the target if any
of its label rows has the target value; repeated rows count as often as they occur; without target rows the target
model is uniform; other columns are ignored; an empty corpus gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.llm.common import slices, stored, texts_of

ORDER = 4
BITS = (16, 18, 20, 20)  # slots of each order
WEIGHT = 4.0
PAD = ORDER - 1
BLOCK = 4_000_000  # characters


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the documents, each after ``PAD`` boundary tokens; starts, lengths and boundary positions."""
    codes = np.frombuffer("".join("\0" * PAD + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + PAD for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return codes, starts, lengths, (starts[:, None] + np.arange(PAD)).ravel()


def ngram_slots(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of the n-gram that ends at each position, per order; starts and lengths of the documents.

    N-grams that end in boundary tokens stand for the boundary alone.
    """
    codes, starts, lengths, pads = padded(texts)
    out = []
    value = np.zeros(len(codes), dtype=np.uint64)
    for order, bits in enumerate(BITS):
        value[order:] += codes[: len(codes) - order] * np.uint64(pow(0x110001, order, 1 << 64))
        mixed = (value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        slot = (mixed >> np.uint64(64 - bits)).astype(np.int32)
        slot[pads] = 0
        out.append(slot)
    return out, starts, lengths


def ngram_ids(texts: list[str]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """As ``ngram_slots``, with dense numbers in place of slots, and the n-gram of each number, per order.

    An n-gram is two integers (order and up to two code points, two code points); number 0 is the boundary.
    """
    codes, starts, lengths, pads = padded(texts)
    first = pa.array(codes).dictionary_encode()
    one, alphabet = first.indices.to_numpy().astype(np.int64), first.dictionary.to_numpy().astype(np.int64)
    now, parts = one, [alphabet]
    slots, grams = [], []
    for order in range(ORDER):
        if order:
            joined = pa.array(np.concatenate([now[:1] * 0, now[:-1]]) * len(alphabet) + one).dictionary_encode()
            now, pairs = joined.indices.to_numpy().astype(np.int64), joined.dictionary.to_numpy()
            parts = [alphabet[pairs % len(alphabet)], *(p[pairs // len(alphabet)] for p in parts)]
        none = np.zeros_like(parts[0])
        last = [*parts, *[none] * PAD][:ORDER]
        high, low = (order << 42) + (last[3] << 21) + last[2], (last[1] << 21) + last[0]
        grams.append((np.concatenate([[-1 - order], high]), np.concatenate([[0], low])))
        slot = (now + 1).astype(np.int32)
        slot[pads] = 0
        slots.append(slot)
    return slots, grams, starts, lengths


@dataclass
class NgramModels:
    """Counts per order for background (row 0) and target (row 1); the tokens of each and the distinct ones, if not all
    are in the counts."""

    counts: list[np.ndarray]
    totals: tuple[int, int] | None = None
    vocabulary: int | None = None

    def __post_init__(self) -> None:
        # Zero between uses.
        self.counters = [np.zeros(table.shape[1], dtype=np.int64) for table in self.counts]

    def losses(self, model: int, slots: list[np.ndarray], own: list[np.ndarray], left: np.ndarray) -> np.ndarray:
        """Loss at each position; ``own`` are counts to leave out, per order and position, ``left`` their tokens."""
        distinct = np.count_nonzero(self.counts[0][0]) if self.vocabulary is None else self.vocabulary
        p = np.float64(1.0) / max(distinct, 1)
        total = self.totals[model] if self.totals else self.counts[0][model].sum(dtype=np.float64)
        context = float(total) - left
        for order, slot in enumerate(slots):
            seen = self.counts[order][model][slot].astype(np.float64) - own[order]
            # Slots may be shared by chance; an n-gram is not seen more often than its context.
            p = (np.minimum(seen, context) + WEIGHT * p) / (context + WEIGHT)
            context = np.concatenate([seen[:1] * 0, seen[:-1]])
        return -np.log(p)

    def score(self, texts: list[str], target: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, mean target loss and mean background loss of each text."""
        return self.score_slots(*ngram_slots(texts), target)

    def score_slots(
        self, slots: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray, target: list[bool]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scored = np.ones(len(slots[0]))
        scored[(starts[:, None] + np.arange(PAD)).ravel()] = 0.0
        own = [np.empty(len(s), dtype=np.int64) for s in slots]
        for i, start in enumerate(starts):
            part = slice(start, start + lengths[i])
            for counter, s, out in zip(self.counters, slots, own, strict=True):
                mine = s[part]
                np.add.at(counter, mine, 1)
                out[part] = counter[mine]
                counter[mine] = 0
        left, chosen = np.repeat(lengths, lengths), np.repeat(np.array(target, dtype=bool), lengths)
        background = self.losses(0, slots, own, left)
        of_target = self.losses(1, slots, [o * chosen for o in own], left * chosen)
        sums = [np.add.reduceat(x * scored, starts) for x in (background, of_target)]
        n = lengths - PAD
        with np.errstate(invalid="ignore"):
            return n, sums[1] / np.maximum(n, 1), sums[0] / np.maximum(n, 1)


def with_target(docs: DataFrame, labels: DataFrame, label_col: str, target: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, target (whether a label row of the document has the target value)."""
    chosen = labels.filter(F.col(label_col) == target).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    rows = texts_of(docs, id_col, text_col)
    # The same plan at every size: a target list that just fits a broadcast would not fit with more labels.
    flagged = rows.join(chosen.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
    return flagged.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def train(rows: DataFrame) -> NgramModels:
    """Count both models over all rows of (doc_id, text, target)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, 1 << bits), dtype=np.int64) for bits in BITS]
        for part in slices(batches):
            texts, target = part.column(0).to_pylist(), part.column(1).to_pylist()
            for model, own in ((0, texts), (1, [t for t, yes in zip(texts, target, strict=True) if yes])):
                if own:
                    for table, slot in zip(sums, ngram_slots(own)[0], strict=True):
                        table[model] += np.bincount(slot, minlength=table.shape[1])
        for order, table in enumerate(sums):
            for model in (0, 1):
                at = np.flatnonzero(table[model])
                for i in range(0, len(at), 200_000):
                    some = at[i : i + 200_000]
                    key = some << 3 | order << 1 | model
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(table[model][some])], ["slot", "n"])

    summed = rows.select("text", "target").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # At most two rows for each slot of each order.
    found = summed.toPandas()
    slot, n = found["slot"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float32)
    tables = []
    for order, bits in enumerate(BITS):
        table = np.zeros((2, 1 << bits), dtype=np.float32)
        at = (slot >> 1 & 3) == order
        table[slot[at] & 1, slot[at] >> 3] = n[at]
        tables.append(table)
    return NgramModels(tables)


def in_blocks(rows: DataFrame) -> DataFrame:
    """doc_id, text, target, block: neighbouring rows of about ``BLOCK`` characters, fixed by being stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for part in slices(batches):
            blocks = []
            for size in pc.utf8_length(part.column(1)).to_pylist():
                if held and held + size + PAD > BLOCK:
                    block, held = block + 1, 0
                held += size + PAD
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blocks, pa.int64())], ["doc_id", "text", "target", "block"])

    return stored(rows.mapInArrow(run, "doc_id long, text string, target boolean, block long"), "blocks")


def block_counts(rows: DataFrame) -> DataFrame:
    """block, high, low, n, m: the distinct n-grams of each block, with background and target counts in it."""

    def counted(block: int, texts: list[str], target: list[bool]) -> pa.RecordBatch:
        slots, grams, _, lengths = ngram_ids(texts)
        chosen = np.repeat(np.array(target, dtype=bool), lengths)
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for slot, (high, low) in zip(slots, grams, strict=True):
            n = np.bincount(slot, minlength=len(high))
            m = np.bincount(slot[chosen], minlength=len(high))
            # N-grams that end in boundary tokens only are counted as boundaries.
            at = np.flatnonzero(n)
            for column, values in zip(columns, (high, low, n, m), strict=True):
                column.append(values[at])
        arrays = [pa.array(np.concatenate(c), pa.int64()) for c in columns]
        same = pa.array(np.full(len(arrays[0]), block), pa.int64())
        return pa.RecordBatch.from_arrays([same, *arrays], ["block", "high", "low", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, target = None, [], []
        for part in slices(batches):
            for text, yes, block in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if block != now and texts:
                    yield counted(now, texts, target)
                    texts, target = [], []
                now = block
                texts.append(text)
                target.append(yes)
        if texts:
            yield counted(now, texts, target)

    made = rows.select("text", "target", "block").mapInArrow(run, "block long, high long, low long, n long, m long")
    return stored(made, "ngrams")


def score(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of (doc_id, text, target)."""
    rows = in_blocks(rows)
    grams = block_counts(rows)
    sums = grams.groupBy("high", "low").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    found = grams.select("block", "high", "low").join(sums.hint("merge"), ["high", "low"])
    characters = grams.filter("high = -1 or (high >= 0 and shiftright(high, 42) = 0)")
    tokens = characters.agg(F.sum("n"), F.sum("m"), F.count_distinct("high", "low")).first()
    totals, vocabulary = (tokens[0] or 0, tokens[1] or 0), tokens[2]

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        slots, own, starts, lengths = ngram_ids(docs["text"].to_pylist())
        counts = []
        for high, low in own:
            mine = pa.table({"high": high, "low": low, "at": np.arange(len(high))})
            both = mine.join(known.select(["high", "low", "n", "m"]), ["high", "low"], join_type="inner")
            table = np.zeros((2, len(high)))
            for model, name in enumerate(("n", "m")):
                table[model, both["at"].to_numpy()] = both[name].to_numpy()
            counts.append(table)
        models, target, out = NgramModels(counts, totals, vocabulary), docs["target"].to_pylist(), []
        for i in range(0, len(starts), 128):
            first, ends = starts[i], starts[i : i + 128] + lengths[i : i + 128]
            some = [s[first : ends[-1]] for s in slots]
            out.append(models.score_slots(some, starts[i : i + 128] - first, lengths[i : i + 128], target[i : i + 128]))
        n, of_target, background = (np.concatenate(x) for x in zip(*out, strict=True))
        losses = [pa.array(x, pa.float64(), mask=n == 0) for x in (of_target, background, of_target - background)]
        names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
        return pa.Table.from_arrays([docs["doc_id"].combine_chunks(), pa.array(n, pa.int64()), *losses], names)

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def cross_entropy_difference(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", target: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score all documents against the labelled target."""
    return score(with_target(docs, labels, label_col, target, id_col, text_col))
