"""Text quality: hashed word n-grams, logistic regression by follow-the-regularised-leader updates, sparse dot products.

A word is a run of letters and digits or a run of other marks; its shape says whether it is lower, title or upper case,
a number or marks.  Words and pairs of words, and shapes, pairs and triples of shapes, are hashed into ``2**bits``
slots.  A document is a sparse vector of ``log(1 + count)`` per slot, scaled to length one, so that its size does not
count.  One per-coordinate FTRL-proximal pass after another runs over a sample of labelled documents in hash order; the
state is two vectors of fixed size.  Scoring broadcasts the weights (fixed size) and sums products per document.

Training reads at most about ``fit_rows`` labelled documents, drawn by a hash of id and text: the bound is a parameter.
Everything else covers all rows and whole texts.

Defined cases: null text is empty; a text without words has only the bias; without labelled documents, or with one
label only, the share of label 1 (one half without any) is the score of all; ids labelled both ways and null labels are
left out of training; documents of equal id and text train once; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfeat.llm.common import kept, slices, texts_of

BITS = 18
FIT_ROWS = 8_000
EPOCHS = 3
# FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.1
MEMO_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
# n-grams of words and of shapes.
WORD_ORDERS, SHAPE_ORDERS = (1, 2), (1, 2, 3)


def shape(word: str) -> int:
    if word.isupper():
        return 3 if len(word) > 1 else 2
    if word.istitle():
        return 2
    if word.isalpha():
        return 1
    return 4 if word.isalnum() else 5


class Featurizer:
    """Sparse vectors of texts; remembers the hashes of words."""

    def __init__(self, bits: int):
        self.bits = bits
        self.memo: dict[str, tuple[int, int]] = {}

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = _WORD.findall(text)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in set(words).difference(memo):
            memo[word] = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")), shape(word))
        both = [memo[w] for w in words]
        return np.array([b[0] for b in both], dtype=np.uint64), np.array([b[1] for b in both], dtype=np.uint64)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots in ascending order and their values."""
        words, shapes = self.codes(text)
        parts = []
        for base, orders, seed in ((words, WORD_ORDERS, 1), (shapes, SHAPE_ORDERS, 101)):
            for order in orders:
                if len(base) < order:
                    break
                value = np.full(len(base) - order + 1, seed + order, dtype=np.uint64)
                for k in range(order):
                    value = (value ^ base[k : len(base) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    value ^= value >> np.uint64(29)
                parts.append((value >> np.uint64(3)) & np.uint64((1 << self.bits) - 1))
        if not parts:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
        slots, counts = np.unique(np.concatenate(parts), return_counts=True)
        values = np.log1p(counts)
        return slots.astype(np.int32), (values / np.sqrt((values * values).sum())).astype(np.float32)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass
class Ftrl:
    """State of the updates; the last coordinate is the bias, which has no penalty."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def fresh(cls, bits: int) -> Ftrl:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def bias(self) -> float:
        return -self.z[-1] * ALPHA / (BETA + np.sqrt(self.n[-1]))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w, b = self.weights(slots), self.bias()
        miss = sigmoid(float(w @ values) + b) - label
        grad = miss * values
        step = (np.sqrt(self.n[slots] + grad * grad) - np.sqrt(self.n[slots])) / ALPHA
        self.z[slots] += grad - step * w
        self.n[slots] += grad * grad
        step = (np.sqrt(self.n[-1] + miss * miss) - np.sqrt(self.n[-1])) / ALPHA
        self.z[-1] += miss - step * b
        self.n[-1] += miss * miss


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: list[str], features: Featurizer) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            slots, values = features.vector(text)
            out[i] = self.weights[slots] @ values + self.bias
        return sigmoid(out)


def sample_of(docs: DataFrame, labelled: DataFrame, fit_rows: int) -> DataFrame:
    """text hash, label and text of at most about ``fit_rows`` labelled documents, one per id and text."""
    found = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).join(labelled, "doc_id").distinct()
    found = kept(found)
    share = fit_rows / max(found.count(), 1)
    cut = int(min(1.0, share) * 1_000_000)
    # About fit_rows rows: small enough to broadcast.
    drawn = kept(found.filter(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < cut))
    return docs.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(drawn), ["doc_id", "h"])


def train(
    documents: DataFrame,
    labels: DataFrame,
    *,
    label: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
    fit_rows: int = FIT_ROWS,
    epochs: int = EPOCHS,
) -> QualityModel:
    """Fit on the rows of ``labels`` and their documents; ``label`` is 0 or 1."""
    docs = texts_of(documents, id_col, text_col)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), label.cast("int").alias("y"))
    marks = marks.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    agreed = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other"))
    labelled = agreed.filter(F.col("y") == F.col("other")).select("doc_id", "y")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(bits)
        for part in slices(batches, 128):
            found = [features.vector(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([s.tobytes() for s, _ in found], pa.binary()),
                    pa.array([v.tobytes() for _, v in found], pa.binary()),
                ],
                names=["h", "y", "slots", "vals"],
            )

    rows = sample_of(docs, labelled, fit_rows).select("h", "y", "text")
    made = rows.mapInArrow(vectors, "h long, y int, slots binary, vals binary")
    once = made.groupBy("h").agg(F.min_by(F.struct("y", "slots", "vals"), "slots").alias("x")).select("h", "x.*")
    # A bounded sample in one order: updates follow each other, a few thousand rows at a time.
    table = kept(once.repartition(1).sortWithinPartitions("h"))
    counts = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(min(max(*counts, 0), 1))
        return QualityModel(np.zeros(1 << bits), 35.0 * (2 * share - 1), bits)

    def learn(state: Ftrl):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 256):
                for y, slots, values in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    state.learn(np.frombuffer(slots, dtype=np.int32), np.frombuffer(values, dtype=np.float32).astype(float), y)
            yield pa.RecordBatch.from_pydict({"z": [state.z.tobytes()], "n": [state.n.tobytes()]})

        return run

    state = Ftrl.fresh(bits)
    for _ in range(epochs):
        row = table.select("y", "slots", "vals").coalesce(1).mapInArrow(learn(state), "z binary, n binary").collect()[0]
        state = Ftrl(np.frombuffer(row["z"]).copy(), np.frombuffer(row["n"]).copy())
    return QualityModel(state.weights()[:-1], float(state.bias()), bits)


def score(df: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(shared.value.bits)
        for part in slices(batches, 128):
            found = shared.value.scores(part.column(1).to_pylist(), features)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
