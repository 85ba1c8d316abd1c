"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a space, and each character 1-, 2- and 3-gram that holds a
letter is hashed into one of 2**bits slots.  Training counts slots per language in numpy on every task and sums
them in Spark; the log-probability matrix (languages x slots) has a size fixed by its parameters, so it is
collected and broadcast.  Scoring gathers and sums matrix columns for a batch of documents at once.

Training reads whole texts of at most about ``per_language`` labelled documents of each language, chosen by a
hash of id and text: the bound is a parameter, and a rare language keeps all of its documents.  The prior is each
language's share of all labelled rows.

Defined cases: null text, empty text or text without a letter gives ``und`` with score 0; an empty or unlabelled
training table gives ``und`` for all; equal scores go to the language that sorts first; repeated rows count as
often as they occur; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.llm.common import slices

UNDETERMINED = "und"
BITS = 16
SMOOTHING = 0.5
PER_LANGUAGE = 20_000
MAX_LANGUAGES = 1_000
ORDERS = (1, 2, 3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_slots(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of a batch, and where each document starts.

    Slot ``2**bits`` stands for "no n-gram here".  Each document is padded by two spaces, which keeps n-grams
    from reaching into the next one and every document's run of slots non-empty.
    """
    joined = "".join(t.lower() + "  " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    n = len(codes)
    out = np.empty((n, len(ORDERS)), dtype=np.int32)
    padding = np.zeros(n, dtype=bool)
    ends = starts + lengths
    padding[ends - 1] = True
    padding[ends - 2] = True
    value = np.zeros(n, dtype=np.uint64)
    holds = np.zeros(n, dtype=bool)
    for k, order in enumerate(ORDERS):
        shift = order - 1
        value *= np.uint64(0x110000)
        value[: n - shift] += codes[shift:]
        holds[: n - shift] |= letter[shift:]
        mixed = (value + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        slot = (mixed >> np.uint64(64 - bits)).astype(np.int32)
        slot[padding | ~holds] = 1 << bits
        out[:, k] = slot
    return out.reshape(-1), starts * len(ORDERS)


@dataclass
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray  # languages x (2**bits + 1), the last column is 0
    prior: np.ndarray
    bits: int

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        slots, starts = ngram_slots(texts, self.bits)
        seen = np.add.reduceat((slots != 1 << self.bits).astype(np.int64), starts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total = np.stack([np.add.reduceat(row[slots], starts) for row in self.matrix]) + self.prior[:, None]
        best = total.argmax(axis=0)
        share = 1.0 / np.exp(total - total.max(axis=0)).sum(axis=0)
        names = [self.languages[b] if s else UNDETERMINED for b, s in zip(best, seen, strict=True)]
        return names, np.where(seen > 0, share, 0.0)


def train(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    bits: int = BITS,
    smoothing: float = SMOOTHING,
    per_language: int = PER_LANGUAGE,
    max_languages: int = MAX_LANGUAGES,
) -> LanguageModel:
    """Fit on the rows with a text and a language."""
    rows = labelled.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; the matrix would have no fixed size")
    size = {r["lang"]: r["count"] for r in sizes}
    draw = F.lit(False)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    for lang, n in size.items():
        draw = draw | ((F.col("lang") == lang) & (key < int(1_000_000 * min(1.0, per_language / n))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((1 << bits) + 1, dtype=np.int64))
        for part in slices(batches):
            groups = defaultdict(list)
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                groups[lang].append(text)
            for lang, texts in groups.items():
                slots, _ = ngram_slots(texts, bits)
                sums[lang] += np.bincount(slots, minlength=(1 << bits) + 1)
        for lang, sums_of in sums.items():
            at = np.flatnonzero(sums_of[:-1])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums_of[at])],
                    names=["lang", "slot", "n"],
                )

    counts = (
        rows.filter(draw)
        .select("text", "lang")
        .mapInArrow(count, "lang string, slot int, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )
    # At most max_languages x 2**bits rows.
    found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    table = np.zeros((len(languages), 1 << bits))
    place = {lang: i for i, lang in enumerate(languages)}
    if len(found):
        table[found["lang"].map(place).to_numpy(), found["slot"].to_numpy()] = found["n"].to_numpy()
    table += smoothing
    matrix = np.zeros((len(languages), (1 << bits) + 1))
    matrix[:, :-1] = np.log(table / table.sum(axis=1, keepdims=True))
    # The prior follows all labelled rows, not those drawn for the counts.
    weight = np.array([size[lang] for lang in languages], dtype=float)
    return LanguageModel(languages, matrix, np.log(weight / weight.sum()), bits)


def predict(
    df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language) for every row."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, 256):
            names, share = own.predict([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def tag_rows(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` as one struct ``row``, with their prediction: for filters that must keep
    columns of any name."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts):
        import pandas as pd

        names, share = [], []
        values = texts.tolist()
        for start in range(0, len(values), 256):
            got = shared.value.predict([t or "" for t in values[start : start + 256]])
            names += got[0]
            share += got[1].tolist()
        return pd.DataFrame({"lang_pred": names, "score": share})

    rows = df.select(F.struct("*").alias("row"))
    return rows.withColumn("tag", score(F.col("row")[text_col].cast("string")))
