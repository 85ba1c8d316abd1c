"""Personal data: candidate generation, gradient-boosted trees, calibrated thresholds, redaction.

The base spans are plain patterns with checks (email, ip, card, phone) and are always reported.  Beyond them,
generators of high recall propose overlapping candidates of the same kinds: spaced or bracketed addresses, numbers
with other separators, numbers without a plus sign.  Boosted trees score a candidate by its format (length, digits,
groups, checksum, number range) and context (neighbouring characters and cue words).  They are fitted on at most
``SAMPLE`` candidates drawn by hash; on the half held out, a monotone calibration turns scores into probabilities, and
a kind's threshold is the lowest probability at which held-out precision reaches ``PRECISION``.  Candidates above it
that meet no base span are added.

The labels come from the corpus's own personal data.  Base spans are rewritten where they stand into forms that the
plain patterns miss; the candidates that cover them there are the positives.  Negatives are candidates that meet no
base span and bear no evidence of their own (an address's markers, a checksum, a cue word before a number), and
rewritten spans made invalid: a wrong checksum, a part above 255, too few digits.  Candidates with such evidence are
not used, since nothing tells what they are.

Defined cases: null text is empty and has no spans; every row is treated by itself, so repeated rows give repeated
results; without labelled candidates of a kind nothing of that kind is added; other columns are ignored; an empty
table gives no rows.  All patterns run in time linear in the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.llm.common import slices, texts_of

# Fixed value: the kinds in their order.
KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000
PRECISION = 0.98
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32

Span = tuple[str, int, int]

_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match from inside a digit run fails or succeeds as one from its start does, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:[._,-][0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._-]{0,2}[0-9]{2,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])\+?\(?[0-9]{1,4}\)?(?:[ ()./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])"),
}
_AT = re.compile(r"\(at\)|\[at\]")
_CUES = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|master|credit|account", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Spans of the plain patterns, by start and then kind."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while domain and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            last = domain.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) < 4 and int(part[-3:]) <= 255 for part in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(digits_of(m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    out = []
    if "@" in text or "(at)" in text or "[at]" in text:
        out += [("email", m.start(), m.end()) for m in _WIDE["email"].finditer(text)]
    if _DIGIT.search(text):
        out += [(kind, m.start(), m.end()) for kind in KINDS[1:] for m in _WIDE[kind].finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    own, left, right = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    digits = digits_of(own)
    groups = re.findall(r"[0-9]+", own)
    return [
        float(KINDS.index(kind)),
        float(len(own)),
        float(len(digits)),
        len(digits) / len(own),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(max((int(g[:4]) for g in groups), default=0) <= 255),
        float(13 < len(digits) < 20 and luhn(digits)),
        float(own.startswith("+")),
        float(own.count(".")),
        float(own.count("-") + own.count(" ")),
        float("@" in own),
        float(own.count(" ")),
        float(not left or left[-1].isspace() or left[-1] in "([<:,;"),
        float(not right or right[0].isspace() or right[0] in ")]>.,;:!?"),
        float(bool(_CUES[kind].search(left))),
        float(any(c.isalpha() for c in own)),
        float(bool(_AT.search(own))),
        float(own.count(". ")),
        float("(" in own),
    ]


def covered(span: Span, base: list[Span]) -> bool:
    """Whether a base span of the kind shares at least 0.8 of the union with the candidate."""
    for kind, start, end in base:
        both = min(end, span[2]) - max(start, span[1])
        if kind == span[0] and both > 0 and both >= 0.8 * (max(end, span[2]) - min(start, span[1])):
            return True
    return False


def grouped(digits: str, way: int) -> list[str]:
    """A number in groups: with its first digits apart, without them, or in twos to fours from the left."""
    head = max(len(digits) - 10, 0)
    if way < 2 and head < 5:
        groups = [digits[: head * (1 - way)], digits[head : head + 3], digits[head + 3 : head + 6], digits[head + 6 :]]
    else:
        rest, parts = len(digits) - 6, -(-(len(digits) - 6) // 4)
        cuts = [0, 3, 6, *(6 + rest * k // parts for k in range(1, parts + 1))] if rest > 0 else [0, 3, len(digits)]
        groups = [digits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [g for g in groups if g]


def disguised(kind: str, own: str, invalid: bool = False) -> str:
    """A base span in a form that the plain patterns miss, chosen by a checksum of the span; or such a form made invalid."""
    pick = zlib.crc32(own.encode("utf-8", "surrogatepass"))
    if kind == "email":
        if invalid:
            return own.replace("@", " @ ").replace(".", ". ")
        name, domain = own.split("@", 1)
        at = (" (at) ", " [at] ", "(at)", "[at]", " @ ")[pick % 5]
        return name + at + domain.replace(".", (".", " (dot) ", " [dot] ", ".")[pick // 5 % 4])
    if kind == "ip":
        parts = own.split(".")
        if invalid:
            parts[pick // 5 % 4] = str(300 + pick % 600)
        return "_-,"[pick % 3].join(parts)
    digits = digits_of(own)
    if kind == "card":
        if invalid:
            digits = digits[:-1] + str((int(digits[-1]) + 1 + pick % 9) % 10)
        return (".", "  ", "_", "--")[pick % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if invalid:
        digits = digits[: 6 + pick % 3]
    groups = grouped(digits, pick % 3)
    if pick // 3 % 3 == 0:
        groups[0] = f"({groups[0]})"
    return (" ", "-", ".", " ")[pick // 9 % 4].join(groups)


def rewritten(text: str, base: list[Span], invalid: bool = False) -> tuple[str, list[Span]]:
    """The text with its base spans disguised, and where they are now; a span that meets an earlier one stays out."""
    out, spans, last, size = [], [], 0, 0
    for kind, start, end in base:
        if start < last:
            continue
        form = disguised(kind, text[start:end], invalid)
        out += [text[last:start], form]
        size += start - last + len(form)
        spans.append((kind, size - len(form), size))
        last = end
    return "".join([*out, text[last:]]), spans


def evident(text: str, span: Span) -> bool:
    """Whether a candidate that no base span covers has evidence apart from its pattern."""
    kind, start, end = span
    own, cue = text[start:end], bool(_CUES[kind].search(text, max(0, start - 32), start))
    digits = digits_of(own)
    if kind == "email":
        return bool(_AT.search(own)) or ". " not in own
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return cue and all(int(part) <= 255 for part in re.findall("[0-9]+", own))
    return 10 <= len(digits) <= 15 and (cue or "(" in own)


def meets(span: Span, base: list[Span]) -> bool:
    return any(b[1] < span[2] and span[1] < b[2] for b in base)


def examples(text: str) -> Iterator[tuple[list[float], float]]:
    """Labelled candidates of a text: see the module's second paragraph."""
    base = base_spans(text)
    for c in candidates(text):
        if not meets(c, base) and not evident(text, c):
            yield features(text, c), 0.0
    for invalid in (False, True) if base else ():
        other, spans = rewritten(text, base, invalid)
        left = base_spans(other)
        for c in candidates(other):
            if covered(c, spans) and not meets(c, left):
                yield features(other, c), float(not invalid)


@dataclass
class BoostedTrees:
    """Logistic gradient boosting over binned features; a tree is a list of levels of (feature, bin) splits."""

    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    trees: list[tuple[list[list[tuple[int, int]]], np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _leaf(self, levels: list[list[tuple[int, int]]], b: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), dtype=np.int64)
        for splits in levels:
            f, cut = np.array(splits).T
            node = node * 2 + (b[np.arange(len(b)), f[node]] > cut[node])
        return node

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, levels = np.zeros(len(y), dtype=np.int64), []
            for depth in range(DEPTH):
                splits = []
                for k in range(1 << depth):
                    at = np.flatnonzero(node == k)
                    best, split = 1e-9, (0, BINS)
                    for j in range(b.shape[1]):
                        gs = np.cumsum(np.bincount(b[at, j], g[at], BINS + 1))
                        hs = np.cumsum(np.bincount(b[at, j], h[at], BINS + 1))
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        top = int(gain.argmax())
                        if gain[top] > best:
                            best, split = float(gain[top]), (j, top)
                    splits.append(split)
                levels.append(splits)
                node = self._leaf(levels, b)
            n = 1 << DEPTH
            leaf = RATE * np.bincount(node, g, n) / (np.bincount(node, h, n) + 1)
            self.trees.append((levels, leaf))
            score += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.start + sum(leaf[self._leaf(levels, b)] for levels, leaf in self.trees)


def calibrated(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone calibration by pooling neighbours that are out of order: score steps and their probabilities."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([float(y), 1.0, float(s)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][2] == blocks[-1][2]):
            total, count, _ = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += count
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Detector:
    trees: BoostedTrees | None = None
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(self.steps):
            return np.zeros(len(x))
        return self.chances[np.maximum(np.searchsorted(self.steps, self.trees.score(x), side="right") - 1, 0)]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        open_ = [
            c
            for c in candidates(text)
            if self.thresholds.get(c[0], 2.0) <= 1 and not meets(c, base)
        ]
        added: list[Span] = []
        if open_:
            chance = self.probability(np.array([features(text, c) for c in open_]))
            for p, c in sorted(zip(chance.tolist(), open_, strict=True), key=lambda x: (-x[0], x[1][1], KINDS.index(x[1][0]))):
                if p >= self.thresholds[c[0]] and not any(a[1] < c[2] and c[1] < a[2] for a in added):
                    added.append(c)
        return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Detector:
    """Fit on at most ``sample`` candidates of the documents that hold a digit or an at sign."""
    rows = texts_of(df, id_col, text_col).filter(F.col("text").rlike(r"[0-9@]|\(at\)|\[at\]"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = [x for text in part.column(0).to_pylist() for x in examples(text)]
            found, labels = [x for x, _ in made], [y for _, y in made]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["x", "y"])

    # Whole documents are drawn by hash, about one per candidate wanted; then candidates, by hash too.
    n = rows.count()
    share = min(1_000_000, int(1_000_000 * sample / n) + 1) if n else 0
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).select("text")
    got = drawn.mapInArrow(propose, "x array<double>, y double").withColumn("h", F.xxhash64("x", "y")).orderBy("h", "x").limit(sample).collect()
    if not got:
        return Detector()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    held = np.array([r["h"] % 2 == 0 for r in got])
    if held.all() or not held.any() or y[~held].min() == y[~held].max():
        return Detector()
    trees = BoostedTrees().fit(x[~held], y[~held])
    steps, chances = calibrated(trees.score(x[held]), y[held])
    out = Detector(trees, steps, chances)
    chance = out.probability(x[held])
    for i, kind in enumerate(KINDS):
        own = x[held][:, 0] == i
        levels = np.unique(chance[own & (y[held] > 0)])
        good = [float(t) for t in levels if y[held][own & (chance >= t)].mean() >= PRECISION and t >= 0.5]
        if good:
            out.thresholds[kind] = min(good)
    return out


def find(df: DataFrame, detector: Detector, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: arrays of (kind, start, end) in code points, end exclusive."""
    shared = df.sparkSession.sparkContext.broadcast(detector)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            both = [shared.value.spans(t) for t in part.column(1).to_pylist()]
            lists = [[[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in side] for side in zip(*both, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, span) for x in lists)], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return texts_of(df, id_col, text_col).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, last, open_end = [], 0, -1
    for kind, start, end in spans:
        if start < open_end:
            open_end = last = max(open_end, end)
            continue
        out += [text[last:start], f"[{kind.upper()}]"]
        open_end = last = end
    return "".join([*out, text[last:]])


def redact(df: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """``df`` with its text redacted; a null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else redacted(t, shared.value.spans(t)[1]) for t in texts], dtype=object)

    return df.withColumn(text_col, run(F.col(text_col).cast("string")))
