"""Hard negatives, quality scores and collocations against brute force and held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.llm_cases import frame, words
from pyspark.sql import functions as F

from clickfeat.llm import collocations, negatives, quality

VECTORS = "vec_id long, embedding array<float>, label int, id string, key int, score int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, 2, "v") for r in rows], VECTORS).repartition(3)


def mine(df, **options):
    found = negatives.hard_negatives(df, F.col("id") % 10 == 0, label=F.col("label"), id_col="vec_id", **options)
    return sorted(map(tuple, found.collect()))


def brute_negatives(rows, every=10, share=80):
    usable = []
    for i, x, label in rows:
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            usable.append((i, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    for a, v, label in usable:
        if a is None or a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i if i is not None else 1 << 62, lab) for i, w, lab in usable]
        scored.sort()
        same = [s for s in scored if s[2] == label and s[1] != a][:5]
        for score, p, _ in same:
            hard = [s for s in scored if s[2] != label and share * -score <= 100 * -s[0] <= 100 * -score][:5]
            out += [(a, p, r, s[1], -score, -s[0]) for r, s in enumerate(hard, 1)]
    return sorted(out)


def random_vectors(n, width, seed, labels=3, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width)) / np.sqrt(width)
    return [
        (i, (centres[i % 8] + spread * rng.normal(size=width) / np.sqrt(width)).astype(np.float32).tolist(), int(rng.integers(labels)))
        for i in range(n)
    ]


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_hard_negatives_match_all_scores(spark, spread):
    rows = random_vectors(400, 16, 3, spread=spread)
    assert mine(vectors(spark, rows)) == brute_negatives(rows)


def test_hard_negatives_in_many_blocks_and_groups(spark):
    rows = random_vectors(300, 8, 5)
    assert mine(vectors(spark, rows), block_rows=4, group_bytes=2_000) == brute_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    rows = random_vectors(80, 4, 6)
    rows += [
        (90, None, 1),
        (100, [1.0, None, 0.0, 0.0], 1),
        (110, [math.nan, 0.0, 0.0, 0.0], 1),
        (120, [math.inf, 0.0, 0.0, 0.0], 1),
        (130, [0.5, 0.5, 0.5, 0.5], None),
        (140, [0.5], 1),
        (150, [], 2),
        (160, [0.0, 0.0, 0.0, 0.0], 0),
        (170, [3e6, -2e6, 1e6, 5e5], 0),
        (171, [3e6, -2e6, 1e6, 5e5], 0),
        (172, [2.9e6, -2e6, 1e6, 5e5], 1),
    ]
    # A third of the rows are one vector: ties go to the smaller id.
    rows += [(1000 + i, [0.3, 0.1, 0.2, 0.4], i % 3) for i in range(60)]
    assert mine(vectors(spark, rows)) == brute_negatives(rows)


def test_hard_negatives_of_few_rows(spark):
    assert mine(vectors(spark, [])) == []
    assert mine(vectors(spark, [(0, [1.0], 1)])) == []
    # A null id comes last among equals and is never an anchor.
    rows = [(0, [1.0], 1), (3, [1.0], 1), (None, [1.0], 2), (4, [1.0], 2)]
    assert mine(vectors(spark, rows)) == [(0, 3, 1, 4, 65536, 65536), (0, 3, 2, None, 65536, 65536)]


def test_repeated_anchor_ids_have_rows_each(spark):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (3, [1.0], 1), (4, [1.0], 2)]
    assert mine(vectors(spark, rows)) == [(0, 3, 1, 4, 65536, 65536)] * 2


def test_tree_bounds_hold_and_spare_scores():
    """Every score lies within its parent's interval, and tight clusters need few scores."""
    rows = random_vectors(600, 16, 7, spread=0.02)
    points = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    anchors = points[:64]
    parent, length = negatives.spanning_tree(anchors)
    norm = np.sqrt((points.astype(float) ** 2).sum(axis=1))
    exact = anchors @ points.T
    for child in np.flatnonzero(parent >= 0):
        assert (np.abs(exact[child] - exact[parent[child]]) <= length[child] * norm * (1 + 1e-9) + 1).all()
    assert sorted(np.concatenate(negatives.levels_of(parent)).tolist()) == list(range(64))
    ids = np.arange(64)
    low = np.partition(exact, -5, axis=1)[:, -5:-4]
    block = negatives.AnchorBlock(ids, ids, ids, anchors, parent, length, low, np.full_like(low, negatives.HIGH))
    limit, negatives.DENSE = negatives.DENSE, 2.0
    try:
        score, known = block.scores(points, block.low, block.high, np.ones((64, 600), dtype=bool))
    finally:
        negatives.DENSE = limit
    assert (score[known] == exact[known]).all()
    assert not (exact[~known] >= np.broadcast_to(low, exact.shape)[~known]).any()
    assert known.mean() < 0.5


def phrases_by_hand(rows, least, top, longest=5):
    counts, n = defaultdict(Counter), Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            found = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(found)
            for k in range(1, longest + 1):
                for i in range(len(found) - k + 1):
                    counts[lang][tuple(found[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = {
            p[i : i + k]
            for p, a in often.items()
            for k in range(2, len(p))
            for i in range(len(p) - k + 1)
            if a >= c[p[i : i + k]]
        }
        ranked = []
        for p, a in often.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(seed=1):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "É", "漢字", "naïve", "\x1c", "x\x85y", "B", "C"]
    rows = []
    for i in range(300):
        found = rng.choices(vocabulary, weights=range(15, 0, -1), k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n"]) for w in found)
        if i % 3 == 0:
            text += " the very common passage of seven words here"
        rows.append((i, text, rng.choice(["en", "de", None])))
    return rows + [(1, None, "en"), (2, "", None), (2, "", None), (None, "a b c d e f", "en"), (9, "a" * 200_000 + " a a a", "en")]


def mined(spark, rows, **options):
    data = spark.createDataFrame(
        [(*r, "s", 3, "w", 5) for r in rows], "doc_id long, text string, lang string, s string, n long, word string, k int"
    )
    return sorted(map(tuple, collocations.collocations(data.repartition(5), **options).collect()))


@pytest.mark.parametrize(("least", "top"), [(20, 2000), (5, 2000), (5, 7)])
def test_collocations_match_all_counts(spark, least, top):
    rows = phrase_rows()
    assert mined(spark, rows, min_count=least, top=top) == phrases_by_hand(rows, least, top)


def test_collocations_of_split_prefixes(spark, monkeypatch):
    """Prefixes with many rows are dealt by more words; their counts are summed from several buckets."""
    routes = collocations.routes
    seen = []

    def low_limit(rows, limit, depth):
        out = routes(rows, 2, depth)
        seen.append({r["routed"] for r in out.select("routed").distinct().collect()})
        return out

    monkeypatch.setattr(collocations, "routes", low_limit)
    rows = phrase_rows(2)
    assert mined(spark, rows, min_count=10, bucket_rows=50) == phrases_by_hand(rows, 10, 2000)
    assert seen and len(seen[0]) >= 3


def test_collocations_take_another_seed_when_hashes_meet(spark, monkeypatch):
    plain = collocations.word_hash

    def meeting(word, seed):
        return 7 if seed == 0 else plain(word, seed)

    monkeypatch.setattr(collocations, "word_hash", meeting)
    counted = collocations.count_words(collocations.documents_of(frame(spark, [(1, "a b c")]), "text", "lang"), 0)
    assert counted.filter("word != other").count() == 1


def test_collocations_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, None), (2, "", "en"), (3, ". , ;", "en")]) == []


def test_prefix_counts_and_abandoned_parts():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 4, size=(500, 4)).astype(np.uint64)
    rows[np.maximum.accumulate(rows == 0, axis=1)] = 0
    rows = rows[rows[:, 0] != 0]
    weight = rng.integers(1, 5, size=len(rows))
    want = Counter()
    for row, w in zip(rows.tolist(), weight.tolist()):
        for d in range(1, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += w
    for least in (1, 20, 100):
        got = {
            tuple(rows[i, :d].tolist()): n
            for i, d, n in collocations.frequent_prefixes(rows, weight, np.zeros(len(rows), dtype=int), least)
        }
        assert got == {p: n for p, n in want.items() if n >= least}


def labelled_texts(n=240, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = words(rng, rng.randint(20, 80))
        good = i % 4 != 0
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 8 else text.replace(" ", "$$$ ")
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_quality_separates_held_out_documents(spark):
    docs, labels = labelled_texts()
    marks = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("clash"))
    seen = marks.filter("doc_id % 3 != 0")
    model = quality.train(frame(spark, docs), seen, label=F.col("quality"))
    scores = {r.doc_id: r.score for r in quality.score(frame(spark, docs), model).collect()}
    assert len(scores) == len(docs) and all(0 <= s <= 1 for s in scores.values())
    hits = [(scores[i] >= 0.5) == bool(y) for i, y in labels if i % 3 == 0]
    assert np.mean(hits) > 0.95
    again = quality.train(frame(spark, docs), seen, label=F.col("quality"))
    assert np.array_equal(model.weights, again.weights)


def test_quality_of_odd_rows(spark):
    docs, labels = labelled_texts(60)
    docs += [(100, None), (101, ""), (102, " \n"), (103, "x" * 200_000), (104, "a b " * 30_000), (None, "a"), (0, docs[0][1])]
    # Ids labelled both ways, null labels and ids, and labels of documents that are not there.
    labels += [(1, 0), (2, None), (None, 1), (999, 1), (0, 0), (0, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(frame(spark, docs), marks, label=F.col("quality"))
    rows = quality.score(frame(spark, docs), model).collect()
    assert len(rows) == len(docs)
    empty = {r.score for r in rows if r.doc_id in (100, 101, 102)}
    assert empty == {float(quality.sigmoid(model.bias))}


def test_quality_without_labels_or_with_one(spark):
    docs = frame(spark, labelled_texts(20)[0])
    for labels, want in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        marks = spark.createDataFrame(labels, "doc_id long, quality int")
        model = quality.train(docs, marks, label=F.col("quality"))
        assert all(abs(r.score - want) < 1e-6 for r in quality.score(docs, model).collect())
    assert quality.score(frame(spark, []), model).count() == 0


def test_quality_scores_are_sparse_dot_products():
    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << 10), 0.3, 10)
    features = quality.Featurizer(10)
    text = "One two one TWO $$$ 12 one two"
    found = quality._WORD.findall(text)
    shapes = [quality.shape(w) for w in found]
    assert found == ["One", "two", "one", "TWO", "$$$", "12", "one", "two"] and shapes == [2, 1, 1, 3, 5, 4, 1, 1]
    slots, values = features.vector(text)
    assert len(slots) == len(set(slots.tolist())) and abs(float((values**2).sum()) - 1) < 1e-5
    want = quality.sigmoid(sum(float(model.weights[s]) * float(v) for s, v in zip(slots, values)) + model.bias)
    assert abs(model.scores([text], features)[0] - want) < 1e-6
    assert len(features.vector("")[0]) == 0
