"""Near and exact dedup and repeated passages against brute force."""

import hashlib
import itertools
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm.llm_cases import frame, shingles, similar, smallest_reachable, texts, words
from pyspark.sql import functions as F

from clickfeat.llm import exact, near, paragraphs, similar as links
from clickfeat.llm.common import pruned


def unique_ids(rows):
    return [(i, t) for i, t in rows if i is not None and i not in (17, 18)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_match_all_pairs(spark, size):
    rows = unique_ids(texts())
    sets = {i: shingles(t, size) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])]
    want = smallest_reachable(list(sets), pairs)
    got = near.near_groups(frame(spark, rows), words=size).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_chain_of_edits(spark):
    """Each text links only to its neighbours, so no one document sees the whole component."""
    rng = random.Random(3)
    now = words(rng, 200).split(" ")
    rows = []
    for i in range(60):
        rows.append((i, " ".join(now)))
        at = rng.randrange(200)
        now = [*now[:at], f"edit{i}", *now[at + 1 :]]
    sets = {i: shingles(t, 5) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])]
    got = near.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == smallest_reachable(list(sets), pairs)


def test_large_nodes_of_unlike_documents(spark):
    """One passage in every document makes large nodes without links: they branch until they are small."""
    rng = random.Random(4)
    shared = words(rng, 60)
    rows = [(i, f"{words(rng, 60)} {shared} {words(rng, 60)}") for i in range(150)]
    rows += [(1000 + i, t + " tail") for i, (_, t) in enumerate(rows[:5])]
    got = {r.doc_id: r.component_id for r in near.near_groups(frame(spark, rows)).collect()}
    assert got == {**{i: i for i in range(150)}, **{1000 + i: i for i in range(5)}}


def test_pairs_that_part_below_a_large_node_meet_in_a_later_root(spark):
    """All documents share their first root; below it every pair parts.  A family's pairs also share a small second root."""
    family, others = range(20), range(100, 400)
    heads = [(i, [1, 2 if i in family else 1000 + i], [0] * 8) for i in (*family, *others)]
    heads = spark.createDataFrame(heads, "id long, roots array<long>, bits array<long>")
    # Documents 2 k and 2 k + 1 have the same set; no others have anything in common.
    sets = spark.createDataFrame([(i, bytes([i // 2 + 1] + [0] * 7)) for i in family], "id long, shingles binary")
    unlike = heads.filter("id >= 100").select("id", F.expr("unhex(lpad(hex(id + 1000), 16, '0'))").alias("shingles"))

    def split(mixed):
        below = mixed.filter("n > 20").select(F.xxhash64("node", "id").alias("node"), F.lit(-1).alias("place"), "id")
        return mixed.filter("n <= 20"), below

    comp = links.linked_components(heads, lambda ids: sets.union(unlike).join(ids, "id"), 80, 100, split)
    assert {r.id: r.component for r in comp.collect()} == {i: i // 2 * 2 for i in family}


def test_near_groups_odd_rows(spark):
    got = near.near_groups(frame(spark)).collect()
    assert len(got) == len(texts())
    empty = [r for r in got if r.n_shingles == 0]
    assert {r.doc_id for r in empty} == {1, 2, 3, None} and all(r.kept and r.component_id == r.doc_id for r in empty)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id == 17} == {6}
    assert near.near_groups(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    want = smallest_reachable(sorted({x for e in edges for x in e}), edges)
    got = {r.id: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == c for i, c in want.items())


def brute_exact(rows):
    norm = [(i, t or "", re.sub("[\x20\x09-\x0d]", "", t or "")) for i, t in rows]
    out = []
    for i, _, n in norm:
        group = [(-len(t), x is None, x or 0, x) for x, t, m in norm if m == n]
        out.append((i, min(group)[3], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [16, 1])
def test_exact_groups_match_brute_force(spark, digest):
    """With one-byte identifiers nearly all chunks collide and contents must tell them apart."""
    rows = texts() if digest == 16 else [(i, t) for i, t in texts() if i not in (12, 13, 14)]
    got = exact.exact_groups(frame(spark, rows), digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)
    for sha in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert exact.exact_groups(frame(spark, [])).count() == 0


def test_cuts_depend_on_content_only():
    rng = random.Random(1)
    text = words(rng, 20_000).encode()
    alone = exact.cut_points([text])[0]
    assert exact.cut_points([b"other" * 999, text, b"z"])[1] == alone
    assert max(b - a for a, b in itertools.pairwise([0, *alone])) <= exact.MAX_CHUNK and len(alone) > 20
    # An insertion at the front moves only the first cuts.
    moved = exact.cut_points([b"abc" + text])[0]
    assert len({c - 3 for c in moved} & set(alone)) > 0.9 * len(alone)


def test_repeated_passages(spark):
    rng = random.Random(11)
    passages = [words(rng, n) for n in (51, 52, 60, 75, 140)]
    short = words(rng, 31)
    rows = []
    for i in range(40):
        head, tail = words(rng, rng.randint(3, 90)), words(rng, rng.randint(3, 90))
        middle = passages[i % 5] if i < 25 else (short if i < 32 else words(rng, 60))
        rows.append((i, f"{head} {middle} {tail}"))
    line = words(rng, 90).split(" ")
    rows.append((50, words(rng, 20) + "\n" + " ".join(line) + "\n" + words(rng, 10)))
    line[40] = "other"
    rows.append((51, words(rng, 7) + "\n" + " ".join(line)))
    got = paragraphs.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {*range(25), 50, 51}
    assert {r.kind for r in got if r.doc_id in (50, 51)} >= {"paragraph"}
    for r in got:
        text = dict(rows)[r.doc_id].split()
        first = dict(rows)[r.first_doc_id].split()
        if r.kind == "window":
            assert text[r.start_word : r.start_word + r.n_words] == first[r.first_start_word : r.first_start_word + r.n_words]
        assert r.n_docs > 1 and r.kept == ((r.doc_id, r.start_word) == (r.first_doc_id, r.first_start_word))


def test_repeated_paragraphs_match_all_pairs(spark):
    rng = random.Random(12)
    rows, known = [], []
    for i in range(60):
        lines = [words(rng, rng.randint(20, 70)) for _ in range(3)]
        if known and rng.random() < 0.6:
            copy = rng.choice(known).split(" ")
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{i}"
            lines.append(" ".join(copy))
        known += [x for x in lines if len(x.split(" ")) >= 50]
        rows.append((i, "\n".join(lines)))
    units = {}
    for i, t in rows:
        at = 0
        for line in t.split("\n"):
            if len(line.split(" ")) >= 50:
                units[i, at] = shingles(line, 5)
            at += len(line.split(" "))
    pairs = [(a, b) for a, b in itertools.combinations(units, 2) if similar(units[a], units[b])]
    first = smallest_reachable(sorted(units), pairs)
    docs = {f: {u[0] for u in first if first[u] == f} for f in first.values()}
    want = {u: f for u, f in first.items() if len(docs[f]) > 1}
    got = [r for r in paragraphs.repeated_passages(frame(spark, rows)).collect() if r.kind == "paragraph"]
    assert {(r.doc_id, r.start_word): (r.first_doc_id, r.first_start_word) for r in got} == want


def test_repeated_passages_odd_rows(spark):
    got = paragraphs.repeated_passages(frame(spark)).collect()
    assert {6, 7, 8, 17, 20} <= {r.doc_id for r in got} and not {1, 2, 3, 4, 5, 12, 13, 15, None} & {r.doc_id for r in got}
    assert paragraphs.repeated_passages(frame(spark, [])).count() == 0


def test_families_of_edited_copies_match_all_pairs(spark):
    """One large family: edits, truncations, insertions and variants of a variant, many of them below 0.8 to the original."""
    rng = random.Random(11)
    base = words(rng, 150).split(" ")
    variant = base[:60] + words(rng, 45).split(" ") + base[60:]
    rows = []
    for i in range(240):
        now = list(rng.choice([base, base, base, variant]))
        for _ in range(rng.choice([0, 1, 2, 4, 7, 9])):
            now[rng.randrange(len(now))] = f"edit{rng.randrange(400)}"
        if i % 5 == 0:
            now = now[: len(now) - rng.randrange(60)]
        rows.append((i, " ".join(now)))
    # Shorter copies of some members: alike them, but not the original.
    rows += [(1000 + i, " ".join(t.split(" ")[: -rng.randrange(1, 15)])) for i, t in rows[::7]]
    sets = {i: shingles(t, 5) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])]
    want = smallest_reachable(list(sets), pairs)
    assert 1 < len(set(want.values())) < len(rows)
    got = near.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("rare", [1, 3, 32])
def test_family_pairs_keep_every_link(spark, monkeypatch, rare):
    """All links across components are among the candidates, however many members make a shingle common."""
    monkeypatch.setattr(links, "RARE", rare)
    rng = random.Random(rare)
    sets = {}
    for i in range(120):
        kept = set(rng.sample(range(100), rng.randrange(70, 101)))
        sets[i] = kept | {1000 + rng.randrange(60) for _ in range(rng.randrange(25))}
    heads = spark.createDataFrame([(i, [0] * 8, len(s)) for i, s in sets.items()], "id long, bits array<long>, size long")
    stored = [(i, b"".join(x.to_bytes(8, "little") for x in sorted(s))) for i, s in sets.items()]
    stored = spark.createDataFrame(stored, "id long, shingles binary")
    # Half of the rows are the main component; the others are apart.
    families = spark.createDataFrame([(0, i, 0 if i % 2 == 0 else i) for i in sets], "family long, id long, component long")
    found = links.family_pairs(families, heads, lambda ids: stored.join(ids, "id"), 80, 100)
    rows = [(r.a, r.b) for r in found.collect()]
    assert len(rows) == len(set(rows)) and all(a < b and (a % 2 or b % 2) for a, b in rows)
    linked = {(a, b) for a, b in itertools.combinations(sets, 2) if (a % 2 or b % 2) and similar(sets[a], sets[b])}
    assert linked and linked <= set(rows)


def test_pruned_rows_hold_every_id(spark):
    rows = spark.range(-500, 20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    ids = spark.range(-500, 20_000, 7)
    left = {r.doc_id for r in pruned(rows, ids, "doc_id").collect()}
    wanted = set(range(-500, 20_000, 7))
    assert wanted <= left and len(left) < len(wanted) + 20
    assert pruned(rows, ids.limit(0), "doc_id").count() == 0


def test_few_pairs_of_a_family_are_left_to_confirm(spark, monkeypatch):
    """Edited copies whose edits differ, without their original: about 1,100 of 179,700 pairs are linked."""
    asked = []
    check = links.verified
    monkeypatch.setattr(links, "verified", lambda pairs, *rest: asked.append(pairs.count()) or check(pairs, *rest))
    rng = random.Random(8)
    base = words(rng, 200).split(" ")
    rows = []
    for i in range(600):
        now = list(base)
        for at in rng.sample(range(200), rng.randrange(3, 9)):
            now[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(now)))
    got = near.near_groups(frame(spark, rows)).collect()
    assert len(got) == 600
    assert sum(asked) < 179_700 / 10


def test_min_hashes_hold_little_at_once():
    """Least values of all shingles, without an array of 256 hashes of thousands of shingles (op8, pipeline)."""
    import tracemalloc

    shingles = np.random.default_rng(3).integers(0, 1 << 63, size=5000, dtype=np.uint64)
    want = np.array([((shingles * m + a).min()) for m, a in zip(links._MULTIPLY, links._ADD)])
    tracemalloc.start()
    got = links.min_hashes(shingles, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want ^ (want >> np.uint64(29))).all() and peak < 1_000_000


def test_only_paragraphs_that_share_a_band_are_compared(spark):
    """Every paragraph got 256 min-hashes and moved its bits and text, whether anything was near it or not (op8)."""
    rng = random.Random(21)
    line = words(rng, 80)
    rows = [(i, words(rng, 60)) for i in range(30)] + [(40, line), (41, line + " more"), (42, line)]
    units = paragraphs.paragraph_table(frame(spark, rows), 50)
    assert "bits" not in units.columns and units.count() == 33
    classes = units.groupBy("class").agg(F.min(F.struct("doc_id", "start")).alias("id"), F.first("bands").alias("roots"))
    shared = {r.id.doc_id for r in paragraphs.in_shared_bands(classes).collect()}
    assert shared == {40, 41}
    got = paragraphs.repeated_passages(frame(spark, rows)).filter("kind = 'paragraph'").collect()
    assert {(r.doc_id, r.first_doc_id, r.n_docs) for r in got} == {(40, 40, 3), (41, 40, 3), (42, 40, 3)}


def test_few_pairs_of_edited_paragraphs_are_left_to_confirm(spark, monkeypatch):
    """Edited copies of one paragraph, two edits each, were compared in pairs: 537,342 of them on check_h (op8)."""
    asked = []
    check = links.verified
    monkeypatch.setattr(links, "verified", lambda pairs, *rest: asked.append(pairs.count()) or check(pairs, *rest))
    rng = random.Random(9)
    base = words(rng, 100).split(" ")
    rows = []
    for i in range(300):
        now = list(base)
        for at in rng.sample(range(100), 2):
            now[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(now)))
    sets = {i: shingles(t, paragraphs.SHINGLE) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])]
    reached = smallest_reachable(list(sets), pairs)
    linked = {i: r for i, r in reached.items() if list(reached.values()).count(r) > 1}
    got = paragraphs.repeated_passages(frame(spark, rows)).filter("kind = 'paragraph'").collect()
    assert {r.doc_id: r.first_doc_id for r in got} == linked and linked
    assert sum(asked[1:]) < 44_850 / 10  # beside those with hubs


def test_known_words_hold_little(spark):
    """The words a task remembers, beside a second task and the heap, took the pipeline over its memory."""
    known = links.WordHashes()
    assert all(known[b"w%d" % i] == known[b"w%d" % i] for i in range(100_000))
    assert sum(len(w) + 33 + 36 for w in known) + known.__sizeof__() < 10 << 20


class Arrow:
    """Takes the place of a table and runs the function of an Arrow step at once, in this process."""

    def __init__(self, rows, size=400):
        ids, contents = zip(*rows)
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(contents, pa.string())})
        self.batches = table.to_batches(max_chunksize=size)

    def mapInArrow(self, function, schema):
        return [row for batch in function(iter(self.batches)) for row in batch.to_pylist()]


def least_hashes(line, count):
    """Min-hashes of a line, from its shingles one after the other."""
    n = len(line)
    k = min(paragraphs.SHINGLE, n)
    values = []
    for at in range(n - k + 1 if n else 0):
        value = k
        for word in line[at : at + k]:
            value = ((value ^ (value >> 31)) * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(word)) % 2**64
        values.append((value ^ (value >> 32)) * 0xD6E8FEB86659FD93 % 2**64)
    least = [min(((v * int(m) + int(a)) % 2**64 for v in values), default=2**64 - 1) for m, a in zip(links._MULTIPLY[:count], links._ADD)]
    return [x ^ (x >> 29) for x in least]


def odd_texts():
    rng = random.Random(31)
    rows = ["", " ", "\n\n", "a", "a b c\n\nd", " \x0b a \x1f b", "x " * 120, "x y " * 90, "Bé " * 60 + "\n" + words(rng, 70)]
    rows += [" ".join(rng.choice("ab") for _ in range(rng.randrange(90))) for _ in range(40)]
    return list(enumerate(rows + [words(rng, n) for n in (23, 24, 25, 31, 32, 33, 50, 51, 52, 200)]))


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_texts_worked_on_together_give_what_each_gives_alone(monkeypatch, block):
    """Windows and min-hashes of a block of texts do not cross from one text to the next (op8)."""
    monkeypatch.setattr(paragraphs, "BLOCK_BYTES", block)
    rows = odd_texts()
    want = set()
    for i, text in rows:
        each = [xxhash.xxh64_intdigest(w) for w in links.words_of(text)]
        values = []
        for at in range(len(each) - paragraphs.SHINGLE + 1):
            value = 0
            for word in each[at : at + paragraphs.SHINGLE]:
                value = ((value ^ (value >> 29)) * int(paragraphs._BASES[0]) + word) % 2**64
            values.append((value ^ (value >> 32)) * int(paragraphs._BASES[1]) % 2**64)
        for at in range(len(values) - paragraphs.SPREAD + 1):
            start = min(range(at, at + paragraphs.SPREAD), key=values.__getitem__)
            if start + paragraphs.WINDOW <= len(each):
                want.add((i, start, *links.words_of(text)[start : start + paragraphs.WINDOW]))
    contents = {i: links.words_of(text) for i, text in rows}
    got = paragraphs.window_table(Arrow(rows))
    assert {(r["doc_id"], r["start"], *contents[r["doc_id"]][r["start"] : r["start"] + paragraphs.WINDOW]) for r in got} == want
    assert len(got) == len(want)
    assert len({(r["key1"], r["key2"]) for r in got}) == len({w[2:] for w in want})

    for least in (0, 3, 50):
        lines = [(i, start, line) for i, text in rows for start, line in paragraphs.lines_of(text, least)]
        units = paragraphs.paragraph_table(Arrow(rows), least)
        assert [(u["doc_id"], u["start"], u["n_words"]) for u in units] == [(i, start, len(line)) for i, start, line in lines]
        for unit, (_, _, line) in zip(units, lines, strict=True):
            tokens = least_hashes(line, paragraphs.BANDS * paragraphs.ROWS)
            bands = []
            for b in range(paragraphs.BANDS):
                band = b + 1
                for token in tokens[b * paragraphs.ROWS : (b + 1) * paragraphs.ROWS]:
                    band = ((band ^ (band >> 29)) * int(paragraphs._BASES[0]) + token) % 2**64
                bands.append(band - (2**64 if band >= 2**63 else 0))
            assert unit["bands"] == bands


def test_texts_without_units_give_no_rows():
    for rows in ([(1, "")], [(1, "a b"), (2, " \n")]):
        assert paragraphs.window_table(Arrow(rows)) == paragraphs.paragraph_table(Arrow(rows), 50) == []


def test_few_calls_for_a_paragraph():
    """Each word was looked up and each paragraph hashed by itself, in some hundred calls: 1,215 CPU seconds a GB (op8)."""
    rng = random.Random(41)
    rows = [(i, words(rng, 60)) for i in range(400)]
    for step in (paragraphs.window_table, lambda df: paragraphs.paragraph_table(df, 50)):
        calls = [0]

        def count(frame, event, arg):
            calls[0] += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            step(Arrow(rows))
        finally:
            sys.setprofile(None)
        assert calls[0] < 40 * len(rows)
