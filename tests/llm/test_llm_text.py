"""PII, language-model scores, language ID, chat, packing, fingerprints and BPE against brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from conftest import DATA
from llm.llm_cases import frame, texts, words
from pyspark.sql import functions as F

from clickfeat.llm import bpe, chat, fingerprints, langid, lm, packing, pii
from clickfeat.llm.queries import QUERIES, held_out, vocabulary


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_match_patterns():
    rng = random.Random(2)
    signs = "0123456789" * 3 + "....@@@--++  ()aZ_%é\n"
    seen = Counter()
    for _ in range(40_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        want = brute_base(text)
        assert pii.base_spans(text) == want, text
        seen.update(k for k, *_ in want)
    assert set(seen) == set(pii.KINDS)
    for text in ("9" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + "(" * 200_000, "1 " * 100_000):
        assert [s for s in pii.base_spans(text) if s[0] != "ip"] == []


def test_pii_operator(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    detector = pii.fit(docs)
    got = {r.doc_id: r for r in pii.find(docs, detector).collect()}
    for r in docs.collect():
        base = [tuple(s) for s in got[r.doc_id].base]
        every = [tuple(s) for s in got[r.doc_id].spans]
        assert base == brute_base(r.text) and set(base) <= set(every)
        clean = pii.redacted(r.text, every)
        assert not brute_base(clean)
    odd = frame(spark)
    assert pii.find(odd, pii.fit(odd)).count() == len(texts())
    assert pii.find(frame(spark, []), pii.fit(frame(spark, []))).count() == 0
    assert pii.redact(odd, detector).columns == odd.columns


def test_boosted_trees_and_calibration():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    score = pii.BoostedTrees().fit(x[:2000], y[:2000]).score(x[2000:])
    assert ((score > 0) == (y[2000:] > 0)).mean() > 0.97
    steps, chances = pii.calibrated(score, y[2000:])
    assert (np.diff(steps) > 0).all() and (np.diff(chances) > 0).all()


def test_added_spans_need_precision(spark):
    """Numbers in a format that is mostly valid are added; kinds without evidence are not."""
    rng = random.Random(1)
    rows = [(i, f"mail me{i}@host{i}.org or me{i} (at) host.org, room {rng.randint(1, 999)}") for i in range(400)]
    detector = pii.fit(frame(spark, rows))
    assert set(detector.thresholds) <= {"email"}
    assert all(0.5 <= t <= 1 for t in detector.thresholds.values())


def personal(rng, i):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    card = next(digits + d for d in "0123456789" if pii.luhn(digits + d))
    phone = f"+{rng.randint(1, 99)} {rng.randint(200, 999)} {rng.randint(100, 999)} {rng.randint(1000, 99_999_99)}"
    name, host = rng.choice(["jo", "anna.lee", f"name{i}", f"m_{i % 90}"]), rng.choice(["mail.org", "host7.example.org", "a-b.net"])
    return [f"{name}@{host}", ".".join(str(rng.randint(1, 254)) for _ in range(4)), card, phone][i % 4]


def clean(rng, i):
    """Numbers that look like personal data and are not."""
    made = [
        f"order {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(10, 99)} came",
        f"version {rng.randint(1, 9)}.{rng.randint(300, 999)}.{rng.randint(1, 99)}.{rng.randint(300, 999)} is out",
        f"from {rng.randint(1900, 2020)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} to {rng.randint(1900, 2020)}-11-02",
        f"see @ home. or at noon, page {rng.randint(1, 99)}",
    ]
    return made[i % 4]


def test_added_spans_are_disguised_ones(spark):
    """Disguised addresses and numbers that the plain patterns miss are added; clean numbers are not."""
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 8)} {personal(rng, i // 2) if i % 2 else clean(rng, i // 2)} {words(rng, 5)}") for i in range(4000)]
    hidden = ["jane.doe (at) example.org", "bob [at] corp [dot] com", "(212) 555 0199 7788", "4111.1111.1111.1111"]
    planted = [(10_000 + i, f"{words(rng, 6)} write or call {hidden[i % 4]} today") for i in range(200)]
    planted += [(20_000 + i, f"{words(rng, 6)} {clean(rng, i)}") for i in range(200)]
    docs = frame(spark, rows + planted)
    found = pii.find(docs, pii.fit(docs))
    texts_of = dict(rows + planted)
    got = {r.doc_id: [texts_of[r.doc_id][s["start"] : s["end"]] for s in r.spans if s not in r.base] for r in found.collect()}
    for i in range(200):
        assert any(hidden[i % 4] in span for span in got[10_000 + i]), hidden[i % 4]
        assert not got[20_000 + i], texts_of[20_000 + i]
    assert sum(bool(got[i]) for i in range(0, 4000, 2)) == 0


def test_disguises_are_found_by_the_generators_only():
    rng, missed = random.Random(3), 0
    for i in range(2000):
        own = personal(rng, i)
        text, kind = f"x {own} y", pii.KINDS[i % 4]
        (span,) = [s for s in pii.base_spans(text) if s[0] == kind]
        for invalid in (False, True):
            other, spans = pii.rewritten(text, [span], invalid)
            assert len(spans) == 1 and other[spans[0][1] : spans[0][2]] == pii.disguised(kind, own, invalid)
            assert not [s for s in pii.base_spans(other) if s[0] == kind]
        other, spans = pii.rewritten(text, [span])
        missed += not any(pii.covered(c, spans) for c in pii.candidates(other))
    assert not missed


def brute_losses(docs):
    """{doc: (n, target, background)} with counts in dictionaries."""
    counts = [[Counter() for _ in range(lm.ORDER)] for _ in (0, 1)]

    def grams(text):
        padded = "\0" * lm.PAD + text
        for i in range(len(padded)):
            yield i >= lm.PAD, [padded[i - k : i + 1] if i >= lm.PAD else "pad" for k in range(lm.ORDER)]

    for text, target in docs.values():
        for _, each in grams(text):
            for k, g in enumerate(each):
                counts[0][k][g] += 1
                counts[1][k][g] += target
    out = {}
    for doc, (text, target) in docs.items():
        sums = []
        for model in (1, 0):
            own = [Counter() for _ in range(lm.ORDER)]
            if target or not model:
                for _, each in grams(text):
                    for k, g in enumerate(each):
                        own[k][g] += 1
            total = sum(counts[model][0].values()) - sum(own[0].values())
            loss, before = 0.0, None
            for scored, each in grams(text):
                p, context, now = 1 / len(counts[0][0]), total, []
                for k, g in enumerate(each):
                    seen = counts[model][k][g] - own[k][g]
                    p = (min(seen, context) + lm.WEIGHT * p) / (context + lm.WEIGHT)
                    context = before[k] if before else 0
                    now.append(seen)
                before = now
                loss -= scored * math.log(p)
            sums.append(loss / len(text) if text else None)
        out[doc] = (len(text), *sums)
    return out


def test_language_model_matches_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(lm, "BITS", (16, 26, 26, 26))
    rng = random.Random(5)
    rows = {i: (words(rng, rng.randint(0, 30)), i % 3 == 0) for i in range(40)}
    slots = {i: lm.ngram_slots([t])[0] for i, (t, _) in rows.items()}
    import numpy as np

    tables = [np.zeros((2, 1 << b)) for b in lm.BITS]
    for i, (_, target) in rows.items():
        for table, slot in zip(tables, slots[i], strict=True):
            np.add.at(table[0], slot, 1)
            if target:
                np.add.at(table[1], slot, 1)
    n, target, background = lm.NgramModels(tables).score([t for t, _ in rows.values()], [t for _, t in rows.values()])
    for i, (want, a, b, c) in enumerate(zip(brute_losses(rows).values(), n, target, background, strict=True)):
        assert a == want[0]
        if a:
            assert (b, c) == pytest.approx(want[1:], abs=1e-6), i


def test_language_model_counts_do_not_collide(spark, monkeypatch):
    """More distinct characters and n-grams than hashed slots keep apart, over several blocks."""
    monkeypatch.setattr(lm, "BLOCK", 5000, raising=False)
    rng = random.Random(6)
    rows = {i: ("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(300)) + words(rng, 20), i % 3 == 0) for i in range(60)}
    labels = spark.createDataFrame([(i, int(t)) for i, (_, t) in rows.items()], "doc_id long, quality int")
    docs = frame(spark, [(i, t) for i, (t, _) in rows.items()])
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, labels).collect()}
    for i, (n, a, b) in brute_losses(rows).items():
        assert got[i].n_tokens == n and (got[i].target_loss, got[i].background_loss) == pytest.approx((a, b), abs=1e-9)


def test_language_model_in_spark(spark):
    docs = frame(spark, [(i, ("alpha beta " if i % 2 else "gamma delta ") * 20) for i in range(40)] + [(50, None), (51, ""), (None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, labels).collect()}
    assert len(got) == 43 and got[50].n_tokens == 0 and got[51].score is None
    assert max(got[i].score for i in range(1, 40, 2)) < min(got[i].score for i in range(0, 40, 2))
    models = lm.train(lm.with_target(docs, labels, "quality", 1, "doc_id", "text"))
    direct = models.score([("alpha beta " * 20)], [True])
    assert got[1].target_loss == pytest.approx(direct[1][0]) and got[1].background_loss == pytest.approx(direct[2][0])
    assert lm.cross_entropy_difference(frame(spark, []), labels).count() == 0


def test_equal_documents_score_alike_with_and_without_a_label(spark):
    """Leaving a document out of one model only would set labelled documents apart from equal unlabelled ones."""
    rng = random.Random(8)
    docs = [(i, words(rng, 60)) for i in range(200)]
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    got = [r.score for r in lm.cross_entropy_difference(frame(spark, docs), labels).orderBy("doc_id").collect()]
    labelled, others = sum(got[:100]) / 100, sum(got[100:]) / 100
    assert abs(labelled - others) < 0.02


def test_language_id_matches_dictionaries(spark):
    """Posteriors equal those of dictionaries of n-grams, with the prior of all labelled rows."""
    bits, rng = 20, random.Random(9)
    made = {"aa": "abc de", "bb": "xyz De", "cc": "ça été 漢"}
    rows = [(i, rng.choice(list(made))) for i in range(60)]
    docs = [(i, "".join(rng.choice(made[lang] + " 7.") for _ in range(rng.randint(3, 30))), lang) for i, lang in rows]

    def grams(text):
        seen = "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
        return [seen[i : i + k] for i in range(len(seen) - 2) for k in langid.ORDERS if seen[i : i + k].strip()]

    counts, sizes = {lang: Counter() for lang in made}, Counter(lang for *_, lang in docs)
    for _, text, lang in docs:
        counts[lang].update(grams(text))
    every = {g for c in counts.values() for g in c}
    slots = {langid.ngram_slots([g], bits)[0].reshape(-1, len(langid.ORDERS))[0, len(g) - 1] for g in every}
    assert len(slots) == len(every)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df, langid.train(df, bits=bits, per_language=10**6)).collect()}
    for i, text, _ in docs:
        total = {
            lang: math.log(sizes[lang] / len(docs))
            + sum(math.log((counts[lang][g] + langid.SMOOTHING) / (counts[lang].total() + langid.SMOOTHING * 2**bits)) for g in grams(text))
            for lang in made
        }
        top = max(sorted(total), key=total.get)
        if grams(text):
            share = 1 / sum(math.exp(v - total[top]) for v in total.values())
            assert got[i].lang_pred == top and got[i].score == pytest.approx(share, rel=1e-6)
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)


def test_language_prior_uses_all_rows(spark):
    rows = [(i, "abc", "many" if i % 10 else "rare") for i in range(1000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert model.languages == ["many", "rare"]
    assert [math.exp(x) for x in model.prior] == pytest.approx([0.9, 0.1])


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op10_naive_bayes"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == r.lang for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_id_odd_rows(spark):
    docs = frame(spark)
    model = langid.train(docs.filter(~held_out(F.col("doc_id"))))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(texts())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 14, 15))
    assert all(r.lang_pred == "en" for r in got if r.doc_id in (4, 5, 6, 13))
    none = langid.train(frame(spark, []))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    tagged = langid.tag_rows(docs, model).select("row.*")
    assert tagged.columns == docs.columns and tagged.count() == docs.count()


def test_language_model_batches_do_not_matter():
    model = langid.LanguageModel(["a", "b"], __import__("numpy").random.default_rng(0).normal(size=(2, 65)) * 0 - 1, __import__("numpy").zeros(2), 6)
    some = ["abc", "", "d e", "İß", "漢字"]
    slots, starts = langid.ngram_slots(some, 12)
    for i, t in enumerate(some):
        own, _ = langid.ngram_slots([t], 12)
        end = starts[i + 1] if i + 1 < len(some) else len(slots)
        assert (slots[starts[i] : end] == own).all()
    assert model.predict(some)[0][1] == "und"


def test_chat_round_trip(spark):
    nasty = ["", "\\", "<|", "<|end|>\n", "\\<|", "<\\|", "a<", "|>", "\n", "<|start|>user\n", "\\n", "<|nl|>", "\\\\<|<|", None]
    rows = [(i, t, role, text) for i, first in enumerate(nasty) for t, (role, text) in enumerate([("user", first), ("assistant", nasty[-1 - i])])]
    rows += [(100, 0, "we<|ird\nrole\\", "x"), (101, None, None, "y"), (101, 0, "user", "z"), (101, 0, "user", "z"), (None, 1, "user", "q")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_chat(df)
    got = {r.conv_id: r for r in made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
        assert got[conv].valid == (conv is not None and conv < 100)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_state_machine(spark):
    orders = {"ua": True, "sua": True, "uaua": True, "u": False, "au": False, "uu": False, "ss": False, "usa": False, "suau": False, "uaa": False, "ux": False}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(i, t, names[c], "t") for i, order in enumerate(orders) for t, c in enumerate(order)]
    got = {r.conv_id: r.valid for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == dict(enumerate(orders.values()))


def check_packing(rows, docs, tokenizer, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        assert all(r.length == capacity for r in own[1:]) and sum(r.length for r in own) == len(ids)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, bound = check_packing(packing.pack(docs, vocabulary()).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    assert used <= 1.01 * bound + 1
    rows = [(i, t) for i, t in texts() if i is not None and i not in (17, 18)]
    check_packing(packing.pack(frame(spark, rows), vocabulary()).collect(), dict(rows), tokenizer)
    packed = packing.pack(frame(spark), vocabulary(), with_ids=True)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in texts()})
    assert all(len(r.ids_hex) <= 2048 * 8 for r in packing.sequences(packed).collect())
    assert packing.pack(frame(spark, []), vocabulary()).count() == 0


def test_packing_plan_covers_every_histogram():
    rng = random.Random(6)
    for capacity in (1, 7, 64, 300):
        for _ in range(15):
            histogram = {rng.randint(1, capacity): rng.choice([1, 3, 50, 10_000]) for _ in range(rng.randint(0, 20))}
            places, free = set(), Counter()
            for length, first, copies, sequence, times, offset in packing.plan(histogram, capacity, 40):
                for s in range(min(copies, 200) if length < capacity else 0):
                    for t in range(times):
                        span = (sequence + s, offset + t * length)
                        assert span not in places and span[1] + length <= capacity
                        places.add(span)
                free[length] += copies * times
            assert {n: c for n, c in free.items() if n < capacity} == {n: c for n, c in histogram.items() if n < capacity}


def test_packing_is_near_the_bound():
    """A case with a known optimum: a third and two thirds always meet."""
    plan = packing.plan({680: 3000, 1368: 3000, 1000: 500, 1048: 500}, 2048)
    assert max(p[3] + p[2] for p in plan) <= 3500 * 1.01


def test_packing_program_is_solved():
    """The linear program covers every length, at an amount close to a lower bound, whatever the number of lengths."""
    rng = random.Random(11)
    many = {n: rng.choice([1, 2, 3, 40]) for n in rng.sample(range(1, 512), 400)}
    hot = {**{n: 3 for n in range(20, 300, 7)}, 64: 5000}
    halves = {n: rng.choice([1, 1000]) for n in range(260, 500, 3)}  # two never fit, so each piece takes a sequence
    for histogram, bound in ((many, None), (hot, None), (halves, sum(halves.values()))):
        covered, total = Counter(), 0.0
        for config, amount in packing.solve_configurations(histogram, 512):
            assert sum(config) <= 512 and amount >= 0
            total += amount
            for n in config:
                covered[n] += amount
        assert all(covered[n] >= c * (1 - 1e-9) for n, c in histogram.items())
        assert total <= 1.06 * (bound or sum(n * c for n, c in histogram.items()) / 512)


def brute_fingerprint(text):
    found = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    heavy = [int(len(w) > 3) for w in found]

    def h(x, seed=42):
        return xxhash.xxh64_intdigest(x, seed=seed)

    each = [(h(b.encode(), h(a.encode())), heavy[i] + heavy[i + 1]) for i, (a, b) in enumerate(zip(found, found[1:], strict=False))]
    if len(found) == 1:
        each = [(h(found[0].encode()), heavy[0])]
    votes, total = [0] * 128, 0
    for value, weight in each:
        packed = ((value & ~3) | weight).to_bytes(8, "little")
        # A literal int hashes as four bytes padded in the same way as a long does not: seed first, then the int.
        one, two = h(packed), xxhash_int(1, h(packed))
        total += weight + 1
        for j in range(64):
            votes[j] += (one >> j & 1) * (weight + 1)
            votes[64 + j] += (two >> j & 1) * (weight + 1)
    bits = [int(2 * v > total) for v in votes]
    return "".join(f"{sum(b << j for j, b in enumerate(bits[k : k + 64])):016x}" for k in (0, 64))


def xxhash_int(value, seed):
    """Spark hashes an int as one four-byte block."""
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed=seed)


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(i * 7 - 20, words(rng, rng.randint(0, 60))) for i in range(90)] + [(9000, None), (9001, "É\U0001f642x one"), (9002, "a")]
    rows.append((9003, rows[3][1]))
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    prints = {i: brute_fingerprint(t or "") for i, t in rows}
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[i], brute_fingerprint(edited))

        def like(a, b):
            d = (int(a, 16) ^ int(b, 16)).bit_count()
            return max(0.0, math.cos(math.pi * d / 128))

        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint), abs=1e-12)
        assert r.near_next == pytest.approx(like(r.fingerprint, prints[rows[(n + 1) % len(rows)][0]]), abs=1e-12)
        within = sum((int(prints[i], 16) ^ int(p, 16)).bit_count() <= 6 for p in prints.values()) - 1
        assert r.n_within == (within if i % 50 == 0 else None)


def test_fingerprints_odd_rows(spark):
    got = fingerprints.fingerprint_edits(frame(spark)).collect()
    assert len(got) == len(texts())
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by_text[6] == by_text[17] == by_text[7] == by_text[11]
    assert by_text[1] == by_text[2] == {"0" * 32}
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_edits(frame(spark, [(5, "a b c d")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"a b " + b"a b").hexdigest() and one[0].near_next == 1


def test_radius_search_matches_all_pairs(spark):
    rng = random.Random(10)
    base = [rng.getrandbits(128) for _ in range(40)]
    every = list(dict.fromkeys(b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 9))) for b in base for _ in range(12)))

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in every]
    df = spark.createDataFrame(rows, "h1 long, h2 long")
    for radius in (0, 3, 6):
        got = sorted(map(tuple, fingerprints.within_radius(df.limit(100), df, radius).collect()))
        want = sorted((*rows[i], *rows[j]) for i in range(100) for j in range(len(rows)) if (every[i] ^ every[j]).bit_count() <= radius)
        assert got == want
    with pytest.raises(ValueError):
        fingerprints.within_radius(df, df, 7)


def test_radius_search_broadcasts_no_exploded_table(spark):
    """Each fingerprint becomes 28 rows, of which Spark's size estimate counts one."""
    df = spark.range(50_000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    found = fingerprints.within_radius(df.limit(10), df)
    assert len(found.collect()) == 10
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    own = bpe.Encoder(vocabulary())
    rng = random.Random(4)
    signs = "ab cdeé\n\t  '’sSreTthing0129 .,!?-_ñ<|>　\x85\xa0\x1c漢字\U0001f642á​\r﻿٣Ⅷ"
    plain = "".join(t for _, t in texts() if t)[:5000]
    cases = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    cases += [plain[k : k + rng.randint(1, 90)] * rng.randint(1, 3) for k in (rng.randrange(5000) for _ in range(2000))]
    cases += ["<|endoftext|>", "a<|endoftext|> b", "aaaa" * 500, " " * 3000, "thethethethe" * 40]
    want = tokenizer.encode_batch(cases, add_special_tokens=False)
    got = own.encode_batch(cases)
    for text, blob, one in zip(cases, got, want, strict=True):
        ids = [int.from_bytes(blob[k : k + 4], "little") for k in range(0, len(blob), 4)]
        assert ids == one.ids, text
        assert bpe.decoded(ids, bpe.byte_table(vocabulary())) == tokenizer.decode(one.ids, skip_special_tokens=False)
    assert bpe.decoded([200, 130, 50256], bpe.byte_table(vocabulary())) == tokenizer.decode([200, 130, 50256], skip_special_tokens=False)


def test_bpe_small_table(monkeypatch):
    """Emptying the tables of segments changes nothing."""
    monkeypatch.setattr(bpe, "CACHE", 5)
    one, rng = bpe.Encoder(vocabulary()), random.Random(3)
    monkeypatch.undo()
    other = bpe.Encoder(vocabulary())
    for _ in range(20):
        batch = [words(rng, 6) for _ in range(5)]
        assert one.encode_batch(batch) == other.encode_batch(batch)


def test_bpe_in_spark(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    encoded = bpe.decode(bpe.encode(frame(spark), vocabulary()), vocabulary()).collect()
    want = sorted((str(i), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in texts())
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in encoded) == want
    assert bpe.encode(frame(spark, []), vocabulary()).count() == 0


def test_other_vocabulary_takes_the_general_path(tmp_path):
    """A file whose merges do not follow its ids is encoded by the library that reads it."""
    with open(vocabulary(), encoding="utf-8") as f:
        data = json.load(f)
    data["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(data))
    from tokenizers import Tokenizer

    assert packing.fast_encoder(str(path))("one two") == Tokenizer.from_file(str(path)).encode("one two").ids
