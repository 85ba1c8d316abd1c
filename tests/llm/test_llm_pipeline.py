"""The pipeline against a brute-force version of its stages, and its rules for odd rows."""

import itertools
import re

import pytest
from conftest import DATA
from llm.llm_cases import frame, shingles, similar, smallest_reachable, texts
from llm.test_llm_text import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from clickfeat.llm import langid, pii
from clickfeat.llm.queries import vocabulary


def brute_force(spark, docs):
    """Texts that reach the last stage, by id."""
    rows = {r.doc_id: r.text for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    norm = {}
    for i, t in rows.items():
        norm.setdefault(re.sub("[\x20\x09-\x0d]", "", t), []).append((-len(t), i))
    rows = {min(g)[1]: rows[min(g)[1]] for g in norm.values()}
    sets = {i: shingles(t, 5) for i, t in rows.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])]
    keep = {i for i, c in smallest_reachable(sorted(sets), pairs).items() if i == c}
    kept = docs.filter(docs.doc_id.isin(*keep))
    detector = pii.fit(kept)
    return {i: pii.redacted(rows[i], detector.spans(rows[i])[1]) for i in keep}


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute_force(spark, docs)
    got = corpus_pipeline.run(spark, DATA).collect()
    used, bound = check_packing(got, want, Tokenizer.from_file(vocabulary()))
    assert used <= 1.05 * bound + 1


@pytest.mark.parametrize("rows", [texts(), []], ids=["odd", "empty"])
def test_stages_keep_columns(spark, tmp_path, rows):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.count() <= before.count()
    if rows:
        left = {r.doc_id for r in docs.collect()}
        assert {4, 5, 12, 13} <= left and not {1, 2, 3, 14, 15, 17, 20} & left


def test_repeated_ids_are_told_apart_by_text(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near = base + " tail"
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(3, base), (5, near), (5, other), (5, other), (7, other + " "), (None, "lone text")]
    docs = frame(spark, rows)

    def left(stage, docs):
        return sorted(((r.doc_id or 0, r.text) for r in stage(spark, docs, DATA).collect()), key=str)

    equal = corpus_pipeline.keep_one_of_equal(spark, docs, DATA)
    assert left(lambda *_: equal, docs) == sorted([(0, "lone text"), (3, base), (5, near), (7, other + " ")], key=str)
    assert left(corpus_pipeline.keep_one_of_similar, frame(spark, rows[:3])) == sorted([(3, base), (5, other)], key=str)
    rows = [(1, "a b c"), (5, "abc"), (5, "zzz"), (6, "zzz"), (6, "zzz")]
    assert left(corpus_pipeline.keep_one_of_equal, frame(spark, rows)) == [(1, "a b c"), (5, "zzz")]


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = corpus_pipeline.keep_known_languages(spark, docs, DATA)
    assert first.count() == docs.filter("text rlike '[A-Za-zÀ-ÿ]'").count()
    assert langid.UNDETERMINED == "und"


def test_stages_keep_arrow_batches_small(spark):
    """Batches of 10,000 long texts filled executors (pipeline, pii stage)."""
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        spark.conf.unset(corpus_pipeline.BATCH_CONF)
        assert stage(spark, docs, "").count() == 1
        assert int(spark.conf.get(corpus_pipeline.BATCH_CONF)) <= 1000
