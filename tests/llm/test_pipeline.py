import os
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from faultlens.llm import language_id, quality
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def surviving(rows, kept_quality, known):
    """What the first four stages leave, by plain loops."""
    rows = [r for r in rows if r[0] in kept_quality and r[0] in known]
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    keep = {min(g)[1] for g in groups.values()}
    rows = [r for r in rows if r[0] in keep]
    return {i for i, _, c in brute(rows, 5, 80, 100) if i == c}


def check(spark, docs, sf_dir):
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = stage(spark, before, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    kept = {r.doc_id for r in quality.classify(docs).filter("kept").collect()}
    left = docs.filter(docs.doc_id.isin(list(kept)))
    known = {r.doc_id for r in language_id.identify(left).filter("lang_pred <> 'und'").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == surviving(rows, kept, known)
    text = dict(rows)
    length, source = defaultdict(int), {r.doc_id: r.source for r in docs.collect()}
    bins = defaultdict(list)
    for r in pieces:
        length[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    assert all(n == len(text[i] or "") for i, n in length.items())
    for b in bins.values():
        seen = [source[r.doc_id] for r in b if source[r.doc_id] is not None]
        assert sum(r.length for r in b) <= 8192 and len(seen) == len(set(seen))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, docs, SF)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_defined_cases(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string"
    text = "The river went over the old stone hill. We saw a quiet paper boat, and it was there for an hour or two."
    rows = [(1, text, "en", "s", 1, "x", "x"), (2, text.replace(" ", "  "), "en", "s", 1, "x", "x"), (3, None, "en", "s", 1, "x", "x"), (4, "", None, None, None, None, None), (5, "12 34", "en", "s", 1, "x", "x"), (None, text, "en", "s", 1, "x", "x"), (None, text + " No more.", "en", "s", 1, "x", "x"), (6, text + " It is so.", None, None, None, None, None), (6, text + " It is so.", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == schema.replace(",", "").split()[::2]
        counts.append(sorted(str(r.doc_id) for r in docs.collect()))
    # blank texts go first, then those without letters, then copies; 6 and 2 are less alike than 0.8 or not
    assert counts[0] == ["1", "2", "5", "6", "6", "None", "None"]
    assert counts[1] == ["1", "2", "6", "6", "None", "None"]
    assert counts[2] == ["2", "6", "None"]
    assert set(counts[3]) >= {"2", "None"}
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_stages_bound_arrow_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline.quality, "keep_good", lambda docs: docs)
    monkeypatch.setattr(corpus_pipeline.language_id, "keep_known", lambda docs: docs)
    monkeypatch.setattr(corpus_pipeline.exact_dedup, "keep_one", lambda docs: docs)
    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", lambda docs: docs)
    monkeypatch.setattr(corpus_pipeline.ngram_join, "jaccard_components", lambda docs, **kw: docs.withColumn("component_id", docs.doc_id))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    try:
        for given, want in (("10000", "1024"), ("100", "100")):  # a smaller one is the session's own
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(key, given)
                stage(spark, docs, "")
                assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
