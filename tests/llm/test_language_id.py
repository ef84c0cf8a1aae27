import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from faultlens.llm import language_id as lid

SF = "/root/testdata/sf0.001"
WORDS = {"aa": ["lorim", "dolas", "amet", "sita"], "bb": ["wkrz", "przy", "szcz", "trzc"], "cc": ["ouai", "eaux", "ieu", "oeil"]}
SCHEMA = "doc_id long, text string, lang string, score double, held_out string"


def rows(n=300):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, 1.0, "x"))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    got = {r.doc_id: r for r in lid.identify(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in data)
    out = [(got[i].lang_pred, lang) for i, _, lang, *_ in data if got[i].held_out]
    assert len(out) > 50 and sum(a == b for a, b in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    data = rows(120)
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, h) for i, t, lang, s, h in data]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in lid.identify(spark.createDataFrame(x, SCHEMA)).collect()) for x in (data, other))
    assert a == b


def test_defined_cases(spark):
    data = [*rows(60), (1000, None, "aa", 1.0, "x"), (1001, "", None, 1.0, "x"), (1002, "12 34 !?", "aa", 1.0, "x"), (None, "przy szcz", None, 1.0, "x"), (5, "lorim", "aa", 1.0, "x"), (1003, "wkrz " * 50_000, "bb", 1.0, "x")]
    got = lid.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "bb" and by[None].held_out and by[1003].lang_pred == "bb"
    assert lid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = lid.identify(spark.createDataFrame([(0, "abc", None, 1.0, "x")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    kept = lid.keep_known(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "score", "held_out"] and kept.count() == len(data) - 3


def test_nothing_learned_keeps_what_has_letters(spark):
    data = [(i, t, None, s, h) for i, t, _, s, h in rows(20)] + [(1000, None, None, 1.0, "x"), (1001, "12 !?", None, 1.0, "x")]
    held = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else None, s, h) for i, t, _, s, h in data]
    for table in (data, held):
        assert sorted(r.doc_id for r in lid.keep_known(spark.createDataFrame(table, SCHEMA)).collect()) == list(range(20))


def test_keeps_the_languages_it_learned(spark):
    data = rows(120) + [(2000 + i, "Сегодня утром в городе открылась библиотека.", None, 1.0, "x") for i in range(3)]
    assert sorted(r.doc_id for r in lid.keep_known(spark.createDataFrame(data, SCHEMA)).collect()) == list(range(120))
    known = [*data, *((3000 + i, "Сегодня утром в городе открылась новая библиотека, и жители ждали её.", "ru", 1.0, "x") for i in range(20))]
    assert lid.keep_known(spark.createDataFrame(known, SCHEMA)).count() == len(known)


def test_a_language_whose_rows_share_an_id(spark):
    shared = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 3 != 1)
    data = rows(60) + [(shared, f"dzień dobry {i}", "pl", 1.0, "x") for i in range(3000)]
    got = lid.identify(spark.createDataFrame(data, SCHEMA), per_language=20).filter(f"doc_id = {shared}").select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in got] == ["pl"]


def test_ties_go_to_the_language_that_sorts_first():
    examples = [(lang, lid.grams("one and the same text")) for lang in ("zz", "aa")]
    assert lid.predict(lid.fit(examples, 4, 0.1), ["one and the same text"])[0] == ["aa"]


def test_kernel_counts_shared_grams():
    a, b = lid.grams("abc"), lid.grams("xabc!!")
    assert set(a) <= set(b) and len(lid.grams("abab")) == 2 + 2 + 2


def _made_up(n, seed, size=24, texts=30, length=400):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèçñ"
    out = []
    for k in range(n):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(size * 5)]
        out += [(f"l{k:03d}", " ".join(rng.choice(words) for _ in range(length))) for _ in range(texts)]
    return out


def test_many_languages_take_bounded_memory():
    import tracemalloc

    texts = _made_up(64, 3)
    examples = [(lang, lid.grams(t)) for lang, t in texts]
    tracemalloc.start()
    model = lid.fit(examples, 24, 0.1)
    held, most = tracemalloc.get_traced_memory()
    assert most < 700 << 20
    tracemalloc.reset_peak()
    pred = lid.predict(model, [t for _, t in texts[::29]])[0]
    assert tracemalloc.get_traced_memory()[1] - held < 150 << 20
    tracemalloc.stop()
    assert sum(p == lang for p, (lang, _) in zip(pred, texts[::29], strict=True)) >= 0.98 * len(pred)


def test_kernel_and_weights_are_those_of_presence_matrices():
    examples = [(lang, lid.grams(t)) for lang, t in _made_up(3, 5, 8, 6, 40)]
    sets = [g for _, g in examples]
    known = lid.Landmarks(sets[:7])
    dense = lambda of: np.array([np.isin(known.vocabulary, g) for g in of], float) / np.sqrt([len(g) for g in of])[:, None]
    assert np.allclose(known.kernel(sets), dense(sets) @ dense(sets[:7]).T)
    dual = np.random.default_rng(1).normal(size=(7, 3))
    assert np.allclose(known.folded(dual, together=5), dense(sets[:7]).T @ dual, atol=1e-5)


def test_a_dirty_column_of_languages(spark):
    data = rows(90) + [(1000 + i, "przy szcz", f"dirty{i}", 1.0, "x") for i in range(400)]
    docs = spark.createDataFrame(data, SCHEMA)
    assert lid.learn(docs, most_languages=3).languages == ["aa", "bb", "cc"]
    left = lid.unlearned(docs, 3).first()
    assert left.languages == left.documents == sum(zlib.crc32(str(1000 + i).encode()) % 3 != 1 for i in range(400))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_recall_of_short_texts_at_the_pipelines_threshold():
    """Few words of held-out texts of each language that was learned stay."""
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    docs = [(d["doc_id"], d["text"], d["lang"]) for d in docs if d["text"] and d["lang"]]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    model = lid.fit([(lang, lid.grams(t)) for i, t, lang in docs if not held(i)], 24, 0.1)
    for lang in model.languages:
        for words in (1, 3, 10):
            texts = [" ".join(w[k : k + words]) for w in (t.split() for i, t, x in docs if held(i) and x == lang) for k in range(0, min(len(w), 300), 30)]
            texts = [t for t in texts if len(lid.grams(t))]
            score = lid.predict(model, texts)[1]
            recall = sum(s >= 0.05 for s in score) / max(1, len(texts))
            print(f"{lang}, {words} words: {recall:.4f} of {len(texts)}")
            assert recall >= (0.97 if words == 1 else 0.995)
