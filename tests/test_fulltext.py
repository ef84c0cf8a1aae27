import re

import pytest
from pyspark.sql import functions as F

from faultlens.catalog_text import SENTENCES
from faultlens.functions.stem import STOP_WORDS, lexeme, stem
from faultlens.operators import fulltext

#: Words and their stems in the published sample vocabulary.
SAMPLE = """consign:consign consigned:consign consignment:consign consistency:consist consistently:consist consolation:consol
consolatory:consolatori knackeries:knackeri knavish:knavish kneaded:knead knightly:knight generates:generat generically:generic
hopping:hop hoping:hope happy:happi relational:relat conditional:condit ties:tie cries:cri gas:gas gaps:gap kiwis:kiwi agreed:agre
bed:bed luxuriating:luxuri by:by say:say dying:die universities:univers communication:communic failures:failur caresses:caress
controlling:control roll:roll rated:rate skies:sky exceed:exceed singly:singl electricity:electr hopefulness:hope""".split()


def test_stems():
    assert {p.split(":")[0]: stem(p.split(":")[0]) for p in SAMPLE} == dict(p.split(":") for p in SAMPLE)
    assert len(STOP_WORDS) == 127 and lexeme("the") is None


def test_sentences_have_the_lexemes_given():
    for text, lexemes in SENTENCES:
        assert sorted({lexeme(t) for t in re.findall("[a-z]+", (text or "").lower())} - {None}) == sorted(lexemes)


def rows(spark):
    words = ["connection", "Connected", "the", "refuse", "refusal", "time-out", "naïve", "x1", "of", "ÉTÉ", "timed"]
    texts = [" ".join(words[(i * j) % len(words)] for j in range(1, 5)) for i in range(40)]
    made = [(i, t, None if i % 3 else "app/models/user.rb:12", f"Type{i % 4}Error") for i, t in enumerate(texts)]
    made += [(50, None, None, None), (51, "", "", ""), (52, "connection " * 5000 + "end", None, "E"), (None, "connection", None, "E"), (3, texts[3], None, "E"), (53, "w" * 300, None, None)]
    return spark.createDataFrame(made, "id long, message string, backtrace string, error_type string")


@pytest.mark.parametrize("query", ["connections", "refusing connect", "the", "", "time out", "user models", "été", "naïve x1", "type2error", "missing", "end"])
def test_search_against_brute_force(spark, tmp_path_factory, query):
    global INDEX
    logs = rows(spark)
    if "INDEX" not in globals():
        path = str(tmp_path_factory.mktemp("index") / "lexemes")
        fulltext.write_index(logs, path)
        INDEX = path
    asked = {lexeme(t) for t in re.findall(r"[^\W_]+", query.lower())} - {None}
    text = lambda r: " ".join(x for x in (r.message, r.backtrace, r.error_type) if x is not None).lower()
    want = {r.id for r in logs.collect() if r.id is not None and asked and asked <= {lexeme(t) for t in re.findall(r"[^\W_]+", text(r))}}
    index = fulltext.read_index(spark, INDEX)
    got = [r.id for r in fulltext.search(index, query).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.id for r in logs.filter(fulltext.matches(query, fulltext.searched_text(logs))).collect()} - {None} == want


def test_a_search_reads_the_folders_of_its_lexemes_only(spark, tmp_path):
    fulltext.write_index(rows(spark), str(tmp_path / "ix"))
    plan = fulltext.search(fulltext.read_index(spark, str(tmp_path / "ix")), "connections refused")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and "In(lexeme, [connect,refus])" in plan
    assert fulltext.search(fulltext.read_index(spark, str(tmp_path / "ix")).filter(F.lit(False)), "x").count() == 0
