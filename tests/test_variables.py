import json

from faultlens.functions.variables import Caps, variables


def rows(spark, *values, **kw):
    texts = [v if isinstance(v, str) or v is None else json.dumps(v) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, local_variables string")
    got = variables(df, **kw)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    return {(r.id, r.name, r.path): (r.type, r.value, r.truncated, r.filtered) for r in got.collect()}


def test_scalars_and_masks(spark):
    got = rows(spark, {"i": 3, "big": 10**20, "f": 2.5, "e": 1e300, "s": "call password=abc now", "n": None, "b": False, "Secret_Thing": {"a": 1}, "empty": {}, "none": []})
    assert got[(0, "i", "")] == ("Integer", "3", False, False) and got[(0, "big", "")][0] == "Integer" and got[(0, "e", "")][0] == "Float"
    assert got[(0, "s", "")] == ("String", "call password=[FILTERED] now", False, False)
    assert got[(0, "n", "")] == ("NilClass", None, False, False) and got[(0, "b", "")] == ("Boolean", "false", False, False)
    assert got[(0, "Secret_Thing", "")] == ("Hash", "[FILTERED]", False, True)
    assert got[(0, "empty", "")] == ("Hash", "{}", False, False) and got[(0, "none", "")] == ("Array", "[]", False, False) and len(got) == 10


def test_caps(spark):
    caps = Caps(variables=3, depth=2, string=5, array=2, hash=1)
    got = rows(spark, {f"v{i}": i for i in range(9)}, {"a": [1, 2, 3, 4], "h": {"x": "long text", "y": 2}, "l": [[[1]]]}, caps=caps)
    assert sum(k[0] == 0 for k in got) == 3
    assert {k[1:]: v[1:3] for k, v in got.items() if k[0] == 1} == {("a", "[0]"): ("1", False), ("a", "[1]"): ("2", False), ("a", ""): ("(more items)", True), ("h", ".x"): ("long ", True), ("h", ""): ("(more items)", True), ("l", "[0][0]"): ("(depth limit reached)", True)}


def test_what_is_no_object_has_no_rows(spark):
    assert rows(spark, None, "", "{oops", "[1]", "3", "{}") == {}
