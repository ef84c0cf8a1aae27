import math

import pytest
from pyspark.sql import functions as F

from faultlens.functions import numbers as n
from faultlens.functions import text as t
from faultlens.functions.severity import severity


def value(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_severity(spark):
    s = lambda x, **k: value(spark, severity(F.lit(x), **k))
    assert [s("LoadError"), s("KeyError"), s("Timeout::Error"), s("Other"), s("KeyError", custom={"KeyError": "critical"})] == ["critical", "high", "medium", "low", "critical"]


@pytest.mark.parametrize(("x", "digits", "want"), [(0.25, 1, 0.3), (-2.5, 0, -3.0), (2.675, 2, 2.68), (1.0, 2, 1.0)])
def test_round(spark, x, digits, want):
    assert value(spark, n.round_half_up(F.lit(x), digits)) == want


def series(spark, a, b):
    rows = spark.createDataFrame(list(zip(map(float, a), map(float, b))) or [], "x double, y double")
    s = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(e), F.lit(0.0)).alias(k) for k, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") ** 2), ("syy", F.col("y") ** 2), ("sxy", F.col("x") * F.col("y")))])
    return s.select(n.pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("r")).first().r


def test_pearson(spark):
    assert series(spark, [1, 2, 3, 4, 5], [2, 4, 6, 8, 10]) == 1.0
    assert series(spark, [1, 2, 3, 4, 5], [10, 8, 6, 4, 2]) == -1.0
    assert series(spark, [], []) == series(spark, [0, 0], [1, 2]) == series(spark, [5], [5]) == series(spark, [3, 3], [1, 2]) == 0.0


def test_classifiers(spark):
    assert [value(spark, n.spike_severity(F.lit(x))) for x in (0.0, 1.9, 2.0, 5.0, 10.0)] == ["normal", "normal", "elevated", "high", "critical"]
    assert [value(spark, n.trend_direction(F.lit(x))) for x in (25.0, 20.0, 5.0, -5.0, -6.0, -21.0)] == ["increasing_significantly", "increasing", "stable", "stable", "decreasing", "decreasing_significantly"]
    assert [value(spark, n.correlation_strength(F.lit(x))) for x in (-0.9, 0.5, 0.1)] == ["strong", "moderate", "weak"]
    assert [value(spark, n.burst_intensity(F.lit(x))) for x in (5, 10, 20)] == ["low", "medium", "high"]
    level = lambda x, m, s: value(spark, n.anomaly_level(F.lit(float(x)), F.lit(float(m)), F.lit(float(s))))
    assert [level(10, 10, 2), level(13, 10, 2), level(14, 10, 2), level(16, 10, 2), level(18, 10, 2), level(19, 10, 2), level(11, 10, 0)] == [None, None, "elevated", "elevated", "high", "critical", "critical"]
    assert value(spark, n.deviations_above(F.lit(11.0), F.lit(10.0), F.lit(0.0))) is None
    assert value(spark, n.change(F.lit(0), F.lit(0))) == 0.0 and value(spark, n.change(F.lit(3), F.lit(0))) == 100.0


def test_priority(spark):
    p = lambda s, o, h, u: value(spark, n.priority_score(F.lit(s), F.lit(o), F.lit(float(h)), F.lit(u)))
    assert p("critical", 1000, 0.5, 1000) == round(40 + 25 + 20 + 0.15 * 100)
    assert p("low", 1, 1000, 0) == 15  # 14.5
    assert p("medium", 10, 30, 9) == math.floor(0.4 * 50 + 0.25 * 40 + 0.2 * 50 + 0.15 * 40 + 0.5)


def test_messages(spark):
    norm = lambda m: value(spark, t.normalized_message(F.lit(m).cast("string")))
    assert norm("User #123 not found") == "User :object_id not found"
    assert norm("id 550e8400-e29b-41d4-a716-446655440000 at 10.0.0.1 by a.b@c.org") == "id :uuid at :ipv4 by :email"
    assert norm("#<User:0x00007f8b1a2b3c4d> failed at 2024-01-02T03:04:05Z") == ":memory_address failed at :timestamp_iso"
    assert norm("GET /api/users/123/posts took 12345, kept 999") == "GET /api/users:numbered_path/posts took :large_number, kept 999"
    assert norm(None) == "" and norm("  ") == "  "
    assert value(spark, t.simple_message(F.lit("got 5 'a' \"b\" 0xff #<X y>"))) == "got N '' \"\" HEX #<OBJ>"
    assert value(spark, t.similarity_message(F.lit(" User 5 at 0xAB is #<Foo:0x1f> 'x' "))) == "user n at 0xhex is #<obj> ''"
    assert value(spark, t.truncate(F.lit("abcdefgh"), 6)) == "abc..."


def test_sql(spark):
    f = lambda s: value(spark, t.sql_fingerprint(F.lit(s)))
    assert f("SELECT * FROM users WHERE id = 12 AND name = 'x'") == "SELECT * FROM users WHERE id = ? AND name = ?"
    assert f("select a from t where id in (1, 2, 3)") == "select a from t where id IN (?)"
    assert f('SELECT "t1"."c2" FROM "t1" LIMIT 5') == 'SELECT "t1"."c2" FROM "t1" LIMIT ?'
    assert value(spark, t.sql_table(F.lit('SELECT 1 FROM "users" x'))) == "users"


TRACE = "/srv/app/models/user.rb:10:in `save'\n/usr/lib/ruby/gems/3.4/gems/rack-3.1/lib/rack/head.rb:5:in `call'\n/srv/lib/tool.rb:7"


def test_back_traces(spark):
    assert value(spark, t.frames(F.lit(TRACE))) == ["user.rb:save", "head.rb:call", "tool.rb"]
    assert value(spark, t.significant_frames(F.lit(TRACE))) == "app/models/user.rb:save|/srv/lib/tool.rb"
    assert value(spark, t.backtrace_signature(F.lit(TRACE))) == value(spark, t.backtrace_signature(F.lit("\n".join(reversed(TRACE.split("\n"))))))
    assert value(spark, t.backtrace_signature(F.lit(""))) is None
    assert [value(spark, t.short_path(F.lit(x))) for x in ("/h/.gem/gems/rack-3/x.rb:1", "/o/lib/ruby/3.4/net.rb:2", "/s/app/a.rb:3", "/s/lib/b.rb", "c.rb")] == ["gems/rack-3/x.rb:1", "ruby/3.4/net.rb:2", "app/a.rb:3", "lib/b.rb", "c.rb"]
    assert value(spark, t.truncated_backtrace(F.lit("a\nb\nc"), 2)) == "a\nb\n... (1 more lines truncated)"
    assert [value(spark, t.frame_category(F.lit(x))) for x in ("/s/app/a.rb", "/g/gems/x/lib/y.rb", "/o/lib/ruby/3/net.rb", "lib/z.rb")] == ["app", "gem", "ruby_core", "app"]


def test_error_hash(spark):
    h = lambda m, app=1, custom=None: value(spark, t.error_hash(F.lit("E"), F.lit(m), F.lit(TRACE), F.lit(None).cast("string"), F.lit("show"), F.lit(app), F.lit(custom).cast("string")))
    assert h("user #1") == h("user #2") != h("user #1", 2) and len(h("x")) == 16
    assert h("a", custom="k") == h("b", custom="k") and h("a", custom="") == h("a")


def test_similarity(spark):
    assert value(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert abs(value(spark, t.message_similarity(F.lit("kitten"), F.lit("sitting"))) - 4 / 7) < 1e-9
    j = lambda a, b: value(spark, t.frame_similarity(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")))
    assert abs(j(["a", "b"], ["b", "c"]) - 1 / 3) < 1e-9 and j([], ["a"]) == 0


def test_masks_and_agents(spark):
    assert value(spark, t.masked_message(F.lit("password=abc user=x api_token=1 card 4111-1111-1111-1111"))) == "password=[FILTERED] user=x api_token=[FILTERED] card [FILTERED]"
    assert value(spark, t.masked_url(F.lit("/a?x=1&token=zz&y=2"))) == "/a?x=1&token=%5BFILTERED%5D&y=2"
    assert value(spark, t.masked_json(F.lit('{"a":"1","password":"p"}'))) == '{"a":"1","password":"[FILTERED]"}'
    assert value(spark, t.masked_json(F.lit("no json"))) == "no json"
    assert value(spark, t.masked_json(F.lit('{"a":[{"Token":{"x":1}}],"b":{"pin":null,"c":2.5}}'))) == '{"a":[{"Token":"[FILTERED]"}],"b":{"pin":"[FILTERED]","c":2.5}}'
    assert value(spark, t.masked_json(F.lit("[1]"))) == "[1]" and value(spark, t.masked_json(F.lit(None).cast("string"))) is None
    assert value(spark, t.masked_causes(F.lit('[{"message":"api_key=1 x"},3,{"message":null}]'))) == '[{"message":"api_key=[FILTERED] x"},3,{"message":null}]'
    assert [value(spark, t.platform_of(F.lit(u).cast("string"))) for u in (None, " ", "iPhone", "x Android", "Expo iOS", "Expo", "curl")] == ["API", "API", "iOS", "Android", "iOS", "Mobile", "API"]


def test_cost(spark):
    c = lambda m, i, o, **k: value(spark, t.llm_cost(F.lit(m), F.lit(i).cast("bigint"), F.lit(o).cast("bigint"), **k))
    assert c("GPT-4o", 1_000_000, 100_000) == 3.5
    assert c("unknown", 1, 1) is None and c("gpt-4o", None, None) is None
    assert c("mine", 1_000_000, None, overrides={"Mine": (7.0, 1.0)}) == 7.0
