import json
import random
from collections import Counter

from pyspark.sql import functions as F

from faultlens.operators import sequences
from faultlens.operators import upsert as u
from faultlens.plans import crumbs
from faultlens.streaming import figures, requests

S, DAY = 1_000_000, 24 * 3600 * 1_000_000
T0 = 1_704_067_200 * S  # a day's begin


def feed(spark, tmp_path, batches, ddl, make, mode="append"):
    """Runs a stream over batches of rows, one a trigger; each trigger's result rows."""
    folder, out = tmp_path / "in", []
    folder.mkdir()
    schema = spark.createDataFrame([], ddl).schema
    names = schema.names
    stream = make(spark.readStream.schema(schema).json(str(folder)))
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: out.append(rows.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(batches):
            (tmp_path / "part").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
            (tmp_path / "part").rename(folder / f"{i}.json")
            before = len(out)
            q.processAllAvailable()
            out[before:] = [[r for part in out[before:] for r in part]]
    finally:
        q.stop()
    return out


def test_live_figures_over_three_batches(spark, tmp_path):
    events = [("a", 1, "occurrence"), ("a", 2, "occurrence"), ("b", 3, "occurrence")], [("b", 4, "occurrence"), ("a", 5, "resolve")], [("a", 6, "occurrence"), ("c", 7, "occurrence")]
    state, batches = {}, []
    for part in events:
        rows = []
        for h, at, kind in part:
            rows.append(state.setdefault(h, u.KeyState((1, h), u.Rules())).apply(T0 + at * S, kind, None, 2, None))
        batches.append(rows)
    got = feed(spark, tmp_path, batches, u.OUTCOME_DDL, figures.live_figures, "update")
    shown = [{(r.kind, r.target if r.kind == "figure" else json.loads(r.row)["error_hash"]): (r.value if r.kind == "figure" else (r.action, json.loads(r.row)["occurrence_count"], json.loads(r.row)["status"])) for r in rows} for rows in got]
    assert shown[0] == {("figure", "occurrences"): 3, ("figure", "new_errors"): 2, ("figure", "open"): 2, ("row", "a"): ("prepend", 2, "new"), ("row", "b"): ("prepend", 1, "new")}
    assert shown[1] == {("figure", "occurrences"): 4, ("figure", "resolved"): 1, ("figure", "open"): 1, ("row", "a"): ("prepend", 2, "resolved"), ("row", "b"): ("prepend", 2, "new")}
    assert shown[2] == {("figure", "occurrences"): 6, ("figure", "new_errors"): 3, ("figure", "reopened"): 1, ("figure", "open"): 3, ("row", "a"): ("prepend", 3, "new"), ("row", "c"): ("prepend", 1, "new")}


def test_last_crumbs_are_those_of_a_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{rng.randint(0, 5)}", f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", i, f"c{i}") for i in range(200)]
    batches = [rows[:90], rows[90:], [(None, "2024-01-01T00:04:00Z", 1, "no request")], [("clock", "2024-01-01T02:00:00Z", 1, "x")]]
    for part in batches[:2]:
        rng.shuffle(part)
    ddl = "request_id string, at_time timestamp, pos long, crumb string"
    got = [tuple(r) for part in feed(spark, tmp_path, batches, ddl, lambda s: requests.last_crumbs(s, keep=7)) for r in part]
    want = crumbs.last_crumbs(spark.createDataFrame([(r, p, c) for r, _, p, c in rows], "request_id string, pos long, crumb string"), "request_id", ["pos"], 7).select("request_id", "at", "crumb")
    assert sorted(got) == sorted(map(tuple, want.collect())) and len(got) == 42


def test_minute_counts_are_those_of_a_batch_and_expire(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randint(0, 2)}", i, f"2024-01-01T00:{i // 40:02d}:{i % 40:02d}Z") for i in range(300)]
    ddl = "key string, id long, at_time timestamp"
    batches = [rows[:110], rows[110:130], rows[130:]]
    got = [r for part in feed(spark, tmp_path, batches, ddl, lambda s: requests.rate_limited(s, 9)) for r in part]
    whole = spark.createDataFrame(rows, "key string, id long, at string").select("key", "id", F.to_timestamp("at").cast("timestamp_ntz").alias("t"))
    want = sequences.rate_limited(whole, ["key"], "t", F.lit(9), ["t", "id"])
    pick = lambda rs: {r.id: (r.minute.minute, r.at, r.limited) for r in rs}
    assert pick(got) == pick(want.collect()) and Counter(r.limited for r in got)[True] > 20
