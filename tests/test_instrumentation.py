"""Event sources, webhooks and upserts: what the registered queries don't reach."""

import hashlib
import hmac
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultlens.operators import grouping, sequences, workflow
from faultlens.plans import crumbs
from faultlens.sources import instrumentation

NOW = datetime(2024, 1, 30, 12)
AT = lambda m: NOW + timedelta(minutes=m)


def test_hmac(spark):
    bodies = ["", "a", "ünï {}", "x" * 5000, None]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    for secret in ("k", "ü" * 50, "s" * 64):
        got = [r[0] for r in rows.select(instrumentation.hmac_sha256(F.col("body"), secret)).collect()]
        assert got == [None if b is None else hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]


def test_event_crumbs(spark):
    event = lambda name, request="r", /, **payload: (request, name, NOW, 1.5, payload)
    events = spark.createDataFrame(
        [event("sql.active_record", sql="s" * 999), event("sql.active_record", sql="x", name="SCHEMA"), event("sql.active_record", sql="select * from own_logs"), event("sql.active_record", None, sql="x"), event("nothing.known"), ("r", "cache_write.active_support", NOW, None, None), event("deprecation.rails", message="m" * 600), event("perform_action.action_cable", channel="C", action="a"), event("transmit_subscription_rejection.action_cable", channel_class="D"), event("service_delete_prefixed.active_storage", prefix="p" * 150)],
        instrumentation.EVENT,
    )
    out = instrumentation.event_crumbs(events, "own_").collect()
    assert [(r.c, r.m, r.d, r.meta) for r in out] == [
        ("sql", "s" * 200, 1.5, {}),
        ("cache", "cache write: ", None, {}),
        ("deprecation", "m" * 497 + "...", None, {}),
        ("action_cable", "perform: C#a", 1.5, {"channel": "C", "event_type": "perform_action", "action": "a"}),
        ("action_cable", "rejected: D", 1.5, {"channel": "D", "event_type": "transmit_subscription_rejection"}),
        ("active_storage", "delete_prefixed " + "p" * 37 + "... (Unknown)", 1.5, {"service": "Unknown", "operation": "delete_prefixed", "key": "p" * 97 + "..."}),
    ]
    assert {r.t for r in out} == {1706616000000}
    kept = crumbs.last_crumbs(instrumentation.event_crumbs(events, "own_"), "request_id", ["t", "c", "m"], 2)
    assert [r.c for r in kept.orderBy("at").collect()] == ["deprecation", "sql"]


def test_issue_webhooks(spark):
    secret = "s3"
    sign = lambda b: hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest()
    forge = lambda n, action: json.dumps({"action": action, "issue": {"number": n}, "sender": {"login": "ann"}})
    sent = [("github", "sha256=" + sign(b), b, AT(m)) for m, b in enumerate([forge(1, "closed"), forge(2, "reopened"), forge(3, "reopened"), forge(3, "closed"), forge(4, "closed"), forge(4, "reopened"), forge(9, "closed"), forge(5, "opened")])]
    sent += [("github", sign(forge(6, "closed")), forge(6, "closed"), NOW), ("github", None, forge(6, "closed"), NOW), ("gitlab", "wrong", "{}", NOW), ("other", sign("{}"), "{}", NOW), ("github", "sha256=" + sign("{"), "{", NOW), ("codeberg", sign('{"action":"closed"}'), '{"action":"closed"}', NOW), ("codeberg", sign("é"), None, NOW)]
    linear = json.dumps({"type": "Issue", "action": "update", "updatedFrom": {"stateId": "x"}, "data": {"number": 7, "state": {"type": "canceled"}}, "actor": {"name": "bo"}})
    sent += [("linear", sign(linear), linear, NOW), ("gitlab", secret, json.dumps({"object_attributes": {"action": "close", "iid": 8}, "user": {"username": "cy"}}), NOW)]
    changes = instrumentation.webhook_changes(spark.createDataFrame(sent, "provider string, signature string, body string, at timestamp_ntz"), secret)
    assert sorted((r.provider, r.number, r.change, r.comment) for r in changes.collect()) == sorted([("github", 1, "resolve", "Closed on GitHub by ann"), ("github", 2, "reopen", None), ("github", 3, "reopen", None), ("github", 3, "resolve", "Closed on GitHub by ann"), ("github", 4, "resolve", "Closed on GitHub by ann"), ("github", 4, "reopen", None), ("github", 9, "resolve", "Closed on GitHub by ann"), ("linear", 7, "resolve", "Completed on Linear by bo"), ("gitlab", 8, "resolve", "Closed on GitLab by cy")])

    old = NOW - timedelta(days=1)
    rows = [(i, p, i, done, "resolved" if done else "investigating", old if done else None) for i, p, done in ((1, "github", True), (2, "github", True), (3, "github", True), (4, "github", False), (7, "linear", False), (8, "github", False))] + [(10, None, None, False, "new", None)]
    logs = spark.createDataFrame(rows, "id long, external_issue_provider string, external_issue_number int, resolved boolean, status string, resolved_at timestamp_ntz")
    got = {r.id: (r.resolved, r.status, r.resolved_at, r.reopened_at, r.resolved_by_name, r.resolution_comment) for r in instrumentation.with_issue_changes(logs, changes).collect()}
    assert got == {
        1: (True, "resolved", old, None, None, None),  # was so already
        2: (False, "new", None, AT(1), None, None),
        3: (True, "resolved", AT(3), AT(2), "Webhook", "Closed on GitHub by ann"),
        4: (False, "new", None, AT(5), "Webhook", "Closed on GitHub by ann"),
        7: (True, "resolved", NOW, None, "Webhook", "Completed on Linear by bo"),
        8: (False, "investigating", None, None, None, None),  # another provider's number
        10: (False, "new", None, None, None, None),
    }


def test_null_keys_are_keys(spark):
    groups = spark.createDataFrame([(1, None, "h", "E", "m", NOW, NOW, 3, False, "new", None)], "id long, application_id long, error_hash string, error_type string, message string, occurred_at timestamp_ntz, last_seen_at timestamp_ntz, occurrence_count long, resolved boolean, status string, reopened_at timestamp_ntz")
    batch = spark.createDataFrame([(None, "h", "E", "m", AT(1)), (None, "h", "E", "m", AT(2)), (2, "h", "E", "m", AT(2))], "application_id long, error_hash string, error_type string, message string, occurred_at timestamp_ntz")
    merged = grouping.merged_groups(groups, batch, F.lit(str(NOW)).cast("timestamp_ntz"))
    assert sorted((r.id or 0, r.application_id, r.occurrence_count) for r in merged.collect()) == [(0, 2, 1), (1, None, 5)]
    made = merged.filter("id is null").withColumn("id", F.lit(2))
    appended = grouping.appended_occurrences(groups, batch, F.lit(str(NOW)).cast("timestamp_ntz"), made)
    assert sorted((r.error_log_id, r.occurred_at) for r in appended.collect()) == [(1, AT(1)), (1, AT(2)), (2, AT(2))]
    base = lambda p, v: spark.createDataFrame([("E", p, v)], "error_type string, platform string, mean double")
    assert [r.mean for r in sequences.upserted_baselines(base(None, 1.0), base(None, 2.0), ["error_type", "platform"]).collect()] == [2.0]


def test_occurrences_go_where_the_merge_counts_them(spark):
    """An older group that was seen after a late batch doesn't take it."""
    groups = spark.createDataFrame([(1, 1, "h", "E", "m", AT(-30 * 60), AT(-60), 3, False, "new", None)], "id long, application_id long, error_hash string, error_type string, message string, occurred_at timestamp_ntz, last_seen_at timestamp_ntz, occurrence_count long, resolved boolean, status string, reopened_at timestamp_ntz")
    batch = spark.createDataFrame([(1, "h", "E", "m", AT(-120))], "application_id long, error_hash string, error_type string, message string, occurred_at timestamp_ntz")
    as_of = F.lit(str(NOW)).cast("timestamp_ntz")
    merged = grouping.merged_groups(groups, batch, as_of)
    assert sorted((r.id or 0, r.occurrence_count) for r in merged.collect()) == [(0, 1), (1, 3)]
    made = merged.filter("id is null").withColumn("id", F.lit(2))
    assert [r.error_log_id for r in grouping.appended_occurrences(groups, batch, as_of, made).collect()] == [2]


def test_counts_of_batches_and_counters(spark):
    logs = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert tuple(workflow.batch_counts(logs, [1, 1, 2, 5]).first()) == (3, 2, 1)
    ddl = "exception_class string, raise_location string, rescue_location string, period_hour timestamp_ntz, application_id long, raise_count long, rescue_count long, last_seen_at timestamp_ntz"
    new = spark.createDataFrame([("E" * 300, "f", "", NOW, None, 2, None, NOW), ("E" * 260, "f", None, NOW, None, 3, 1, AT(1)), ("", "f", None, NOW, None, 9, 9, NOW), (None, "f", None, NOW, None, 9, 9, NOW)], ddl)
    empty = spark.createDataFrame([], ddl)
    one = workflow.added_counters(empty, new)
    assert [tuple(r) for r in workflow.added_counters(one, new).collect()] == [("E" * 250, "f", None, NOW, None, 10, 2, AT(1))]
