"""Instrumentation events of a request as its crumbs, and issue webhooks as changes of errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.rangejoin import micros

EVENT = "request_id string, name string, at timestamp_ntz, duration_ms double, payload map<string,string>"
#: The longest texts that a crumb keeps.
SQL_LENGTH, MESSAGE_LENGTH, META_LENGTH, KEY_LENGTH, SHORT_KEY = 200, 500, 200, 100, 40
#: Events of a request limiter, of websockets with their verb, and of file storage.
LIMITER = ("throttle", "blocklist", "track")
CABLE = {"perform_action": "perform", "transmit": "transmit", "transmit_subscription_confirmation": "subscribed", "transmit_subscription_rejection": "rejected"}
STORAGE = {"upload": "upload", "download": "download", "streaming_download": "download", "delete": "delete", "delete_prefixed": "delete_prefixed", "exist": "exist?"}


def _cut(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def _meta(**values: Column) -> Column:
    """The values that aren't null, each cut to what a crumb keeps."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), _cut(v.cast("string"), META_LENGTH))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def event_crumbs(events: DataFrame, own_prefix: str | None = None) -> DataFrame:
    """Events (columns of ``EVENT``) -> (request_id, t, c, m, d, meta), for ``plans.crumbs.last_crumbs`` and the summaries.

    Framework events are SQL (but for schema queries and those on tables with ``own_prefix``), controller
    actions, cache reads and writes, jobs, mails and deprecations; others are those of the request limiter,
    websockets and file storage. Events of other names, and those outside a request, give no crumb. One
    projection, so it runs on streams as well.
    """
    p, name = F.col("payload"), F.col("name")
    text = lambda k: F.coalesce(p[k], F.lit(""))
    present = lambda x: F.nullif(x, F.lit(""))
    kind = F.substring_index(name, ".", 1)
    operation = F.regexp_replace(kind, "^service_", "")
    none = F.create_map().cast("map<string,string>")
    channel, service = F.coalesce(p["channel_class"], p["channel"], F.lit("Unknown")), F.coalesce(present(p["service"]), F.lit("Unknown"))
    key, action = present(F.coalesce(p["key"], p["prefix"])), present(p["action"])
    named = lambda table, x: F.create_map(*[F.lit(y) for pair in table.items() for y in pair])[x]
    suffixed = lambda head, x: F.when(x.isNotNull(), F.concat(F.lit(head), x)).otherwise("")
    rows = [
        (name == "sql.active_record", "sql", F.substring(text("sql"), 1, SQL_LENGTH), none),
        (name == "process_action.action_controller", "controller", F.concat(text("controller"), F.lit("#"), text("action")), none),
        (name == "cache_read.active_support", "cache", F.concat(F.lit("cache read: "), text("key")), _meta(hit=p["hit"])),
        (name == "cache_write.active_support", "cache", F.concat(F.lit("cache write: "), text("key")), none),
        (name == "perform.active_job", "job", F.coalesce(p["job"], F.lit("UnknownJob")), none),
        (name == "deliver.action_mailer", "mailer", F.concat(text("mailer"), F.lit(" to: ["), text("to"), F.lit("]")), none),
        (name == "deprecation.rails", "deprecation", text("message"), _meta(caller=p["caller"])),
        (name.isin(*[f"{x}.rack_attack" for x in LIMITER]), "rack_attack", F.concat(kind, F.lit(": "), text("rule"), F.lit(" ("), text("discriminator"), F.lit(") "), text("method"), F.lit(" "), text("path")), _meta(rule=text("rule"), type=kind, discriminator=text("discriminator"), path=text("path"), method=text("method"))),
        (name.isin(*[f"{x}.action_cable" for x in CABLE]), "action_cable", F.concat(named(CABLE, kind), F.lit(": "), channel, F.when(kind == "perform_action", suffixed("#", action)).otherwise("")), _meta(channel=channel, event_type=kind, action=action)),
        (name.isin(*[f"service_{x}.active_storage" for x in STORAGE]), "active_storage", F.concat(named(STORAGE, operation), suffixed(" ", _cut(key, SHORT_KEY)), F.lit(" ("), service, F.lit(")")), _meta(service=service, operation=operation, key=_cut(key, KEY_LENGTH))),
    ]
    crumb = reduce(lambda out, r: out.when(r[0], F.struct(F.lit(r[1]).alias("c"), r[2].alias("m"), r[3].alias("meta"))), rows[1:], F.when(rows[0][0], F.struct(F.lit(rows[0][1]).alias("c"), rows[0][2].alias("m"), rows[0][3].alias("meta"))))
    inner = text("name") == "SCHEMA"
    if own_prefix:
        inner |= text("sql").contains(own_prefix)
    untimed = F.col("x.c").isin("deprecation", "rack_attack")
    kept = events.filter(F.col("request_id").isNotNull() & ~((name == "sql.active_record") & inner)).select("request_id", "at", "duration_ms", crumb.alias("x")).filter("x is not null")
    return kept.select("request_id", F.floor(micros(F.col("at")) / 1000).alias("t"), "x.c", _cut(F.col("x.m"), MESSAGE_LENGTH).alias("m"), F.when(~untimed, F.col("duration_ms")).alias("d"), "x.meta")


def hmac_sha256(body: Column, secret: str) -> Column:
    """The hex digest of HMAC-SHA256 over a text's UTF-8 bytes, from the built-in SHA-256; the key's two pads are constants."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def webhook_verified(provider: Column, body: Column, signature: Column, secret: str) -> Column:
    """Whether the signature header is the provider's of the body: a prefixed or plain HMAC, or the bare token."""
    digest = hmac_sha256(body, secret)
    want = F.when(provider == "github", F.concat(F.lit("sha256="), digest)).when(provider == "gitlab", F.lit(secret)).when(provider.isin("codeberg", "linear"), digest)
    return F.coalesce(signature == want, F.lit(False))


def webhook_changes(events: DataFrame, secret: str) -> DataFrame:
    """Webhooks (provider, body, signature, at) -> (provider, number, change, comment, at) of those verified that close or reopen an issue.

    A body that doesn't parse, lacks the issue's number or says anything else gives no row.
    """
    at = lambda path: F.get_json_object("body", f"$.{path}")
    provider, action, state = F.col("provider"), at("action"), at("data.state.type")
    moved = (at("type") == "Issue") & (action == "update") & F.get_json_object("body", "$.updatedFrom").contains('"stateId"')
    forge = provider.isin("github", "codeberg")
    change = F.when(forge & (action == "closed"), "resolve").when(forge & (action == "reopened"), "reopen")
    change = change.when((provider == "gitlab") & (at("object_attributes.action") == "close"), "resolve").when((provider == "gitlab") & (at("object_attributes.action") == "reopen"), "reopen")
    change = change.when((provider == "linear") & moved & state.isin("completed", "canceled"), "resolve").when((provider == "linear") & moved & state.isin("triage", "backlog", "unstarted", "started"), "reopen")
    number = F.when(forge, at("issue.number")).when(provider == "gitlab", at("object_attributes.iid")).when(provider == "linear", at("data.number")).try_cast("bigint")
    by = F.when(forge, at("sender.login")).when(provider == "gitlab", at("user.username")).otherwise(at("actor.name"))
    label = F.create_map(*[F.lit(x) for k, v in {"github": "Closed on GitHub by ", "gitlab": "Closed on GitLab by ", "codeberg": "Closed on Codeberg by ", "linear": "Completed on Linear by "}.items() for x in (k, v)])[provider]
    comment = F.when(F.col("change") == "resolve", F.concat(label, F.coalesce(by, F.lit(""))))
    ok = events.filter(webhook_verified(provider, F.col("body"), F.col("signature"), secret))
    return ok.withColumns({"change": change, "number": number}).filter("change is not null and number is not null").select("provider", "number", "change", comment.alias("comment"), "at")


def with_issue_changes(logs: DataFrame, changes: DataFrame) -> DataFrame:
    """Errors after the changes of their issues, in order of time: closing resolves what is open, reopening opens what is resolved.

    Changes that find an error in that state already do nothing. An issue's changes are ordered in one
    task; they are few, as people make them. Errors are told by their issue's provider and number.
    """
    key = ["provider", "number"]
    known = logs.filter("external_issue_number is not null").select("id", F.col("external_issue_provider").alias("provider"), F.col("external_issue_number").cast("bigint").alias("number"), F.col("resolved").alias("_was"))
    w = Window.partitionBy("id").orderBy("at", "change")
    before = F.coalesce(F.lag("change").over(w), F.when(F.col("_was"), "resolve").otherwise("reopen"))
    real = changes.join(known, key).withColumn("_before", before).filter("change <> _before")
    done = F.col("change") == "resolve"
    last = real.groupBy("id").agg(F.max(F.when(done, F.struct("at", "comment"))).alias("_closed"), F.max(F.when(~done, F.col("at"))).alias("_opened"))
    rows = logs.join(last, "id", "left")
    closed = F.coalesce(F.col("_closed.at") > F.col("_opened"), F.col("_closed").isNotNull())
    opened = F.col("_opened").isNotNull() & ~closed
    keep = lambda c, t: F.col(c) if c in logs.columns else F.lit(None).cast(t)
    new = {
        "resolved": F.when(closed, True).when(opened, False).otherwise(F.col("resolved")),
        "status": F.when(closed, "resolved").when(opened, "new").otherwise(F.col("status")),
        "resolved_at": F.when(closed, F.col("_closed.at")).when(~opened, keep("resolved_at", "timestamp_ntz")),
        "reopened_at": F.coalesce("_opened", keep("reopened_at", "timestamp_ntz")),
        "resolved_by_name": F.when(F.col("_closed").isNotNull(), "Webhook").otherwise(keep("resolved_by_name", "string")),
        "resolution_comment": F.when(F.col("_closed").isNotNull(), F.col("_closed.comment")).otherwise(keep("resolution_comment", "string")),
    }
    return rows.withColumns(new).drop("_closed", "_opened")
