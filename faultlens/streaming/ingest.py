"""Reports to stored groups, occurrences and notifications as one stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.upsert import KEYS, Rules, as_events
from faultlens.sources.ingest import prepared
from faultlens.streaming.groups import upserted


def context(rows: DataFrame) -> Column:
    """What a report has besides its key and time, as JSON for ``Store``."""
    have = [c for c in ("error_type", "message", "user_id", "request_id", "session_id") if c in rows.columns]
    return F.to_json(F.struct(*have))


def report_events(reports: DataFrame, **options) -> DataFrame:
    """Filtered, sampled, keyed and masked reports as events of the upsert, with ``at`` for the watermark."""
    rows = prepared(reports, **options)
    return as_events(rows, context(rows)).withColumn("at", F.timestamp_micros("at_us"))


def ingested(reports: DataFrame, changes: DataFrame | None = None, groups: DataFrame | None = None, rules: Rules = Rules(), late: str = "10 minutes", **options) -> DataFrame:  # noqa: B008
    """A stream of reports, and one of workflow changes (keys, ``EVENT_DDL``), as outcomes of the upsert."""
    events = report_events(reports, **options)
    if changes is not None:
        events = events.unionByName(changes.select(*KEYS, "at_us", "kind", "target", "rank", "context", F.timestamp_micros("at_us").alias("at")))
    return upserted(events, groups, rules, late)
