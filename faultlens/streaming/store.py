"""The tables that an ingest writes, a partition of each a batch, and delivery of its events to sinks.

A batch is outcomes of the upsert. Its occurrences, groups and notifications go to a partition named after its number, which a
second attempt overwrites; its row in the ledger comes last, and readers take only what the ledger has. So a batch that comes
again, whole or after a failure in its midst, changes nothing that a reader sees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from faultlens.operators.upsert import GROUP_DDL, KEYS, OUTCOME_DDL, latest

CONTEXT = "error_type string, message string, user_id long, request_id string, session_id string"
SCHEMAS = {
    "outcomes": OUTCOME_DDL,
    "occurrences": "error_log_id long, occurred_at timestamp_ntz, user_id long, request_id string, session_id string",
    "created": f"id long, {CONTEXT.split(', user_id')[0]}",
    "groups": f"application_id long, error_hash string, {GROUP_DDL}",
    "notifications": "delivery_id string, error_log_id long, outcome string, at timestamp_ntz, occurrence_count long",
    "ledger": "outcomes long",
    "deliveries": "delivery_id string",
}
#: Outcomes by the name of the hook that a plugin has for them.
HOOKS = {"on_error_logged": "created", "on_error_reopened": "reopened", "on_error_recurred": "recurred", "on_error_resolved": "resolve", "on_error_muted": "mute", "on_error_unmuted": "unmute"}
#: The outcomes that are occurrences.
OCCURRED = ("created", "reopened", "recurred")


def at(us: str) -> F.Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


class Store:
    """The tables under ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, context: str = CONTEXT):
        self.spark, self.path, self.context = spark, path.rstrip("/"), context

    def _put(self, rows: DataFrame, table: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch_id={batch_id}")

    def _all(self, table: str) -> DataFrame:
        schema = SCHEMAS[table] + (", batch_id long, sink string" if table == "deliveries" else ", batch_id long")
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """A table's rows of the batches that are done, with their batch_id."""
        return self._all(name).join(self._all("ledger").select("batch_id"), "batch_id", "left_semi")

    def done(self, batch_id: int) -> bool:
        return bool(self._all("ledger").filter(F.col("batch_id") == batch_id).take(1))

    def write(self, outcome: DataFrame, batch_id: int) -> bool:
        """Adds a batch of outcomes; False if it was there already."""
        if self.done(batch_id):
            return False
        self._put(outcome, "outcomes", batch_id)
        rows = self.spark.read.schema(OUTCOME_DDL).parquet(f"{self.path}/outcomes/batch_id={batch_id}")
        own = rows.filter(F.col("outcome").isin(*OCCURRED)).withColumn("c", F.from_json("context", self.context))
        self._put(own.select("error_log_id", at("at_us").alias("occurred_at"), "c.user_id", "c.request_id", "c.session_id"), "occurrences", batch_id)
        self._put(own.filter("outcome = 'created'").select(F.col("error_log_id").alias("id"), "c.error_type", "c.message"), "created", batch_id)
        self._put(latest(rows), "groups", batch_id)
        key = F.concat_ws("-", F.col("error_log_id").cast("string"), F.col("seq").cast("string"))
        self._put(rows.filter("notify").select(key.alias("delivery_id"), "error_log_id", "outcome", at("at_us").alias("at"), "occurrence_count"), "notifications", batch_id)
        self._put(rows.agg(F.count("*").alias("outcomes")), "ledger", batch_id)
        return True

    def groups(self, base: DataFrame | None = None) -> DataFrame:
        """Each group (keys, ``GROUP_DDL``) as the last batch that touched it left it; ``base``: groups from before the first batch."""
        names = [c.split()[0] for c in SCHEMAS["groups"].split(", ")]
        fields = [n for n in names if n not in (*KEYS, "id")]
        last = self.table("groups").groupBy(*KEYS, "id").agg(F.max(F.struct("batch_id", *fields)).alias("x"))
        touched = last.select(*KEYS, "id", *(f"x.{n}" for n in fields))
        if base is None:
            return touched
        same = (base.application_id.eqNullSafe(touched.application_id)) & (base.error_hash.eqNullSafe(touched.error_hash)) & (base.id == touched.id)
        return base.join(touched, same, "left_anti").select(touched.columns).unionByName(touched)

    def sink(self, outcome: DataFrame, checkpoint: str, then: Callable[[int], None] | None = None) -> DataStreamWriter:
        """The writer of a stream of outcomes; ``then`` is called with the number of each batch that is there."""

        def each(batch: DataFrame, batch_id: int) -> None:
            self.write(batch, batch_id)
            if then:
                then(batch_id)

        return outcome.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


@dataclass(frozen=True)
class Sink:
    """Where events go. ``send`` gets the rows to deliver, in which delivery_id tells a row that comes again.

    ``hooks``: a plugin's; it gets the outcomes of these. Without, it gets notifications, which muted errors don't have.
    """

    name: str
    send: Callable[[DataFrame], None]
    hooks: tuple[str, ...] = ()
    enabled: bool = True


@dataclass
class Dispatcher:
    """Delivers to several sinks, each apart: what one couldn't take is offered to it again with the next batch.

    A batch that a sink has taken is noted in the ledger of deliveries, so that it isn't sent again; between a send and its note a
    failure can repeat it, which is what delivery_id is for.
    """

    store: Store
    sinks: list[Sink]
    failures: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len({s.name for s in self.sinks}) < len(self.sinks):
            raise ValueError("two sinks have the same name")

    def rows(self, sink: Sink) -> DataFrame:
        """What the sink gets of all batches that are done."""
        if not sink.hooks:
            return self.store.table("notifications")
        kinds = F.create_map(*[F.lit(x) for h in sink.hooks for x in (HOOKS[h], h)])
        key = F.concat_ws("-", F.col("error_log_id").cast("string"), F.col("seq").cast("string"))
        rows = self.store.table("outcomes").select("batch_id", key.alias("delivery_id"), kinds[F.col("outcome")].alias("hook"), "error_log_id", at("at_us").alias("at"), "occurrence_count")
        return rows.filter("hook is not null")

    def dispatch(self, batch_id: int | None = None) -> dict[str, int]:
        """Offers each sink the batches that it hasn't taken; how many batches each took. Failures are kept in ``failures``."""
        taken = {}
        ledger = self.store._all("ledger").select("batch_id")
        for sink in self.sinks:
            if not sink.enabled:
                continue
            noted = self.store._all("deliveries").filter(F.col("sink") == sink.name).select("batch_id")
            open_ids = [r.batch_id for r in ledger.join(noted, "batch_id", "left_anti").sort("batch_id").collect()]  # numbers of batches that are still to be taken
            self.failures.pop(sink.name, None)
            taken[sink.name] = 0
            for n in open_ids:
                try:
                    sink.send(self.rows(sink).filter(F.col("batch_id") == n))
                except Exception as e:  # a sink's failure is its own
                    self.failures[sink.name] = f"{type(e).__name__}: {e}"
                    break
                self.store.spark.range(1).select(F.lit(sink.name).alias("delivery_id")).write.mode("overwrite").parquet(f"{self.store.path}/deliveries/sink={sink.name}/batch_id={n}")
                taken[sink.name] += 1
        return taken
