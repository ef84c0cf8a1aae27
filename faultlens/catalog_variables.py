"""The query over typed variables, with the rows that they have in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalog import LOGS
from faultlens.functions.variables import variables
from faultlens.sources import driver

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _variables(spark: SparkSession, d: str) -> DataFrame:
    """Each error's variables as JSON: scalars, texts of k * 3 signs, arrays of k % 13 items, nested hashes, and every 50th one broken."""
    k = F.col("k")
    user = F.struct(F.concat(F.lit("n"), k.cast("string")).alias("name"), F.lit("x").alias("Password"), F.transform(F.sequence(F.lit(1), k % 13 + 1), lambda i: i * 2).alias("tags"))
    deep = F.struct(F.struct(F.struct(k.alias("c")).alias("b"), F.lit(1.5).alias("rate")).alias("a"))
    vars_ = F.struct(k.alias("n"), F.expr("repeat('y', k * 3)").alias("text"), (k % 2 == 0).alias("flag"), F.lit("t").alias("api_token_now"), user.alias("user"), deep.alias("zone"))
    json = F.when(F.col("id") % 50 == 7, "{broken").otherwise(F.to_json(vars_))
    return driver.error_logs(spark, d).select("id", json.alias("local_variables"), "k")


ENTRIES["f37_variables"] = (
    lambda spark, d: variables(_variables(spark, d).filter("id % 3 < 2")),
    f"""with {LOGS}, l as (select id, k from logs where id % 50 <> 7 and id % 3 < 2)
select id, 'n' as name, '' as path, 'Integer' as type, cast(k as varchar) as value, false as truncated, false as filtered from l
union all select id, 'text', '', 'String', substr(repeat('y', k * 3), 1, 200), k * 3 > 200, false from l
union all select id, 'flag', '', 'Boolean', case when k % 2 = 0 then 'true' else 'false' end, false, false from l
union all select id, 'api_token_now', '', 'String', '[FILTERED]', false, true from l
union all select id, 'user', '.name', 'String', 'n' || k, false, false from l
union all select id, 'user', '.Password', 'String', '[FILTERED]', false, true from l
union all select id, 'user', '.tags[' || i || ']', 'Integer', cast(2 * (i + 1) as varchar), false, false from l, range(10) r(i) where i <= k % 13
union all select id, 'user', '.tags', 'Array', '(more items)', true, false from l where k % 13 + 1 > 10
union all select id, 'zone', '.a.rate', 'Float', '1.5', false, false from l
union all select id, 'zone', '.a.b.c', 'Integer', '(depth limit reached)', true, false from l""",
)
