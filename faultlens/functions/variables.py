"""Variables that an error was raised with, from JSON to typed rows: capped in number, depth and length, with sensitive ones masked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.text import SENSITIVE, masked_message


@dataclass(frozen=True)
class Caps:
    """What is kept of an error's variables."""

    variables: int = 15
    depth: int = 3
    string: int = 200
    array: int = 10
    hash: int = 20


DEPTH_LIMIT, FILTERED, MORE = "(depth limit reached)", "[FILTERED]", "(more items)"


def type_name(kind: Column) -> Column:
    """The class of a variant by its schema."""
    integer = kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    names = F.when(kind.startswith("OBJECT"), "Hash").when(kind.startswith("ARRAY"), "Array").when(integer, "Integer")
    return names.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "Float").when(kind == "BOOLEAN", "Boolean").when(kind == "VOID", "NilClass").otherwise("String")


def _sensitive(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(SENSITIVE)), F.lit(False))


def variables(logs: DataFrame, column: str = "local_variables", caps: Caps = Caps()) -> DataFrame:  # noqa: B008
    """(id, name, path, type, value, truncated, filtered): a row for each value within an error's variables, an object of names in JSON.

    Of variables and of the fields of a hash the first in order of their names are kept. A container that is cut has a row
    ``(more items)``, what lies at the depth limit is not shown. JSON that can't be parsed, or is no object, has no rows. Values are exploded level by level within
    their row's task, so nothing is shuffled.
    """
    tvf = logs.sparkSession.tvf
    parsed = logs.select("id", F.try_parse_json(column).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    rows = parsed.lateralJoin(tvf.variant_explode(F.col("v").outer())).filter(F.col("pos") < caps.variables)
    rows = rows.select("id", F.col("key").alias("name"), F.lit("").alias("path"), F.col("value").alias("v"), F.lit(0).alias("depth"), _sensitive(F.col("key")).alias("filtered"), F.lit(False).alias("more"))
    for depth in range(caps.depth):
        kind = F.schema_of_variant("v")
        is_hash = kind.startswith("OBJECT")
        open_ = (F.col("depth") == depth) & ~F.col("filtered") & ~F.col("more") & (is_hash | kind.startswith("ARRAY")) & ~F.to_json("v").isin("{}", "[]")
        found = rows.withColumn("inner", F.when(open_, F.col("v"))).withColumn("cap", F.when(is_hash, caps.hash).otherwise(caps.array))
        found = found.lateralJoin(tvf.variant_explode_outer(F.col("inner").outer())).filter(F.col("pos").isNull() | (F.col("pos") <= F.col("cap")))
        inside, over = F.col("pos").isNotNull(), F.coalesce(F.col("pos") == F.col("cap"), F.lit(False))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        rows = found.select(
            "id",
            "name",
            F.when(inside & ~over, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(inside & ~over, F.col("value")).otherwise(F.col("v")).alias("v"),
            F.when(inside, depth + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(inside & ~over, _sensitive(F.col("key"))).otherwise(F.col("filtered")).alias("filtered"),
            (F.col("more") | over).alias("more"),
        )
    kind = F.schema_of_variant("v")
    text = F.when(kind == "STRING", F.variant_get("v", "$", "string"))
    deep = (F.col("depth") == caps.depth) & ~F.col("filtered") & ~F.col("more")
    long = F.coalesce(F.length(text) > caps.string, F.lit(False))
    shown = F.when(text.isNotNull(), masked_message(F.substring(text, 1, caps.string))).when(kind != "VOID", F.to_json("v"))
    value = F.when(F.col("filtered"), FILTERED).when(F.col("more"), MORE).when(deep, DEPTH_LIMIT).otherwise(shown)
    return rows.select("id", "name", "path", type_name(kind).alias("type"), value.alias("value"), ((long & ~F.col("filtered")) | deep | F.col("more")).alias("truncated"), "filtered")
