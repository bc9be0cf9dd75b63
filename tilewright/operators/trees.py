"""Trees of any depth as rows: JSON walked level by level as VARIANT, with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.storage import durable


def leaves(trees: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, at, kind, value) of the scalars in a column of JSON texts.

    at: the place in the array that holds it, null in an object; kind: text, number or flag; value as text. Nulls and empty
    containers are no rows; a text that isn't JSON, or null, has none. A level is one explosion of all trees at once, and
    is written to the shared folder, so that a deep tree is no deep plan; levels end with the deepest tree.
    """
    spark = trees.sparkSession
    level, out = trees.select(*keys, F.lit("$").alias("path"), F.lit(None).cast("int").alias("at"), F.try_parse_json(F.col(column)).alias("v")), None
    while True:
        told = durable(level.withColumn("schema", F.schema_of_variant("v")))
        holds = F.col("schema").startswith("OBJECT") | F.col("schema").startswith("ARRAY")
        kind = F.when(F.col("schema") == "STRING", "text").when(F.col("schema") == "BOOLEAN", "flag").when(F.col("schema") != "VOID", "number")
        own = told.where(~holds).select(*keys, "path", "at", kind.alias("kind"), F.try_variant_get("v", "$", "string").alias("value")).where("kind IS NOT NULL")
        out = own if out is None else out.unionByName(own)
        inner = told.where(holds)
        if not inner.limit(1).count():
            return out
        each = inner.drop("at", "schema").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "child"))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = each.select(*keys, F.concat("path", step).alias("path"), F.when(F.col("key").isNull(), F.col("pos")).alias("at"), F.col("child").alias("v"))


def expression_literals(found: DataFrame) -> DataFrame:
    """leaves() without the first of each array, which names an operator."""
    return found.where(F.col("at").isNull() | (F.col("at") > 0))
