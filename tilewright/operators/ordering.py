"""Order of the input as part of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.storage import durable, partitions


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with place, their number (from 0) within their keys in order; null keys are a key of their own, and rows that
    tie have places of their own.

    Rows are dealt by ranges of keys and order, so that a key with a third of all rows spreads over tasks: each task
    numbers its own, and the counts of earlier tasks are added.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession, rows), *keys, *order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    numbered = durable(dealt.withColumn("_own", F.row_number().over(own).cast("long") - 1))
    held = numbered.groupBy("_part", *keys).agg(F.count("*").alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(F.col("_part").alias("_of"), *(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_{i}"))
    return numbered.join(before, on).select(*rows.columns, (F.col("_own") + F.col("_before")).alias("place"))
