"""Metrics of ordered series: percentiles by rank, runs, gaps, concurrency and failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F





def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, a column for each share, most): the value at index min(n - 1, floor(n share)) of the ascending order.

    Equal values are counted first, so a hot key's rows shrink to its distinct values before they meet; running counts
    then find each rank. Nulls don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    ran = counts.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda f: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(f)))
    hit = lambda f: (F.col("upto") > at(f)) & (F.col("upto") - F.col("c") <= at(f))
    return ran.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(hit(f), F.col(value))).alias(name) for name, f in shares.items()), F.max(value).alias("most"))


def longest_run(rows: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """(key, longest): most bad rows in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.withColumn("_bad", bad).withColumn("_good", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = r.groupBy(key, "_good").agg(F.count_if("_bad").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))


def first_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps only n of each group before the exchange."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= n)


def order_violations(rows: DataFrame, key: str, order: list[str], index: str) -> DataFrame:
    before = F.lag(index).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_b", before).groupBy(key).agg(F.count_if(F.col("_b") > F.col(index)).alias("violations"))


def continuity(rows: DataFrame, key: str, order: list[str], at: str, value: str, blank: Column, missing: Column, least: int) -> DataFrame:
    before = F.lag(at).over(Window.partitionBy(key).orderBy(*order))
    s = rows.withColumn("_gap", F.col(at) - before)
    out = s.groupBy(key).agg(F.count("*").alias("samples"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(blank).alias("blank"), F.max("_gap").alias("widest_gap"), F.count_if(missing).alias("missing"))
    return out.withColumn("passed", (F.col("blank") == 0) & (F.col("samples") >= least))


def consecutive_failures(rows: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """rows with failures: how many failures in a row end here; any success starts over."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_bad", bad).withColumn("_block", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w))
    inner = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("failures", F.when(F.col("_bad"), F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(inner)).otherwise(0).cast("long")).drop("_bad", "_block")


def disabled(rows: DataFrame, key: str, at: str, bad: Column, window: int) -> DataFrame:
    """rows with disabled: whether a failure of the key lies within the window before."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-window, -1)
    return rows.withColumn("disabled", F.coalesce(F.max(F.when(bad, F.col(at))).over(w).isNotNull(), F.lit(False)))


def max_concurrency(spans: DataFrame, key: str) -> DataFrame:
    """(key, most) of spans (key, start, stop): the most that are open at once, by a sweep of starts and stops.

    Starts and stops of one moment are netted before they move.
    """
    e = spans.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.at", "e.d")
    net = e.groupBy(key, "at").agg(F.sum("d").alias("d"))
    run = net.withColumn("open", F.sum("d").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key).agg(F.max("open").alias("most"))


def status_of(message: Column) -> Column:
    text = F.regexp_extract(message, r"(?i)(?:http|status|response)\D+(\d{3})", 1)
    return F.when(text != "", text.cast("int"))


def retryable(status: Column) -> Column:
    return status.isNull() | status.isin(408, 409, 425, 429) | (status >= 500)


def categories(rows: DataFrame, category: Column, sample: str, n: int) -> DataFrame:
    """(category, n, samples): counts and the first n samples of each; ranks keep n rows a group before the exchange."""
    c = rows.select(category.alias("category"), sample)
    counts = c.groupBy("category").agg(F.count("*").alias("n"))
    few = c.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(sample))).where(F.col("k") <= n)
    return counts.join(few.groupBy("category").agg(F.sort_array(F.collect_list(sample)).alias("samples")), "category")
