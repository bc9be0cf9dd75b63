"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions alone.

Each source has a target of words and a schedule of its weight over training time from 0 to 1, linear between knots.
The integral of the schedule is the source's cumulative demand; a document stands where the demand reaches the middle
of the words taken up to it, so its position is the inverse of that integral. The mix is range-sorted by position.

Targets share the size of all documents by weight, stop at CAP times a source's size, and the excess is shared again
until none is above: sources in order of size by weight saturate first, so the final level is found in one pass of
running sums over the table of sources. Within a source, documents follow a hash of their id. All are taken the same
whole number of times, and the first of them once more until the target is met to the word.

Running sums within a source are made of two levels, buckets of the hash and rows of a bucket, so that a source with a
third of all rows is dealt over BUCKETS groups, and only sums of buckets meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import stored, table

WEIGHTS, CAP = (5, 2, 1), 3
#: Hex digits of the hash that deal a source into buckets: 16 ** HEX of them.
HEX = 3
#: (time, weight) knots by place in the order of sources, repeating: early, even and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def inverse_demand(share: Column, knots) -> Column:
    """The time at which the integral of a schedule has reached this share (0 to 1) of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, None
    for k, ((t0, w0), (t1, w1)) in enumerate(zip(knots, knots[1:], strict=False)):
        rest = share * F.lit(whole) - F.lit(before)
        slope = (w1 - w0) / (t1 - t0)
        # rest = w0 t + slope t^2 / 2
        t = F.lit(t0) + (rest / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope))
        before += areas[k]
        this = F.least(F.greatest(t, F.lit(t0)), F.lit(t1))
        out = F.when(share * F.lit(whole) <= F.lit(before), this) if out is None else out.when(share * F.lit(whole) <= F.lit(before), this)
    return out.otherwise(F.lit(knots[-1][0]))


def targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(no_source, source_key, place, source_size, target) of each source of (no_source, source_key, size)."""
    sources = sized.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    w = sources.withColumn("place", F.row_number().over(Window.orderBy("no_source", "source_key")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    w = w.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = w.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("heavy", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("rest") / F.col("heavy")).withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(whole)["level"])
    return w.select("no_source", "source_key", "place", "source_size", F.least("most", F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def mixed(documents: DataFrame, weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES, keep: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) of every row, sorted by position; with keep also row, the
    whole original row as a struct (which keeps clashing names apart).

    A null text has size 0, as an empty one; rows of size 0 are taken 0 words of and have no position (they come last).
    A null source is a source of its own, last in the order. Rows with equal ids keep their rows and follow each other by
    size and a hash of the text; a null id counts as an empty one there. An empty table gives an empty result. Reruns agree.
    """
    text, source, key = documents["text"], documents["source"], documents["doc_id"]
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    sized = documents.select(key.cast("long").alias("doc_id"), source.isNull().alias("no_source"), F.coalesce(source.cast("string"), F.lit("")).alias("source_key"), word_count(text).alias("size"), digest.alias("digest"), F.xxhash64(text.cast("string")).alias("tie"), *([F.struct(*(documents[c] for c in documents.columns)).alias("row")] if keep else []))
    sized = sized.withColumn("bucket", F.substring("digest", 1, HEX))
    # sizes alone are kept: counting words again beside whole rows is cheaper than writing these
    sizes = stored(sized.drop("row"))
    sized = sized if keep else sizes
    goals = targets(sizes, weights, cap)
    sums = sizes.groupBy("no_source", "source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("no_source", "source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(goals, ["no_source", "source_key"]).drop("bucket_size")
    inner = Window.partitionBy("no_source", "source_key", "bucket").orderBy("digest", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(sums, ["no_source", "source_key", "bucket"]).withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    wanted = F.floor(F.col("target") + 0.5)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("times", times).withColumn("once_more", wanted - F.col("times") * F.col("source_size"))
    rows = rows.withColumn("taken", F.col("times") * F.col("size") + F.least("size", F.greatest(F.lit(0), F.col("once_more") - F.col("before"))))
    middle = F.col("times") * F.col("before") + F.least("once_more", "before") + F.col("taken") / 2.0
    rows = rows.withColumn("share", F.try_divide(middle, wanted))
    position = None
    for k, knots in enumerate(schedules):
        on = F.col("place") % len(schedules) == k
        value = inverse_demand(F.col("share"), knots)
        position = F.when(on, value) if position is None else position.when(on, value)
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position))
    return rows.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "position", *["row"] * keep).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixture(documents: DataFrame) -> DataFrame:
    """The rows of the mix, with the columns of documents: each document as many times as the words taken of it make
    whole copies (rounded), in the order of the curriculum. Documents of which less than half is taken go."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0))
    return mixed(documents, keep=True).withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


#: The same in SQL. Sources by code point, null last; the same operations in the same order, so that doubles agree.
OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT no_source, source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY no_source, source_key) - 1 AS place FROM s),
r AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS most FROM w),
q AS (SELECT *, most / weight AS ratio FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM q WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio * 1e6 + place) AS final FROM l WHERE ratio >= level),
g AS (SELECT no_source, source_key, place, source_size, least(most, coalesce((SELECT final FROM f) * weight, most)) AS target FROM l),
b AS (SELECT d.*, g.place, g.source_size, g.target, floor(target + 0.5) AS wanted,
    CASE WHEN g.source_size > 0 THEN floor(target / g.source_size) ELSE 0 END AS times,
    coalesce(sum(size) OVER (PARTITION BY no_source, source_key ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN g USING (no_source, source_key)),
t AS (SELECT *, wanted - times * source_size AS once_more FROM b),
k AS (SELECT *, times * size + least(size, greatest(0, once_more - before)) AS taken FROM t),
p AS (SELECT *, (times * before + least(once_more, before) + taken / 2.0) / nullif(wanted, 0) AS share FROM k)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN CASE place % 3
    WHEN 0 THEN least(greatest(0.0 + (sqrt(greatest(2.25 + -2.0 * (share * 1.0 - 0.0), 0.0)) - 1.5) / -1.0, 0.0), 1.0)
    WHEN 1 THEN least(greatest(0.0 + (share * 1.0 - 0.0) / 1.0, 0.0), 1.0)
    ELSE CASE WHEN share * 1.0 <= 0.375 THEN least(greatest(0.0 + (sqrt(greatest(0.25 + 2.0 * (share * 1.0 - 0.0), 0.0)) - 0.5) / 1.0, 0.0), 0.5)
      WHEN share * 1.0 <= 1.0 THEN least(greatest(0.5 + (sqrt(greatest(1.0 + 2.0 * (share * 1.0 - 0.375), 0.0)) - 1.0) / 1.0, 0.5), 1.0) ELSE 1.0 END
  END END AS position
FROM p
"""
