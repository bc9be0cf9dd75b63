"""As-of joins and chains of loads in time, without one task for all rows of a key.

Rows of a key are cut into buckets of time. Within a bucket a window carries the nearest row; across buckets a window over
one row a bucket does, so what a task sorts is bounded by the rows of a bucket and by the buckets of a key.

A cache that loads when an entry has run out makes a chain: each load's successor is the first read after the entry's
end. All reads learn their successor in one as-of join; pointers are then doubled, so that a chain of n loads is walked in
log2(n) equi-joins, for all keys at once and without folding the reads of a key one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.storage import durable

LOW = -(1 << 63)


def nearest(points: DataFrame, rows: DataFrame, key: str, width: int, after: bool) -> DataFrame:
    """points with found, a struct (at, seq): of the rows (key, at, seq) of the same key the first at or after the point's
    (at, seq), or the last at or before it; null if there is none. Null keys are a key; a null at finds nothing.

    width: ticks of a bucket, about as long as a few thousand rows of the busiest key take.
    """
    bucket = F.floor(F.col("at") / width).cast("long")
    mark = F.struct("at", "seq")
    tagged = points.select(F.col(key).alias("_k"), "at", "seq", bucket.alias("_b"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("_p")).unionByName(
        rows.where("at IS NOT NULL").select(F.col(key).alias("_k"), "at", "seq", bucket.alias("_b"), F.lit(0).alias("_point"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_p"))
    )
    turn = (lambda c: F.desc(c)) if after else (lambda c: F.asc(c))
    row = F.when(F.col("_point") == 0, mark)
    # rows stand before points of the same place, so that they are found
    here = Window.partitionBy("_k", "_b").orderBy(turn("at"), turn("seq"), "_point").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("_k").orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.min if after else F.max)(row)
    buckets = tagged.groupBy("_k", "_b").agg(best.alias("_best")).withColumn("_edge", F.last("_best", ignorenulls=True).over(across)).where("_edge IS NOT NULL")
    own = tagged.withColumn("_own", F.last(row, ignorenulls=True).over(here)).where("_point = 1")
    edges = buckets.select(F.col("_k").alias("_ek"), F.col("_b").alias("_eb"), "_edge")
    met = own.join(edges, F.col("_k").eqNullSafe(F.col("_ek")) & (F.col("_b") == F.col("_eb")), "left")
    return met.select("_p.*", F.coalesce("_own", "_edge").alias("found"))


def chain(starts: DataFrame, steps: DataFrame, node: list[str], to: list[str]) -> DataFrame:
    """node columns of all nodes that chains from starts reach; steps has each node's columns and those of its successor.

    Every round takes the nodes at a power of two steps and joins the pointers with themselves. Each is written to the
    shared folder; rounds are the logarithm of the longest chain.
    """
    names = [f"_n{k}" for k in range(len(node))]
    reached = durable(starts.select(node).distinct())
    jumps = durable(steps.select(*node, *(F.col(c).alias(n) for c, n in zip(to, names, strict=True))).where(F.col(names[-1]).isNotNull()).distinct())
    same = lambda a, left, b, right: [a[x].eqNullSafe(b[y]) for x, y in zip(left, right, strict=True)]
    n = reached.count()
    while True:
        # the two sides are equal tables at first, so that they need names of their own
        second = jumps.toDF(*(f"_s{k}" for k in range(len(node))), *(f"_t{k}" for k in range(len(node))))
        at = [f"_s{k}" for k in range(len(node))]
        far = [f"_t{k}" for k in range(len(node))]
        more = reached.join(second, same(reached, node, second, at)).select(*(F.col(f).alias(c) for f, c in zip(far, node, strict=True)))
        reached = durable(reached.unionByName(more).distinct())
        before, n = n, reached.count()
        if n == before:
            return reached
        jumps = durable(jumps.join(second, same(jumps, names, second, at)).select(*node, *(F.col(f).alias(c) for f, c in zip(far, names, strict=True))))


def loads(reads: DataFrame, key: str, width: int) -> DataFrame:
    """(key, at, seq) of the reads that load, of reads (key, at, seq, ok, until): the first ok one of each key, and after
    each load the first ok one later than its until. seq tells reads of one time apart and is unique within a key."""
    able = durable(reads.where("ok AND at IS NOT NULL").select(key, "at", "seq", "until").distinct())
    points = able.select(key, F.col("at").alias("own_at"), F.col("seq").alias("own_seq"), (F.col("until") + 1).alias("at"), F.lit(LOW).alias("seq"))
    steps = nearest(points, able, key, width, after=True).select(key, F.col("own_at").alias("at"), F.col("own_seq").alias("seq"), F.col(key).alias("to_key"), F.col("found.at").alias("to_at"), F.col("found.seq").alias("to_seq"))
    firsts = able.groupBy(key).agg(F.min(F.struct("at", "seq")).alias("f")).select(key, "f.*")
    return chain(firsts, steps, [key, "at", "seq"], ["to_key", "to_at", "to_seq"])


def with_load(reads: DataFrame, found: DataFrame, key: str, width: int) -> DataFrame:
    """reads with load, a struct (at, seq): the last load at or before each, itself if it loads; null before the first."""
    return nearest(reads, found, key, width, after=False).withColumnRenamed("found", "load")
