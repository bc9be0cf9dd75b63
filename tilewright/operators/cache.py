"""Versioned tile caches as tables: upsert, pruning, time to live, recency and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.asof import loads, nearest, with_load
from tilewright.plans.storage import durable


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both, one for each key, the last by order; max_by reduces before rows move."""
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return both.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def prune(rows: DataFrame, shard: str, version: str, current: Column, budget: int, order: list[Column], size: str) -> DataFrame:
    """Rows that stay: of the current version, newest first while the running total of bytes is within the budget of
    their shard. The row that crosses it goes, and all older ones.

    Rows are dealt by ranges of shard and order, so that a shard spreads over tasks; sums of ranges go through a window,
    ranges that begin beyond the budget are dropped whole, and running totals are made within a range.
    """
    dealt = durable(rows.where(F.col(version) == current).repartitionByRange(F.col(shard), *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(shard, "_part").agg(F.sum(size).alias("_held")).select(F.col(shard).alias("_shard"), F.col("_part").alias("_of"), F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_start")).where(F.col("_start") <= budget)
    within = Window.partitionBy(shard, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(starts, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("_part") == F.col("_of")))
    return met.withColumn("running", F.col("_start") + F.sum(size).over(within)).where(F.col("running") <= budget).select(*rows.columns, "running")


def ttl_state(age: Column, fresh: int, stale: int) -> Column:
    """fresh up to and with fresh, stale up to and with stale, else expired; miss without an entry."""
    return F.when(age.isNull(), "miss").when(age <= fresh, "fresh").when(age <= stale, "stale").otherwise("expired")


def lru_survivors(accesses: DataFrame, key: str, at: list[str], size: str, budget: int, entries: int) -> DataFrame:
    """Keys that a cache of this budget keeps after all accesses: by last access, newest first, while bytes and entries
    fit; the newest always stays. Accesses are reduced to one row a key before they are ordered; the running totals are of
    cache entries, which the budget bounds, not of accesses."""
    last = accesses.groupBy(key).agg(F.max(F.struct(*at)).alias("last"), F.max_by(size, F.struct(*at)).alias("bytes")).where((F.col("bytes") > 0) & (F.col("bytes") <= budget))
    newest = last.orderBy(F.desc("last")).limit(entries)
    w = Window.orderBy(F.desc("last")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = newest.withColumn("running", F.sum("bytes").over(w)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("last"))))
    return ranked.where((F.col("running") <= budget) | (F.col("rank") == 1)).select(key, "bytes", "rank")


def manifest_refresh(reads: DataFrame, key: str, fresh: int, stale: int) -> DataFrame:
    """reads (key, at, seq, ok) with what each gets: fresh within fresh of the last load; else it loads, and is loaded if
    that succeeds, stale if not but within stale of the last load, and else failed.

    Loads are found by pointer doubling (operators.asof), so that a key of very many reads isn't folded in one task.
    """
    rows = reads.select(key, "at", "seq", "ok")
    found = loads(rows.withColumn("until", F.col("at") + fresh), key, max(1, fresh // 64))
    met = with_load(rows, found, key, max(1, fresh // 64))
    age, own = F.col("at") - F.col("load.at"), (F.col("at") == F.col("load.at")) & (F.col("seq") == F.col("load.seq"))
    state = F.when(own, "loaded").when(age <= fresh, "fresh").when(age <= stale, "stale").otherwise("failed")
    return met.select(key, "at", "seq", "ok", state.alias("state"))


def ttl_reads(reads: DataFrame, key: str, fresh: int, stale: int, keep: int | None = None) -> DataFrame:
    """reads (key, at, seq) with state: what a cache answers that sets an entry at a miss and at an expired read, and lets
    it age from then on, whatever reads come between. fresh up to and with fresh of its set, stale up to and with stale,
    expired up to keep beyond that (for ever if None), then forgotten, so that the read is a miss."""
    rows = reads.select(key, "at", "seq")
    found = durable(loads(rows.withColumns({"ok": F.lit(True), "until": F.col("at") + stale}), key, max(1, stale // 64)))
    before = found.select(key, F.col("at").alias("set_at"), F.col("seq").alias("set_seq"), "at", (F.col("seq") - 1).alias("seq"))
    last = nearest(before, found, key, max(1, stale // 64), after=False).select(F.col(key).alias("_k"), "set_at", "set_seq", F.col("found.at").alias("last_at"))
    met = with_load(rows, found, key, max(1, stale // 64))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("load.at") == F.col("set_at")) & (F.col("load.seq") == F.col("set_seq"))
    own, age = (F.col("at") == F.col("load.at")) & (F.col("seq") == F.col("load.seq")), F.col("at") - F.col("load.at")
    gone = F.col("last_at").isNull() | (F.lit(False) if keep is None else F.col("at") - F.col("last_at") > stale + keep)
    state = F.when(own, F.when(gone, "miss").otherwise("expired")).when(age <= fresh, "fresh").otherwise("stale")
    return met.join(last, same, "left").select(key, "at", "seq", state.alias("state"))


def single_flight(requests: DataFrame, key: str, width: int) -> DataFrame:
    """requests (key, at, seq, takes) with leader, the seq of the request whose load answers each: its own if no load of
    the key is in flight, that load's if one is (from its start up to and with at + takes), and done, when it ends.

    A load lasts as long as its leader's takes; those who join it don't prolong it. Time is in whole ticks.
    """
    rows = requests.select(key, "at", "seq", "takes")
    found = loads(rows.withColumns({"ok": F.lit(True), "until": F.col("at") + F.col("takes")}), key, width)
    met = with_load(rows, found, key, width)
    lead = found.join(rows.select(F.col(key).alias("_k"), F.col("at").alias("_at"), F.col("seq").alias("_seq"), F.col("takes").alias("_takes")), F.col(key).eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")) & (F.col("seq") == F.col("_seq"))).select("_k", "_at", "_seq", (F.col("_at") + F.col("_takes")).alias("done"))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("load.at") == F.col("_at")) & (F.col("load.seq") == F.col("_seq"))
    return met.join(lead, same).select(key, "at", "seq", "takes", F.col("load.seq").alias("leader"), "done")


def prune_points(writes: DataFrame, shard: str, order: list[str], every: int) -> DataFrame:
    """writes with nth, their number within the shard, and prunes: whether this write is followed by a prune."""
    w = Window.partitionBy(shard).orderBy(*order)
    return writes.withColumn("nth", F.row_number().over(w)).withColumn("prunes", F.col("nth") % every == 0)
