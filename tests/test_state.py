"""Caches, chains of loads and single flight: batch, stream and a sequential replay give the same rows."""

from __future__ import annotations

import datetime
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tilewright.operators import asof, cache
from tilewright.streaming import state

EPOCH = datetime.datetime(2024, 1, 1)


def reads(seed, n=700, keys=6):
    """A hot key with half of all reads, ties in time, a null key."""
    r = random.Random(seed)
    names = ["hot"] * keys + [f"k{k}" for k in range(keys - 1)] + [None]
    return [(r.choice(names), r.randrange(3000), seq, r.random() < 0.6, r.randrange(0, 90)) for seq in range(n)]


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(row[0], []).append(row)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, at long, seq long, ok boolean, takes long")


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def ttl_replay(rows, fresh, stale, keep):
    for k, own in by_key(rows).items():
        entry = None
        for _, at, seq, *_ in own:
            age = None if entry is None else at - entry
            verdict = "miss" if age is None or keep is not None and age > stale + keep else "fresh" if age <= fresh else "stale" if age <= stale else "expired"
            if verdict in ("miss", "expired"):
                entry = at
            yield k, seq, verdict


@pytest.mark.parametrize(("fresh", "stale", "keep"), [(20, 90, None), (20, 90, 30), (0, 5, 0), (500, 4000, None)])
def test_ttl_equals_replay(spark, fresh, stale, keep):
    rows = reads(stale)
    got = cache.ttl_reads(frame(spark, rows), "k", fresh, stale, keep)
    assert pairs(got, "k", "seq", "state") == sorted(ttl_replay(rows, fresh, stale, keep), key=str)


def test_refresh_equals_replay(spark):
    rows = reads(4)
    want = []
    for k, own in by_key(rows).items():
        loaded = None
        for _, at, seq, ok, _ in own:
            if loaded is not None and at <= loaded + 40:
                want.append((k, seq, "fresh"))
            elif ok:
                loaded = at
                want.append((k, seq, "loaded"))
            else:
                want.append((k, seq, "stale" if loaded is not None and at <= loaded + 100 else "failed"))
    assert pairs(cache.manifest_refresh(frame(spark, rows), "k", 40, 100), "k", "seq", "state") == sorted(want, key=str)


def test_single_flight_equals_replay(spark):
    rows = reads(9)
    want = []
    for k, own in by_key(rows).items():
        leader, done = None, None
        for _, at, seq, _, takes in own:
            if leader is None or at > done:
                leader, done = seq, at + takes
            want.append((k, seq, leader, done))
    got = cache.single_flight(frame(spark, rows), "k", 50)
    assert pairs(got, "k", "seq", "leader", "done") == sorted(want, key=str)
    assert cache.single_flight(frame(spark, rows).limit(0), "k", 50).count() == 0


@pytest.mark.parametrize("after", [True, False])
def test_nearest_equals_loop(spark, after):
    rows = [(x[0], x[1], x[2]) for x in reads(1, 300)]
    points = [(x[0], x[1] + x[2] % 3 - 1, x[2]) for x in reads(2, 200)] + [("none", 5, 1), ("hot", -100, 1), ("hot", 9999, 1), ("hot", None, 7)]
    got = asof.nearest(spark.createDataFrame(points, "k string, at long, seq long"), spark.createDataFrame(rows, "k string, at long, seq long"), "k", 64, after)
    want = []
    for k, at, seq in points:
        own = [] if at is None else [(a, s) for j, a, s in rows if j == k and ((a, s) >= (at, seq) if after else (a, s) <= (at, seq))]
        want.append((k, at, seq, (min if after else max)(own) if own else None))
    have = [(r["k"], r["at"], r["seq"], None if r["found"] is None else tuple(r["found"])) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_chains_of_a_thousand(spark):
    steps = spark.range(1000).select("id", (F.col("id") + 1).alias("to")).where("id % 500 <> 499").unionByName(spark.createDataFrame([(999, None)], "id long, to long"))
    got = asof.chain(spark.createDataFrame([(3,), (990,)], "id long"), steps, ["id"], ["to"])
    assert sorted(r["id"] for r in got.collect()) == [*range(3, 500), *range(990, 1000)]


def lru_replay(rows, fresh, stale, keep, budget, most):
    caches = {}
    for shard, key, at, seq, size in sorted(rows, key=lambda x: (x[0], x[2], x[3])):
        held = caches.setdefault(shard, OrderedDict())
        for k in [k for k, e in held.items() if at - e[1] > stale + keep]:
            del held[k]
        age = at - held[key][1] if key in held else None
        verdict = "miss" if age is None else "fresh" if age <= fresh else "stale" if age <= stale else "expired"
        gone = 0
        if verdict in ("fresh", "stale"):
            held.move_to_end(key)
        else:
            held.pop(key, None)
            if 0 < size <= budget:
                held[key] = (size, at)
                while (sum(e[0] for e in held.values()) > budget or len(held) > most) and len(held) > 1:
                    held.popitem(last=False)
                    gone += 1
        yield shard, seq, verdict, gone


def stream(spark, tmp_path, rows, **limits):
    schema = "shard string, key string, at timestamp, seq long, bytes long"
    for n, part in enumerate(rows):
        frame_ = spark.createDataFrame([(a, b, EPOCH + datetime.timedelta(milliseconds=at), s, size) for a, b, at, s, size in part], schema)
        frame_.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert n >= 0
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    name = "out_" + tmp_path.name.replace("-", "_")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
        made = state.tile_cache(source, **limits)
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        spark.conf.set(key, before)
    return sorted((r["shard"], r["seq"], r["state"], r["evicted"]) for r in spark.table(name).collect())


def test_tile_cache_stream_equals_replay(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("ab"), f"t{min(r.randrange(9), r.randrange(9))}", at * 40 + r.randrange(40), at, r.choice([0, 5, 30, 60, 200])) for at in range(150)]
    limits = {"fresh_ms": 300, "stale_ms": 900, "keep_ms": 500, "budget": 120, "entries": 4}
    got = stream(spark, tmp_path, [rows[:50], rows[50:100], rows[100:]], **limits)
    assert got == sorted(lru_replay(rows, *limits.values()))
    assert {x[2] for x in got} == {"miss", "fresh", "stale", "expired"} and any(x[3] for x in got)


def test_ttl_stream_equals_batch(spark, tmp_path):
    """Without eviction a shard of one key is the batch's cache."""
    r = random.Random(6)
    rows = [(f"s{k % 3}", "one", k * 50 + r.randrange(50), k, 1) for k in range(90)]
    got = stream(spark, tmp_path, [rows[:40], rows[40:]], fresh_ms=200, stale_ms=700, keep_ms=100, budget=10, entries=16)
    batch = cache.ttl_reads(spark.createDataFrame([(a, at, s) for a, _, at, s, _ in rows], "k string, at long, seq long"), "k", 200, 700, 100)
    assert [x[:3] for x in got] == sorted((x["k"], x["seq"], x["state"]) for x in batch.collect())
