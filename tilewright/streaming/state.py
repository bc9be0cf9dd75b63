"""State machines over streams: time-to-live caches and circuit breakers, keyed, by event time.

applyInPandasWithState keeps one small state a key; a state ends by an event-time timeout, so that idle keys free their
memory. The batch forms of the same rules are in operators.metrics and operators.cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def ttl_cache(reads: DataFrame, fresh_ms: int, stale_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, at, state) of reads (key, at timestamp): miss, fresh, stale or expired by the age of the entry.

    A miss or an expired read stores the key anew; bounds are inclusive. An entry is forgotten once it has expired and
    the watermark has passed it.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at in rows["at"]:
            ms = int(at.value // 1_000_000)
            age = None if stored is None else ms - stored
            verdict = "miss" if age is None else "fresh" if age <= fresh_ms else "stale" if age <= stale_ms else "expired"
            if verdict in ("miss", "expired"):
                stored = ms
            out.append(verdict)
        state.update((stored,))
        state.setTimeoutTimestamp(max(stored + stale_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "state": out})

    return reads.withWatermark("at", late).groupBy("key").applyInPandasWithState(run, "key string, at timestamp, state string", "stored long", "append", "EventTimeTimeout")


def circuit_breaker(calls: DataFrame, limit: int, cooldown_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, at, verdict) of calls (key, at timestamp, ok): passed, failed or refused.

    limit failures in a row open the circuit until cooldown_ms after the last; calls meanwhile are refused. The next one
    is a probe; a success starts the count over.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, until = state.get if state.exists else (0, -1)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out, ms = [], 0
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            ms = int(at.value // 1_000_000)
            if ms < until:
                out.append("refused")
            elif ok:
                failures, until = 0, -1
                out.append("passed")
            else:
                failures += 1
                until = ms + cooldown_ms if failures >= limit else -1
                out.append("failed")
        state.update((failures, until))
        state.setTimeoutTimestamp(max(ms, until, state.getCurrentWatermarkMs()) + 24 * 3_600_000)
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "verdict": out})

    return calls.withWatermark("at", late).groupBy("key").applyInPandasWithState(run, "key string, at timestamp, verdict string", "failures int, until long", "append", "EventTimeTimeout")


def coalesced(requests: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(key, window, requests, coalesced): requests of a key within a window are one fetch; windows close with the watermark."""
    grouped = requests.withWatermark("at", late).groupBy("key", F.window("at", window))
    return grouped.agg(F.count("*").alias("requests")).withColumn("coalesced", F.col("requests") - 1)


class TileCache(StatefulProcessor):
    """The cache of one shard: entries age from the read that set them, and the least recently used go when bytes or
    entries are beyond their limits.

    Entries are a map in the state store, so that a batch reads and writes those of its shards alone. They are at most
    `entries` of a shard, which bounds what a call holds. Verdicts follow event time alone: an entry counts as gone keep_ms
    after it has run out; a timer then frees it, whether reads come or not.
    """

    def __init__(self, fresh_ms: int, stale_ms: int, keep_ms: int, budget: int, entries: int):
        self.fresh, self.stale, self.gone, self.budget, self.most = fresh_ms, stale_ms, stale_ms + keep_ms, budget, entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "bytes long, set_ms long, used long")
        self.uses = handle.getValueState("uses", "n long")

    def _drop(self, held: dict[str, list[int]], now: int) -> None:
        for k in [k for k, e in held.items() if now - e[1] > self.gone]:
            del held[k]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(e) for k, e in self.entries.iterator()}
        held = {k: list(e) for k, e in sorted(before.items(), key=lambda x: x[1][2])}  # least recently used first
        use = self.uses.get()[0] if self.uses.exists() else 0
        size = sum(e[0] for e in held.values())
        frame = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        verdicts, evicted = [], []
        for k, at, n in zip(frame["key"], frame["at"], frame["bytes"], strict=True):
            now, gone = int(at.value // 1_000_000), 0
            self._drop(held, now)
            entry = held.pop(k, None)
            age = None if entry is None else now - entry[1]
            verdict = "miss" if age is None else "fresh" if age <= self.fresh else "stale" if age <= self.stale else "expired"
            use += 1
            if verdict in ("fresh", "stale"):
                held[k] = [entry[0], entry[1], use]
            elif 0 < n <= self.budget:
                held[k] = [int(n), now, use]
                size = sum(e[0] for e in held.values())
                while (size > self.budget or len(held) > self.most) and len(held) > 1:
                    size -= held.pop(next(iter(held)))[0]
                    gone += 1
            verdicts.append(verdict)
            evicted.append(gone)
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, e in held.items():
            if before.get(k) != tuple(e):
                self.entries.updateValue((k,), tuple(e))
        self.uses.update((use,))
        self._wake(held)
        yield pd.DataFrame({"shard": [key[0]] * len(frame), "seq": frame["seq"].to_numpy(), "state": verdicts, "evicted": evicted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {k[0]: tuple(e) for k, e in self.entries.iterator()}
        for k, e in held.items():
            if now - e[1] > self.gone:
                self.entries.removeKey((k,))
        self._wake({k: e for k, e in held.items() if now - e[1] <= self.gone})
        yield pd.DataFrame({"shard": [], "seq": [], "state": [], "evicted": []})

    def _wake(self, held: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.handle.registerTimer(min(e[1] for e in held.values()) + self.gone + 1)

    def close(self) -> None:
        pass


def tile_cache(reads: DataFrame, fresh_ms: int, stale_ms: int, keep_ms: int, budget: int, entries: int, late: str = "1 hour") -> DataFrame:
    """(shard, seq, state, evicted) of reads (shard, key, at timestamp, seq long, bytes long): what the shard's cache
    answers, and how many entries the read's own entry drove out. The state store must be the RocksDB one."""
    grouped = reads.withWatermark("at", late).groupBy("shard")
    return grouped.transformWithStateInPandas(TileCache(fresh_ms, stale_ms, keep_ms, budget, entries), "shard string, seq long, state string, evicted long", "Append", "EventTime")
