"""Queries on series of requests, samples and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import metrics as M
from tilewright.plans.registry import also, query

_T = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


def _events(read):
    return read("events").withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long"))


_RANK = lambda f: f"list_sort(list(value))[CAST(least(count(*) - 1, floor(count(*) * {f})) AS BIGINT) + 1]"


@query(f"SELECT event_type, count(*) AS n, {_RANK(0.5)} AS p50, {_RANK(0.95)} AS p95, {_RANK(0.99)} AS p99, max(value) AS most FROM events GROUP BY 1")
def nearest_rank_percentiles(read):
    return M.nearest_rank(read("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"""WITH {_T}, r AS (SELECT *, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM e), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, bad ORDER BY ms, event_id) AS island FROM r),
c AS (SELECT user_id, count(*) AS n FROM g WHERE bad GROUP BY user_id, island) SELECT u.user_id, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id) GROUP BY 1""")
def longest_blank_run(read):
    return M.longest_run(_events(read), "user_id", ["ms", "event_id"], F.col("event_type") == "error")


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 30")
def top_k_slowest(read):
    return read("events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(30)


@query(f"WITH {_T}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM e WHERE event_type = 'error') SELECT user_id, event_id, CAST(n AS INT) AS n FROM r WHERE n <= 20")
def first_n_failures(read):
    return M.first_n(_events(read).where("event_type = 'error'"), "user_id", ["ms", "event_id"], 20).select("user_id", "event_id", "n")


@query("WITH c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS prev FROM conversations) SELECT conv_id, count(*) FILTER (prev > turn) AS violations FROM c GROUP BY 1")
def order_violations(read):
    return M.order_violations(read("conversations").withColumn("k", F.length("text")), "conv_id", ["k", "turn"], "turn")


@query(f"""WITH {_T}, s AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM e)
SELECT user_id, count(*) AS samples, min(value) AS least, max(value) AS most, count(*) FILTER (event_type = 'error') AS blank, CAST(max(ms - before) AS BIGINT) AS widest_gap, count(*) FILTER (value < 1) AS missing, count(*) FILTER (event_type = 'error') = 0 AND count(*) >= 20 AS passed FROM s GROUP BY 1""")
def continuity_report(read):
    return M.continuity(_events(read), "user_id", ["ms", "event_id"], "ms", "value", F.col("event_type") == "error", F.col("value") < 1, 20)


@query("SELECT user_id, count(DISTINCT event_type) AS etags, count(DISTINCT event_type) = 1 AS consistent FROM events GROUP BY 1")
def etag_consistency_all(read):
    e = read("events").groupBy("user_id").agg(F.count_distinct("event_type").alias("etags"))
    return e.withColumn("consistent", F.col("etags") == 1)


@query("SELECT count(*) AS requests, count(DISTINCT user_id) AS keys, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(value) AS peak FROM events")
def counter_snapshot(read):
    return read("events").agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("keys"), F.count_if(F.col("event_type") == "error").alias("failures"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("value").alias("peak"))


@query(f"""WITH {_T}, r AS (SELECT *, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS block FROM e)
SELECT event_id, user_id, CAST(CASE WHEN bad THEN sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, block ORDER BY ms, event_id) ELSE 0 END AS BIGINT) AS failures FROM r""")
def consecutive_failures(read):
    return M.consecutive_failures(_events(read), "user_id", ["ms", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "failures")


@query(f"""WITH {_T} SELECT a.event_id, EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ms < a.ms AND b.ms >= a.ms - 3600000) AS disabled FROM e a""")
def disabled_window(read):
    return M.disabled(_events(read), "user_id", "ms", F.col("event_type") == "error", 3_600_000).select("event_id", "disabled")


@query(f"""WITH {_T}, p AS (SELECT user_id % 10 AS host, ms AS t, 1 AS d FROM e UNION ALL SELECT user_id % 10, ms + CAST(round(value * 10000) AS BIGINT), -1 FROM e),
s AS (SELECT host, t, sum(sum(d)) OVER (PARTITION BY host ORDER BY t) AS n FROM p GROUP BY host, t) SELECT host, CAST(max(n) AS BIGINT) AS most FROM s GROUP BY 1""")
def max_concurrency(read):
    e = _events(read).select((F.col("user_id") % 10).alias("host"), F.col("ms").alias("start"), (F.col("ms") + F.round(F.col("value") * 10000).cast("long")).alias("stop"))
    return M.max_concurrency(e, "host")


@query(f"WITH {_T} SELECT user_id, CAST(ms // 60000 AS BIGINT) AS minute, count(*) AS requests, count(*) - 1 AS coalesced, min(event_id) AS leader FROM e GROUP BY 1, 2")
def coalesced_requests(read):
    return _events(read).groupBy("user_id", F.floor(F.col("ms") / 60000).alias("minute")).agg(F.count("*").alias("requests"), (F.count("*") - 1).alias("coalesced"), F.min("event_id").alias("leader"))


# a load takes a thousand times an event's value in milliseconds; who comes meanwhile joins it
@query(f"""WITH RECURSIVE {_T}, r AS (SELECT user_id, event_id, ms, CAST(round(value * 1000) AS BIGINT) * 60 AS takes, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM e),
f AS (SELECT user_id, event_id, n, event_id AS leader, ms + takes AS done FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN r.ms <= f.done THEN f.leader ELSE r.event_id END, CASE WHEN r.ms <= f.done THEN f.done ELSE r.ms + r.takes END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, event_id, leader, done, leader <> event_id AS joined FROM f""")
def single_flight(read):
    """Every request with the load that answers it."""
    from tilewright.operators import cache as C

    e = _events(read).select("user_id", F.col("ms").alias("at"), F.col("event_id").alias("seq"), (F.round(F.col("value") * 1000).cast("long") * 60).alias("takes"))
    return C.single_flight(e, "user_id", 600_000).select("user_id", F.col("seq").alias("event_id"), "leader", "done", (F.col("leader") != F.col("seq")).alias("joined"))


_MSG = "CASE event_id % 5 WHEN 0 THEN 'HTTP ' || (400 + event_id % 130) WHEN 1 THEN 'status: ' || (400 + event_id % 130) WHEN 2 THEN 'aborted' WHEN 3 THEN 'response was ' || (400 + event_id % 130) || ' here' ELSE NULL END"


@query(f"WITH m AS (SELECT event_id, {_MSG} AS msg FROM events), s AS (SELECT *, CASE WHEN regexp_extract(msg, '(?i)(?:http|status|response)\\D+(\\d{{3}})', 1) <> '' THEN CAST(regexp_extract(msg, '(?i)(?:http|status|response)\\D+(\\d{{3}})', 1) AS INT) END AS status FROM m) SELECT event_id, status, status IS NULL OR status IN (408, 409, 425, 429) OR status >= 500 AS retry FROM s")
def retry_class(read):
    i = F.col("event_id")
    code = (400 + i % 130).cast("string")
    msg = F.when(i % 5 == 0, F.concat(F.lit("HTTP "), code)).when(i % 5 == 1, F.concat(F.lit("status: "), code)).when(i % 5 == 2, F.lit("aborted")).when(i % 5 == 3, F.concat(F.lit("response was "), code, F.lit(" here")))
    status = M.status_of(msg)
    return read("events").select("event_id", status.alias("status"), M.retryable(status).alias("retry"))


@query("SELECT event_id, CAST(floor(least(1500.0, 120.0 * pow(2.0, event_id % 6)) * (0.75 + 0.5 * (event_id % 11 / 10.0)) + 0.5) AS BIGINT) AS delay FROM events")
def backoff_schedule(read):
    from tilewright.functions.tilemath import backoff_ms

    return read("events").select("event_id", backoff_ms(F.col("event_id") % 6 + 1, 120, 1500, F.col("event_id") % 11 / 10.0).alias("delay"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)password') THEN 'secret' WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' WHEN regexp_matches(text, '!!') THEN 'noise' ELSE 'other' END AS category FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS k FROM c) SELECT category, count(*) AS n, list(doc_id ORDER BY doc_id) FILTER (k <= 6) AS samples FROM r GROUP BY 1""")
def failure_categories(read):
    t = F.col("text")
    return M.categories(read("documents"), F.when(t.rlike("(?i)password"), "secret").when(t.rlike("[0-9]{4}"), "number").when(t.rlike("!!"), "noise").otherwise("other"), "doc_id", 6)


also("etag_consistency", "etag_consistency_all")
