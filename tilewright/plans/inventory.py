"""Queries on inventories: availability, audits, unions with precedence, counts and constraints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.operators import inventory as I
from tilewright.plans.registry import query

_ASSETS = "assets AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'starter' ELSE 'uploaded' END AS state, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE CAST(round(s_acctbal * 100) AS BIGINT) END AS size FROM supplier), plan AS (SELECT c_custkey AS id, c_nationkey FROM customer)"


def _assets(read):
    k = F.col("s_suppkey")
    return read("supplier").select(k.alias("id"), F.when(k % 5 == 0, "starter").otherwise("uploaded").alias("state"), F.when(k % 7 == 0, 0).otherwise(F.round(F.col("s_acctbal") * 100).cast("long")).alias("size"))


def _plan(read):
    return read("customer").select(F.col("c_custkey").alias("id"), "c_nationkey")


@query(f"WITH {_ASSETS} SELECT id, c_nationkey FROM plan WHERE id IN (SELECT id FROM assets WHERE state = 'uploaded' AND coalesce(size, 0) > 0)")
def available_regions(read):
    return I.available(_plan(read), _assets(read), "id")


@query(f"WITH {_ASSETS} SELECT id, c_nationkey FROM plan WHERE id NOT IN (SELECT id FROM assets WHERE state = 'uploaded' AND coalesce(size, 0) > 0)")
def missing_regions(read):
    return I.missing(_plan(read), _assets(read), "id")


@query("""WITH e AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 4 <> 0), a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 5 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN a.v IS DISTINCT FROM e.v THEN 'mismatch' ELSE 'match' END AS verdict, count(*) AS n, min(coalesce(a.k, e.k)) AS first_key FROM e FULL JOIN a ON a.k = e.k GROUP BY 1""")
def inventory_audit(read):
    p = read("part")
    expected = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    actual = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))
    return I.audit(expected, actual, "k", "v").groupBy("verdict").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def set_except(read):
    return I.difference(read("orders").select(F.col("o_custkey").alias("k")), read("supplier").select(F.col("s_suppkey").alias("k")), ["k"])


@query("""SELECT l_returnflag AS layer, l_orderkey, l_linenumber, 'base' AS origin FROM lineitem WHERE l_returnflag NOT IN ('R') UNION ALL
SELECT 'R', o_orderkey, 0, 'surface' FROM orders WHERE o_orderstatus = 'F'""")
def override_union(read):
    base = read("lineitem").select(F.col("l_returnflag").alias("layer"), "l_orderkey", "l_linenumber", F.lit("base").alias("origin"))
    surface = read("orders").where("o_orderstatus = 'F'").select(F.lit("R").alias("layer"), F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("surface").alias("origin"))
    return I.override(base, surface, "layer", ["R"])


@query("""SELECT 'n' || n_nationkey AS id, n_regionkey AS parent FROM nation WHERE n_nationkey % 6 <> 0 UNION ALL SELECT 'n' || n_nationkey || '--c' || c, n_regionkey FROM nation, (SELECT unnest(range(1, 4)) AS c) WHERE n_nationkey % 6 = 0""")
def replace_with_children(read):
    rows = read("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").alias("parent"))
    children = read("nation").where("n_nationkey % 6 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("of"), F.col("n_regionkey").alias("parent")).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return I.replace(rows, children.select("of", F.concat("of", F.lit("--c"), F.col("c").cast("string")).alias("id"), "parent"), "id")


@query("""SELECT class, count(*) AS n FROM (SELECT 'grass' AS class FROM part UNION ALL SELECT 'sand' FROM part WHERE p_type LIKE '%BRASS' UNION ALL SELECT 'scrub' FROM part WHERE p_type LIKE '%STEEL' UNION ALL SELECT 'snow' FROM supplier) GROUP BY 1""")
def classified_union(read):
    p, s = read("part"), read("supplier")
    return I.classified([(p, None, "grass"), (p, F.col("p_type").endswith("BRASS"), "sand"), (p, F.col("p_type").endswith("STEEL"), "scrub"), (s, None, "snow")]).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedupe_keep_first(read):
    return I.keep_first(read("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_from_join(read):
    base = read("documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    return I.update_from(base, read("labels"), ["doc_id"], ["quality", "toxic"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(read):
    return I.duplicates(read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT n_chars % 500 AS k, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def conflict_keys(read):
    return I.conflicts(read("documents").withColumn("k", F.col("n_chars") % 500), "k", F.sha2("text", 256))


@query("SELECT n_regionkey AS continent, count(*) AS n FROM nation GROUP BY 1 ORDER BY 1")
def count_by_group(read):
    return read("nation").groupBy(F.col("n_regionkey").alias("continent")).agg(F.count("*").alias("n")).orderBy("continent")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(read):
    return read("orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"))


@query("SELECT event_type AS layer, count(*) AS n, list_sort(list(DISTINCT user_id % 7)) AS sources FROM events GROUP BY 1 ORDER BY n DESC, layer")
def layer_histogram(read):
    return read("events").groupBy(F.col("event_type").alias("layer")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.col("user_id") % 7)).alias("sources")).orderBy(F.desc("n"), "layer")


@query("SELECT o_orderstatus AS source, list_sort(list(DISTINCT o_orderpriority)) AS targets FROM orders GROUP BY 1")
def set_mapping(read):
    return read("orders").groupBy(F.col("o_orderstatus").alias("source")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("targets"))


@query("""WITH t AS (SELECT user_id, min(event_id % 6) AS min_zoom, max(event_id % 6) AS max_zoom, list(DISTINCT event_type) AS l FROM events GROUP BY 1)
SELECT user_id, min_zoom, max_zoom, list_sort(list_filter(['click', 'error', 'purchase'], lambda x: NOT list_contains(l, x))) AS missing, min_zoom = 0 AND max_zoom >= 5 AND list_has_all(l, ['click', 'error', 'purchase']) AS valid FROM t""")
def required_layers(read):
    tiles = read("events").select("user_id", (F.col("event_id") % 6).alias("z"), F.col("event_type").alias("layer"))
    return I.archive_check(tiles, "user_id", ["click", "error", "purchase"], 5)


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view, bool_and(event_type <> 'signup') AS passed FROM events GROUP BY 1")
def required_layer_counts(read):
    return read("events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "error", "view")), F.bool_and(F.col("event_type") != "signup").alias("passed"))


@query("SELECT event_type AS archive, min(event_id % 11) AS min_zoom, max(event_id % 11) AS max_zoom, count(*) AS tiles, list_sort(list(DISTINCT 'l' || user_id % 5)) AS layers FROM events GROUP BY 1")
def archive_metadata(read):
    t = read("events").select(F.col("event_type").alias("archive"), (F.col("event_id") % 11).alias("z"), F.concat(F.lit("l"), (F.col("user_id") % 5).cast("string")).alias("layer"))
    return t.groupBy("archive").agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count("*").alias("tiles"), F.sort_array(F.collect_set("layer")).alias("layers"))


@query("SELECT l_returnflag AS layer, max(l_quantity) FILTER (l_linenumber = 1) AS z1, max(l_quantity) FILTER (l_linenumber = 2) AS z2, max(l_quantity) FILTER (l_linenumber = 3) AS z3, max(l_quantity) AS most, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def layer_zoom_matrix(read):
    return read("lineitem").groupBy(F.col("l_returnflag").alias("layer")).agg(*(F.max(F.when(F.col("l_linenumber") == z, F.col("l_quantity"))).alias(f"z{z}") for z in (1, 2, 3)), F.max("l_quantity").alias("most"), F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("cents"))


@query("SELECT n_regionkey AS region, count(*) AS actual, 5 AS declared, count(*) = 5 AS agrees FROM nation GROUP BY 1")
def count_reconciliation(read):
    return read("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("actual")).select("region", "actual", F.lit(5).alias("declared"), (F.col("actual") == 5).alias("agrees"))


@query("""SELECT to_json({'version': 2, 'regions': list({'id': id, 'asset': 'engine-' || id || '.tiles'} ORDER BY id)}) AS manifest, CAST(count(*) AS BIGINT) AS available FROM (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 3 <> 0)""")
def manifest_json(read):
    have = read("nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return I.manifest(have.withColumn("asset", F.concat(F.lit("engine-"), "id", F.lit(".tiles"))))


@query("SELECT o_orderkey, o_custkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 + o_custkey) % 2 AS BIGINT) AS side FROM orders")
def alternating_assignment(read):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read("orders").select("o_orderkey", "o_custkey", ((n - 1 + F.col("o_custkey")) % 2).cast("long").alias("side"))
