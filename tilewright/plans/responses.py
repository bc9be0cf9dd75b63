"""Responses to requests for tiles and ranges, and sources whose order or nesting is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import text as X
from tilewright.operators import planning
from tilewright.operators.ordering import placed
from tilewright.operators.responses import decoded, range_responses, tile_responses
from tilewright.plans.files import _folder
from tilewright.plans.registry import query
from tilewright.sources import archives as A


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), r AS (SELECT page_id, k, CASE WHEN k = 3 AND page_id % 5 = 0 THEN '' ELSE html END AS html FROM p, range(4) t(k))
SELECT page_id, CAST(k AS INT) AS k, CASE WHEN k = 2 THEN 304 ELSE 200 END AS status, '"' || substr(rtrim(translate(base64(unhex(sha256(html))), '+/', '-_'), '='), 1, 24) || '"' AS etag,
  CASE WHEN k IN (1, 3) THEN 'gzip' END AS encoding, CASE WHEN k = 0 THEN CAST(strlen(html) AS INT) END AS plain_length, CASE WHEN k < 2 OR k = 3 AND page_id % 5 = 0 THEN sha256(html) END AS plain_sha256 FROM r""")
def tile_responses_all(read):
    """Four requests for each page: plain, under gzip, with the digest that they have, and for the head alone or for a
    page that isn't there."""
    pages = read("pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("tile"))
    k, gone = F.col("k"), (F.col("k") == 3) & (F.col("page_id") % 5 == 0)
    asked = pages.select("page_id", X.etag(F.col("tile")).alias("own"), F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    requests = asked.select(
        "page_id", "k", F.when(gone, -1 - F.col("page_id")).otherwise(F.col("page_id")).alias("id"), F.when((k == 3) & ~gone, "HEAD").otherwise("GET").alias("method"),
        F.when(k == 0, "gzipped").when(k == 1, "br,GZIP , deflate").when(k == 3, "gzip").alias("accept_encoding"), F.when(k == 2, F.col("own")).when(k == 3, '"other"').alias("if_none_match"),
    )
    found = decoded(tile_responses(requests, pages.withColumnRenamed("page_id", "id"), ["id"]))
    return found.select("page_id", "k", "status", "etag", "encoding", F.when(k == 0, F.col("content_length")).alias("plain_length"), F.sha2("plain", 256).alias("plain_sha256"))


@query("""WITH p AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS h, page_id % 7 AS k, page_id % 50 AS a, page_id % 900 + 10 AS b FROM pages), s AS (SELECT *, strlen(h) // 2 AS size FROM p),
r AS (SELECT *, CASE WHEN k IN (1, 2) THEN a WHEN k = 3 THEN greatest(size - b, 0) END AS start, CASE WHEN k = 1 THEN least(a + b, size - 1) WHEN k IN (2, 3) THEN size - 1 END AS stop FROM s),
q AS (SELECT *, CASE WHEN k = 0 THEN 200 WHEN k < 4 AND start < size THEN 206 ELSE 416 END AS status FROM r)
SELECT page_id, status, CASE status WHEN 206 THEN 'bytes ' || start || '-' || stop || '/' || size WHEN 416 THEN 'bytes */' || size END AS content_range,
  CASE status WHEN 200 THEN size WHEN 206 THEN stop - start + 1 ELSE 31 END AS content_length,
  CASE status WHEN 200 THEN sha256(unhex(h)) WHEN 206 THEN sha256(unhex(substr(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (stop - start + 1) AS BIGINT)))) ELSE sha256('Requested range not satisfiable') END AS body_sha256 FROM q""")
def range_responses_all(read):
    """Prefixes, suffixes and open ranges of every page, and headers that can't be met."""
    text = lambda c: c.cast("string")
    k, a, b = F.col("page_id") % 7, F.col("page_id") % 50, F.col("page_id") % 900 + 10
    header = F.when(k == 1, F.concat(F.lit(" bytes="), text(a), F.lit("-"), text(a + b), F.lit(" "))).when(k == 2, F.concat(F.lit("bytes="), text(a), F.lit("-"))).when(k == 3, F.concat(F.lit("bytes=-"), text(b)))
    header = header.when(k == 4, "bytes=1-2,4-5").when(k == 5, "bytes=99999999999999999999-5").when(k == 6, "bytes=0-99999999999999999999")
    rows = read("pages").select("page_id", F.encode("html", "UTF-8").alias("content"), header.alias("range"))
    return range_responses(rows).select("page_id", "status", "content_range", "content_length", F.sha2("body", 256).alias("body_sha256"))


@query("SELECT l_partkey % 64 AS x, l_suppkey % 8 AS y, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey % 64, l_suppkey % 8 ORDER BY l_orderkey, l_linenumber) - 1 AS place FROM lineitem")
def input_order(read):
    """Features of every tile in the order of the input."""
    rows = read("lineitem").select((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 8).alias("y"), "l_orderkey", "l_linenumber")
    return placed(rows, ["x", "y"], ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, CAST(j AS INT) AS at, CAST(event_id % 350 - 180 + j AS DOUBLE) AS lon, event_id % 160 - 80.5 + j AS lat FROM events, range(4) t(j) WHERE j < CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END")
def coordinate_walk(read):
    """Positions of two, three and four numbers in points, lines, polygons and groups of polygons, whatever their depth."""
    i = F.col("event_id")

    def ring(n, more=""):
        position = [F.concat(F.lit("["), (i % 350 - 180 + j).cast("string"), F.lit(", "), (i % 160 - 80.5 + j).cast("double").cast("string"), F.lit(f"{more}]")) for j in range(n)]
        return F.concat_ws(" , ", *position)

    wrapped = lambda c, depth: F.concat(F.lit("[" * depth), c, F.lit("]" * depth))
    tree = F.when(i % 4 == 0, ring(1)).when(i % 4 == 1, wrapped(ring(2, ", 7"), 1)).when(i % 4 == 2, wrapped(ring(4), 2)).otherwise(wrapped(ring(4, ",7,-1e3"), 3))
    return read("events").select("event_id", F.posexplode(planning.coordinates(tree)).alias("at", "p")).select("event_id", "at", "p.lon", "p.lat")


@query("""WITH m AS (SELECT c_custkey // 50 AS file, '{"version":' || c_custkey // 50 || ',"regions":[' || string_agg('{"id":"c' || c_custkey || '","asset":"a' || c_custkey || '.pmtiles","bounds":[' || c_nationkey || ',0,' || c_nationkey + 1 || ',1]}', ',' ORDER BY c_custkey) || ']}' AS content FROM customer GROUP BY 1)
SELECT substr(sha256(content), 1, 32) AS version_hash, CAST(c_custkey // 50 AS INT) AS version, 'c' || c_custkey AS id, 'a' || c_custkey || '.pmtiles' AS asset, CAST(c_nationkey AS DOUBLE) AS west FROM customer JOIN m ON m.file = c_custkey // 50""")
def manifest_scan(read):
    """Manifests of fifty regions each, written and read back under a bound of bytes, with the digests of their texts."""
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    region = F.concat(F.lit('{"id":"c'), text("c_custkey"), F.lit('","asset":"a'), text("c_custkey"), F.lit('.pmtiles","bounds":['), text("c_nationkey"), F.lit(",0,"), text(F.col("c_nationkey") + 1), F.lit(",1]}"))
    files = read("customer").groupBy(F.expr("c_custkey div 50").alias("file")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", region.alias("r")))).alias("rs"))
    content = F.concat(F.lit('{"version":'), text("file"), F.lit(',"regions":['), F.array_join(F.col("rs.r"), ","), F.lit("]}"))
    spark, folder = _folder(files.select(F.concat(F.lit("m"), text("file"), F.lit(".json")).alias("name"), content.alias("content")))
    return A.read_manifest(spark, folder).select("version_hash", "version", F.explode("regions").alias("r")).select("version_hash", "version", "r.id", "r.asset", F.col("r.bounds")[0].alias("west"))
