"""Queries that write files from tables into the shared folder and scan them with the readers of the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import style as S
from tilewright.functions import text as X
from tilewright.operators import inventory as I
from tilewright.operators import planning
from tilewright.plans.registry import query
from tilewright.plans.storage import partitions, shared_path
from tilewright.sources import archives as A


def _folder(files) -> tuple:
    """(session, folder) with the files (name, content) written into it."""
    spark = files.sparkSession
    folder = shared_path(spark)
    A.write_files(files, folder)
    return spark, folder


def _collection(features):
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(features), ","), F.lit("]}"))


@query("SELECT p_brand AS brand, p_size AS size, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY 1, 2")
def collection_scan(read):
    """A FeatureCollection for each brand; features without geometry are left out."""
    feature = F.concat(F.lit('{"type":"Feature","properties":{"size":"'), F.col("p_size").cast("string"), F.lit('"},"geometry":'), F.when(F.col("p_size") % 4 == 0, "null").otherwise('{"type":"Point","coordinates":[1,2]}'), F.lit("}"))
    docs = read("part").groupBy("p_brand").agg(_collection(feature).alias("content")).select(F.concat("p_brand", F.lit(".json")).alias("name"), "content")
    spark, folder = _folder(docs)
    found = A.read_collection(spark, folder)
    brand = F.url_decode(F.regexp_extract("file", r"([^/]+)\.json$", 1))
    return found.groupBy(brand.alias("brand"), F.col("properties")["size"].cast("int").alias("size")).agg(F.count("*").alias("n"))


@query("SELECT CAST(p_partkey % 12 * 100 AS INT) AS depth, count(*) AS n FROM part GROUP BY 1")
def depth_scan(read):
    """Twelve collections whose depth stands in their names."""
    feature = F.lit('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[]}}')
    depth = (F.col("p_partkey") % 12 * 100).cast("string")
    docs = read("part").groupBy(F.concat(F.lit("bathymetry_"), depth, F.lit(".json")).alias("name")).agg(_collection(feature).alias("content"))
    spark, folder = _folder(docs)
    return A.read_depths(spark, folder).groupBy("depth").agg(F.count("*").alias("n"))


@query("""SELECT 'r' || n_nationkey AS id, CASE WHEN n_nationkey > 1 THEN 'r' || n_nationkey // 2 END AS parent, CASE WHEN n_nationkey % 3 > 0 THEN 'http://h/' || n_nationkey END AS pbf_url,
CASE WHEN n_nationkey % 7 > 0 THEN CAST(n_nationkey * 6 - 80 AS DOUBLE) END AS west, CASE WHEN n_nationkey % 7 > 0 THEN CAST(n_nationkey * 6 - 70 AS DOUBLE) END AS east, CASE WHEN n_nationkey % 7 > 0 THEN CAST(n_nationkey - 9 AS DOUBLE) END AS south FROM nation""")
def index_scan(read):
    """A region index as one file: nested coordinates give the boxes."""
    k = F.col("n_nationkey")
    text = lambda c: c.cast("string")
    w, e, s, n = text(k * 6 - 80), text(k * 6 - 70), text(k - 9), text(k + 1)
    pair = lambda a, b: F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))
    ring = F.concat(F.lit("[[["), F.concat_ws(",", pair(w, s), pair(e, s), pair(e, n), pair(w, n)), F.lit("]]]"))
    parent = F.when(k > 1, F.concat(F.lit(',"parent":"r'), text(F.floor(k / 2)), F.lit('"'))).otherwise("")
    url = F.when(k % 3 > 0, F.concat(F.lit(',"urls":{"pbf":"http://h/'), text(k), F.lit('"}'))).otherwise("")
    geometry = F.when(k % 7 > 0, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), ring, F.lit("}"))).otherwise("null")
    feature = F.concat(F.lit('{"type":"Feature","properties":{"id":"r'), text(k), F.lit('"'), parent, url, F.lit('},"geometry":'), geometry, F.lit("}"))
    spark, folder = _folder(read("nation").agg(_collection(feature).alias("content")).select(F.lit("index.json").alias("name"), "content"))
    return planning.read_index(spark, folder).select("id", "parent", "pbf_url", "bounds.west", "bounds.east", "bounds.south")


@query("SELECT 'asset-' || s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'starter' ELSE 'uploaded' END AS state, CAST(s_suppkey * 10 AS BIGINT) AS size FROM supplier")
def asset_pages(read):
    """Assets of all suppliers on pages, of which every other is a bare array."""
    k = F.col("s_suppkey")
    asset = F.concat(F.lit('{"name":"asset-'), k.cast("string"), F.lit('","state":"'), F.when(k % 5 == 0, "starter").otherwise("uploaded"), F.lit('","size":'), (k * 10).cast("string"), F.lit("}"))
    pages = read("supplier").groupBy(F.floor(k / 10).alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(asset), ","), F.lit("]")).alias("list"))
    content = F.when(F.col("page") % 2 == 0, F.concat(F.lit('{"assets":'), "list", F.lit("}"))).otherwise(F.col("list"))
    spark, folder = _folder(pages.select(F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit(".json")).alias("name"), content.alias("content")))
    return A.read_pages(spark, folder)


@query("SELECT lower(n_name) AS name, CAST(strlen(n_name) + 11 AS INT) AS bytes FROM nation WHERE n_nationkey % 4 > 0")
def icon_scan(read):
    """Icons in folders below folders; files of other kinds are no icons."""
    name = F.concat(F.lit("set/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lower("n_name"), F.when(F.col("n_nationkey") % 4 == 0, ".png").otherwise(".svg"))
    spark, folder = _folder(read("nation").select(name.alias("name"), F.concat(F.lit("<svg>"), "n_name", F.lit("</svg>")).alias("content")))
    return A.read_icons(spark, folder).select("name", F.octet_length("content").alias("bytes"))


@query("SELECT p_brand AS style, count(*) AS layers, count(*) FILTER (p_size % 2 = 0) AS filtered, CAST(max(p_size) AS DOUBLE) AS maxzoom FROM part GROUP BY 1")
def style_scan(read):
    """A style for each brand with a layer for each part."""
    size = F.col("p_size").cast("string")
    layer = F.concat(F.lit('{"id":"l'), F.col("p_partkey").cast("string"), F.lit('","type":"fill","source-layer":"water","maxzoom":'), size, F.when(F.col("p_size") % 2 == 0, ',"filter":["==",["get","class"],"x"]').otherwise(""), F.lit("}"))
    styles = read("part").groupBy("p_brand").agg(F.concat(F.lit('{"version":8,"layers":['), F.array_join(F.collect_list(layer), ","), F.lit("]}")).alias("content"))
    spark, folder = _folder(styles.select(F.concat("p_brand", F.lit(".json")).alias("name"), "content"))
    name = F.url_decode(F.regexp_extract("style", r"([^/]+)\.json$", 1))
    return S.read_layers(spark, folder).groupBy(name.alias("style")).agg(F.count("*").alias("layers"), F.count("filter").alias("filtered"), F.max("maxzoom").alias("maxzoom"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS unnamed FROM customer")
def named_query(read):
    """Responses of a query service, a file for each hundred customers; the third field has no name."""
    k = F.col("c_custkey")
    row = F.concat(F.lit('["'), k.cast("string"), F.lit('","'), "c_mktsegment", F.lit('",'), F.when(k % 3 > 0, F.concat(F.lit('"'), "c_name", F.lit('"'))).otherwise("null"), F.lit("]"))
    docs = read("customer").groupBy(F.floor(k / 100).alias("page")).agg(F.array_join(F.collect_list(row), ",").alias("rows"))
    content = F.concat(F.lit('{"fields":[{"name":"key"},{"name":"segment"},{}],"rows":['), "rows", F.lit("]}"))
    spark, folder = _folder(docs.select(F.concat(F.lit("q"), F.col("page").cast("string"), F.lit(".json")).alias("name"), content.alias("content")))
    return A.named_rows(spark, folder).select(F.col("row")["key"].alias("key"), F.col("row")["segment"].alias("segment"), F.col("row")["column_2"].alias("unnamed"))


@query("SELECT 'stage_' || p_size AS stage, count(*) AS n, CAST(sum(p_partkey % 7 * 60 + p_size) AS BIGINT) AS wall, CAST(sum(3600 + p_size) AS BIGINT) AS cpu FROM part WHERE p_partkey % 5 > 0 GROUP BY 1")
def log_scan(read):
    """Build logs of all parts, a file a brand; lines of other kinds are left out."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    wall = F.concat(F.when(k % 7 > 0, F.concat((k % 7).cast("string"), F.lit("m"))).otherwise(""), size, F.lit("s"))
    timed = F.concat(F.lit("0:01:02 INF  stage_"), size, F.lit("  "), wall, F.lit(" cpu:1h"), size, F.lit("s gc:1s avg:2"))
    logs = read("part").groupBy("p_brand").agg(F.array_join(F.collect_list(F.when(k % 5 > 0, timed).otherwise(F.concat(F.lit("0:01:02 INF  note "), size))), "\n").alias("content"))
    spark, folder = _folder(logs.select(F.concat("p_brand", F.lit(".log")).alias("name"), "content"))
    return A.read_build_log(spark, folder).groupBy("stage").agg(F.count("*").alias("n"), F.sum("wall").alias("wall"), F.sum("cpu").alias("cpu"))


@query("SELECT 6 + event_id % 3 AS z, CAST(event_id % 64 AS INT) AS x, count(*) AS tiles, CAST(sum(strlen(event_type)) AS BIGINT) AS bytes FROM events WHERE event_id % 5 > 0 GROUP BY 1, 2")
def tile_table(read):
    """Tiles of all events written by zoom, empty ones left out, and read back."""
    i = F.col("event_id")
    tiles = read("events").select((6 + i % 3).cast("int").alias("z"), (i % 64).cast("int").alias("x"), F.floor(i / 64).cast("int").alias("y"), F.when(i % 5 > 0, F.encode("event_type", "UTF-8")).otherwise(F.lit(b"")).alias("tile"))
    spark = tiles.sparkSession
    path = f"{shared_path(spark)}/tiles"
    A.write_tiles(tiles, path)
    return spark.read.parquet(path).groupBy("z", "x").agg(F.count("*").alias("tiles"), F.sum(F.octet_length("tile").cast("long")).alias("bytes"))


@query("SELECT 6 + event_id % 3 AS z, event_id % 64 AS x, event_id // 64 AS y, event_type AS tile FROM events WHERE event_id = 130")
def tile_lookup(read):
    """One address of the tiles of all events, within a limit of bytes."""
    i = F.col("event_id")
    tiles = read("events").select((6 + i % 3).cast("int").alias("z"), (i % 64).cast("int").alias("x"), F.floor(i / 64).cast("int").alias("y"), F.encode("event_type", "UTF-8").alias("tile"))
    path = f"{shared_path(tiles.sparkSession)}/tiles"
    A.write_tiles(tiles, path)
    return A.read_tile(tiles.sparkSession, path, 7, 2, 2, 100).select("z", "x", "y", F.decode("tile", "UTF-8").alias("tile"))


@query("SELECT CAST(s_suppkey % 5 AS INT) AS z, count(*) AS tiles, CAST(sum(strlen(s_name)) AS BIGINT) AS bytes FROM supplier WHERE s_suppkey % 6 > 0 GROUP BY 1")
def tile_tree_scan(read):
    """A tree of files z/x/y.pbf, one for each supplier; files with other endings are no tiles."""
    k = F.col("s_suppkey")
    name = F.concat_ws("/", (k % 5).cast("string"), k.cast("string"), F.concat((k % 3).cast("string"), F.when(k % 6 > 0, ".pbf").otherwise(".txt")))
    files = read("supplier").select(name.alias("name"), F.col("s_name").alias("content"))
    # a small table of very many names is one task's otherwise
    spark, folder = _folder(files.repartition(partitions(files.sparkSession, files), "name"))
    return A.read_tile_tree(spark, folder).groupBy("z").agg(F.count("*").alias("tiles"), F.sum(F.octet_length("tile").cast("long")).alias("bytes"))


@query("SELECT p_brand AS brand, CAST(p_size % 9 AS INT) AS minzoom, count(*) AS n FROM part GROUP BY 1, 2")
def zoom_hints(read):
    """Features with zoom hints as lines of GeoJSON, read back as text."""
    f = read("part").select(F.struct(F.col("p_brand").alias("brand")).alias("properties"), F.lit('{"type":"Point","coordinates":[1,2]}').alias("geometry"), (F.col("p_size") % 9).cast("int").alias("minzoom"), F.lit(14).alias("maxzoom"))
    path = f"{shared_path(f.sparkSession)}/features"
    A.write_collection(f, path)
    line = F.from_json("value", "struct<type:string,tippecanoe:struct<minzoom:int,maxzoom:int>,properties:struct<brand:string>>")
    return f.sparkSession.read.text(path).select(line.alias("f")).where("f.type = 'Feature' AND f.tippecanoe.maxzoom = 14").groupBy(F.col("f.properties.brand").alias("brand"), F.col("f.tippecanoe.minzoom").alias("minzoom")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def plan_lines(read):
    """A plan as lines of JSON in order of id, read back."""
    plan = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    path = f"{shared_path(plan.sparkSession)}/plan"
    planning.plan_json(plan, path)
    return plan.sparkSession.read.schema("id long, name string").json(path)


@query("""WITH p AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS continent, c_custkey % 4 > 0 AS there FROM customer), c AS (SELECT continent, count(*) AS n FROM p GROUP BY 1)
SELECT '{"version":1,"phase":"publish","plannedRegionCount":' || (SELECT count(*) FROM p) || ',"plannedByContinent":{' || (SELECT string_agg('"' || continent || '":' || n, ',' ORDER BY continent) FROM c) || '},"availableRegionCount":' || (SELECT count(*) FROM p WHERE there)
  || ',"missingRegionCount":' || (SELECT count(*) FROM p WHERE NOT there) || ',"missingRegions":[' || (SELECT string_agg('"' || id || '"', ',' ORDER BY id) FROM p WHERE NOT there) || '],"complete":false}' AS status""")
def build_status(read):
    id_ = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    c = read("customer")
    return I.build_status(c.select(id_.alias("id"), F.col("c_mktsegment").alias("continent")), c.where("c_custkey % 4 > 0").select(id_.alias("id")), "publish")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0)")
def mandatory_rows(read):
    """Orders whose customer must be there and isn't."""
    return I.mandatory(read("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), read("customer").where("c_custkey % 10 > 0"), ["c_custkey"]).select("o_orderkey", F.col("c_custkey").alias("o_custkey"))


@query("""SELECT p_partkey AS part, least(coalesce(CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END, CAST(24 AS DOUBLE)), CAST(13 AS DOUBLE)) AS entered,
CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 4 > 0 THEN CAST(p_size % 5 AS DOUBLE) END ELSE CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END END AS minzoom,
CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 6 = 0 THEN CAST(20 AS DOUBLE) END ELSE CAST(22 AS DOUBLE) END AS maxzoom FROM part""")
def zoom_windows(read):
    """Windows tightened to a zoom, and restored, or deleted, as half of the layers' originals have them."""
    p, size = read("part"), F.col("p_size")
    own = F.when(size % 3 > 0, size.cast("double"))
    layers = p.select(F.col("p_partkey").alias("id"), own.alias("minzoom"), F.lit(22.0).alias("maxzoom"), S.enter_by(own, 13).alias("entered"))
    originals = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(size % 4 > 0, (size % 5).cast("double")).alias("minzoom"), F.when(size % 6 == 0, 20.0).alias("maxzoom"))
    return S.restored_ranges(layers, originals).select(F.col("id").alias("part"), "entered", "minzoom", "maxzoom")


@query("""SELECT p_partkey AS part, CASE p_size % 3 WHEN 0 THEN '["==", ["get", "kind"], "' || p_size || '"]' WHEN 1 THEN '{"a": ["all", ["get", "kind"], ["get", "class", 1]]}' ELSE '["get", "subclass"]' END AS tree FROM part""")
def class_rewrite(read):
    """The class read under another name, at any depth."""
    size = F.col("p_size")
    tree = F.when(size % 3 == 0, F.concat(F.lit('["==", ["get", "class"], "'), size.cast("string"), F.lit('"]'))).when(size % 3 == 1, '{"a": ["all", ["get", "class"], ["get", "class", 1]]}').otherwise('["get", "subclass"]')
    return read("part").select(F.col("p_partkey").alias("part"), S.with_class(tree, ["get", "kind"]).alias("tree"))


@query(r"""WITH p AS (SELECT page_id, url, list_element(['br, gzip', 'GZIP;q=1', 'x-gzip', 'gzip', 'deflate,  gzip , br', ''], CAST(strlen(url) % 6 + 1 AS BIGINT)) AS accept, list_element(['png', 'JSON', 'css', 'pbf', 'x'], CAST(page_id % 5 + 1 AS BIGINT)) AS ending FROM pages)
SELECT page_id, regexp_matches(accept, '(?i)(?:^|,)\s*gzip\s*(?:,|$)') AS gzip, list_element(['image/png', 'application/json; charset=utf-8', 'text/css; charset=utf-8', 'application/x-protobuf', 'application/octet-stream'], CAST(page_id % 5 + 1 AS BIGINT)) AS type,
  substr(regexp_replace('a' || chr(10) || url || chr(9), '[
	]', ' ', 'g'), 1, 200) AS label FROM p""")
def header_rows(read):
    """Accepted encodings, content types and safe labels of every page's own values."""
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    accept = pick(F.octet_length("url") % 6, "br, gzip", "GZIP;q=1", "x-gzip", "gzip", "deflate,  gzip , br", "")
    ending = pick(F.col("page_id") % 5, "png", "JSON", "css", "pbf", "x")
    label = X.safe_label(F.concat(F.lit("a\n"), "url", F.lit("\t")))
    return read("pages").select("page_id", X.accepts_gzip(accept).alias("gzip"), X.content_type(F.concat("url", F.lit("."), ending)).alias("type"), label.alias("label"))
