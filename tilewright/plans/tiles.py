"""Queries on tile addresses, regions and planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import tilemath as T
from tilewright.operators import planning, polygons, routing
from tilewright.plans.registry import POINTS, REGIONS, SEGMENTS, also, points, query, regions, sql_lat, sql_x, sql_y


def _tiles(read, zoom: int = 10):
    z = F.lit(zoom)
    return points(read).select("event_id", "user_id", z.alias("z"), T.tile_x(F.col("lon"), z).alias("x"), T.tile_y(F.col("lat"), z).alias("y"))


_TILES = lambda z: f"tiles AS (SELECT event_id, user_id, {z} AS z, {sql_x('lon', z)} AS x, {sql_y('lat', z)} AS y FROM points)"


def _boxes(z: str, x: str, y: str) -> str:
    return f"{x} / pow(2.0, {z}) * 360.0 - 180.0 AS west, {sql_lat(y + ' + 1', z)} AS south, ({x} + 1) / pow(2.0, {z}) * 360.0 - 180.0 AS east, {sql_lat(y, z)} AS north"


_HIT = "b.west < s.east - 1e-10 AND b.east > s.west + 1e-10 AND b.south < s.north - 1e-10 AND b.north > s.south + 1e-10"


@query(f"WITH {POINTS}, {_TILES(10)} SELECT event_id, CAST(z AS INT) AS z, x, y FROM tiles")
def lonlat_to_tile(read):
    return _tiles(read).select("event_id", "z", "x", "y")


@query(f"WITH {POINTS} SELECT event_id, CAST(greatest(0, least(floor((lon + 180.0) / 360.0 * 2048), 2047)) AS BIGINT) AS x, {sql_y('least(greatest(lat, -85.05112878), 85.05112878)', 11)} AS y FROM points")
def sample_tile(read):
    x, y = T.sample_tile(F.col("lon"), F.col("lat"), F.lit(11))
    return points(read).select("event_id", x.alias("x"), y.alias("y"))


@query("SELECT event_id, CAST(event_id % 19 - 1 AS INT) AS z, event_id % 70 - 2 AS x, event_id % 65 AS y, event_id % 19 - 1 BETWEEN 0 AND 16 AND event_id % 70 - 2 >= 0 AND event_id % 70 - 2 < pow(2, event_id % 19 - 1) AND event_id % 65 < pow(2, event_id % 19 - 1) AS valid FROM events")
def tile_valid(read):
    i = F.col("event_id")
    t = read("events").select("event_id", (i % 19 - 1).cast("int").alias("z"), (i % 70 - 2).alias("x"), (i % 65).alias("y"))
    return t.withColumn("valid", T.tile_valid(F.col("z"), F.col("x"), F.col("y"), 16))


@query(f"WITH {POINTS}, {_TILES(10)}, b AS (SELECT DISTINCT z, x, y, {_boxes('z', 'x', 'y')} FROM tiles) SELECT CAST(z AS INT) AS z, x, y, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM b")
def tile_bounds(read):
    t = _tiles(read).select("z", "x", "y").distinct()
    return t.select("z", "x", "y", *(F.round(v, 6).alias(k) for k, v in T.tile_bounds(F.col("z"), F.col("x"), F.col("y")).items()))


@query(f"WITH {POINTS}, {_TILES(10)} SELECT DISTINCT CAST(z AS INT) AS z, x, y, 1023 - y AS tms_y FROM tiles")
def tms_flip(read):
    return _tiles(read).select("z", "x", "y").distinct().withColumn("tms_y", T.tms_row(F.col("z"), F.col("y")))


@query(f"WITH {REGIONS}, {SEGMENTS} SELECT * FROM segments")
def region_segments(read):
    return routing.region_segments(regions(read)).select("asset", *(F.col(f"seg_{c}").alias(c) for c in ("west", "south", "east", "north")))


@query(f"WITH {POINTS} SELECT event_id, lon BETWEEN -180 AND 180 AND lon * 1.2 BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND lat * 1.1 BETWEEN -90 AND 90 AND lat < lat * 1.1 AS valid FROM points")
def bounds_valid(read):
    p = points(read)
    return p.select("event_id", T.bounds_valid(F.col("lon"), F.col("lat"), F.col("lon") * 1.2, F.col("lat") * 1.1).alias("valid"))


_X6 = "CASE WHEN east = 180 THEN 63 ELSE " + sql_x("greatest(west, east - 1e-10)", 6) + " END"
_CELLS = f"""cells AS (SELECT DISTINCT asset, cell_x, cell_y FROM (SELECT asset, unnest(generate_series({sql_x('west', 6)}, {_X6})) AS cell_x, {sql_y('north', 6)} AS y0, {sql_y('south', 6)} AS y1 FROM segments), LATERAL (SELECT unnest(generate_series(y0, y1)) AS cell_y))"""


@query(f"WITH {REGIONS}, {SEGMENTS}, {_CELLS} SELECT asset, CAST(cell_x AS BIGINT) AS cell_x, CAST(cell_y AS BIGINT) AS cell_y FROM cells")
def region_cells(read):
    return routing.region_cells(regions(read)).select("asset", "cell_x", "cell_y").distinct()


@query(f"WITH {REGIONS}, {SEGMENTS}, {_CELLS} SELECT cell_x, cell_y, count(DISTINCT asset) AS regions, count(DISTINCT asset) > 3 AS over FROM cells GROUP BY ALL")
def cell_fanout(read):
    return routing.cell_fanout(routing.region_cells(regions(read)), 3)


@query(f"WITH {REGIONS}, {SEGMENTS}, {POINTS}, {_TILES(10)}, b AS (SELECT z, x, y, count(*) AS events, {_boxes('z', 'x', 'y')} FROM tiles GROUP BY z, x, y), r AS (SELECT DISTINCT b.z, b.x, b.y, events, asset FROM b JOIN segments s ON {_HIT}) SELECT asset, count(*) AS tiles, CAST(sum(events) AS BIGINT) AS events FROM r GROUP BY asset")
def tile_region_join(read):
    tiles = _tiles(read)
    counted = tiles.groupBy("z", "x", "y").agg(F.count("*").alias("events"))
    routed = routing.route(counted, regions(read), keep=["events"])
    return routed.groupBy("asset").agg(F.count("*").alias("tiles"), F.sum("events").alias("events"))


@query(f"WITH {REGIONS}, {SEGMENTS}, {POINTS}, {_TILES(4)}, b AS (SELECT DISTINCT z, x, y, {_boxes('z', 'x', 'y')} FROM tiles) SELECT DISTINCT CAST(b.z AS INT) AS z, b.x, b.y, asset FROM b JOIN segments s ON {_HIT}")
def tile_region_nlj(read):
    return routing.route_overview(_tiles(read, 4), regions(read))


@query(f"WITH {POINTS}, {_TILES(8)}, up AS (SELECT DISTINCT x, y, unnest(range(0, 9)) AS z FROM tiles) SELECT CAST(z AS INT) AS z, x >> CAST(8 - z AS INT) AS x, y >> CAST(8 - z AS INT) AS y, count(*) AS tiles FROM up GROUP BY 1, 2, 3")
def tile_pyramid(read):
    """All tiles above those of zoom 8 that points have, with how many of them each covers."""
    base = _tiles(read, 8).select("x", "y").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(8))))
    up = lambda c: F.expr(f"shiftright({c}, 8 - z)")
    return base.groupBy("z", up("x").alias("x"), up("y").alias("y")).agg(F.count("*").alias("tiles"))


@query(f"WITH {POINTS}, t AS (SELECT DISTINCT z, {sql_x('lon', 'z')} AS x, {sql_y('lat', 'z')} AS y FROM points, (SELECT unnest(range(0, 11)) AS z)) SELECT CAST(z AS INT) AS z, x, y FROM t")
def distinct_tiles_all(read):
    p = points(read).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return p.select("z", T.tile_x(F.col("lon"), F.col("z")).alias("x"), T.tile_y(F.col("lat"), F.col("z")).alias("y")).distinct()


def _plan(read):
    return regions(read).select(F.col("asset").alias("id"), "west", "south", "east", "north", (F.substring("asset", 2, 9).cast("long") * 97 + 300).alias("size"))


_DIMS = f"""{REGIONS}, plan AS (SELECT asset AS id, west, south, east, north, CAST(substr(asset, 2) AS BIGINT) * 97 + 300 AS size FROM regions),
spans AS (SELECT *, CASE WHEN east < west THEN east + 360 ELSE east END AS "right", least(24, greatest(4, CAST(ceil(size / 300.0) AS BIGINT))) AS cells FROM plan),
cols AS (SELECT *, CAST(greatest(1, ceil(sqrt(cells * (greatest("right" - west, 0.001) * greatest(0.2, cos(radians((north + south) / 2))) / greatest(north - south, 0.001))))) AS BIGINT) AS grid_columns FROM spans),
dims AS (SELECT *, CAST(greatest(1, ceil(cells / grid_columns)) AS BIGINT) AS grid_rows FROM cols)"""


@query(f"WITH {_DIMS} SELECT id, cells, grid_columns, grid_rows FROM dims")
def grid_dimensions(read):
    return planning.grid_dimensions(_plan(read), 300).select("id", "cells", "grid_columns", "grid_rows")


@query(f"""WITH {_DIMS}, g AS (SELECT *, unnest(range(1, grid_columns + 1)) AS c FROM dims), h AS (SELECT *, unnest(range(1, grid_rows + 1)) AS r FROM g),
b AS (SELECT id, id || '--r' || r || '-c' || c AS name, CASE WHEN c - 1 = grid_columns THEN "right" ELSE west + ("right" - west) * (c - 1) / grid_columns END AS w, CASE WHEN c = grid_columns THEN "right" ELSE west + ("right" - west) * c / grid_columns END AS e,
  south + (north - south) * (r - 1) / grid_rows AS s, CASE WHEN r = grid_rows THEN north ELSE south + (north - south) * r / grid_rows END AS n FROM h)
SELECT name AS id, id AS parent_id, round(CASE WHEN w >= 180 THEN w - 360 ELSE w END, 6) AS west, round(s, 6) AS south, round(CASE WHEN e > 180 THEN e - 360 ELSE e END, 6) AS east, round(n, 6) AS north FROM b WHERE NOT (w < 180 AND e > 180)
UNION ALL SELECT name || '-s1', id, round(w, 6), round(s, 6), 180.0, round(n, 6) FROM b WHERE w < 180 AND e > 180
UNION ALL SELECT name || '-s2', id, -180.0, round(s, 6), round(e - 360, 6), round(n, 6) FROM b WHERE w < 180 AND e > 180""")
def grid_split(read):
    return planning.grid_split(planning.grid_dimensions(_plan(read), 300))


@query("SELECT c_custkey, c_nationkey, CAST((row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1) % 7 AS BIGINT) AS bucket FROM customer")
def bucket_assign(read):
    return planning.buckets(read("customer").select("c_custkey", "c_nationkey"), ["c_nationkey", "c_custkey"], 7)


def _tree(read):
    k = F.col("p_partkey")
    return read("part").select(k.alias("id"), F.when(F.floor(k / 2) > 0, F.floor(k / 2)).alias("parent"), (F.col("p_size") % 7 == 0).alias("has_url"))


_TREE = "tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey // 2 > 0 THEN p_partkey // 2 END AS parent, p_size % 7 = 0 AS has_url FROM part)"


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT id, parent AS a FROM tree WHERE has_url AND parent IS NOT NULL UNION SELECT u.id, t.parent FROM up u JOIN tree t ON t.id = u.a WHERE t.parent IS NOT NULL) SELECT id FROM tree WHERE has_url AND id NOT IN (SELECT a FROM up)")
def hierarchy_leaves(read):
    return planning.leaves(_tree(read), F.col("has_url"))


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT id, id AS root, 0 AS depth FROM tree UNION ALL SELECT w.id, t.parent, depth + 1 FROM w JOIN tree t ON t.id = w.root WHERE t.parent IN (SELECT id FROM tree)) SELECT id, arg_max(root, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM w GROUP BY id")
def hierarchy_root(read):
    return planning.ancestors_root(_tree(read))


_CUST = "p AS (SELECT c_nationkey AS k, ((c_custkey * 7919) % 40000) / 1000.0 + c_nationkey * 14.0 - 180.0 AS lon, ((c_custkey * 104729) % 170000) / 1000.0 - 85.0 AS lat FROM customer)"


@query(f"""WITH {_CUST}, m AS (SELECT DISTINCT k, lon - 360.0 * floor(lon / 360.0) AS m FROM p),
g AS (SELECT k, m, coalesce(lead(m) OVER (PARTITION BY k ORDER BY m), min(m) OVER (PARTITION BY k) + 360.0) AS nx FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY nx - m DESC, m) AS r FROM g),
l AS (SELECT k, min(lat) AS south, max(lat) AS north FROM p GROUP BY k)
SELECT b.k, CASE WHEN 360 - (nx - m) > 300 THEN -180.0 ELSE round(CASE WHEN (nx - 360.0 * floor(nx / 360.0)) > 180 THEN (nx - 360.0 * floor(nx / 360.0)) - 360.0 ELSE (nx - 360.0 * floor(nx / 360.0)) END, 6) END AS west, south,
  CASE WHEN 360 - (nx - m) > 300 THEN 180.0 ELSE round(CASE WHEN m > 180 THEN m - 360.0 ELSE m END, 6) END AS east, north FROM b JOIN l USING (k) WHERE r = 1""")
def circular_bounds(read):
    k = F.col("c_custkey")
    p = read("customer").select(F.col("c_nationkey").alias("k"), ((k * 7919) % 40000 / 1000.0 + F.col("c_nationkey") * 14.0 - 180.0).alias("lon"), ((k * 104729) % 170000 / 1000.0 - 85.0).alias("lat"))
    return planning.covering_bounds(p, "k")


@query(f"WITH {POINTS}, {_TILES(10)} SELECT DISTINCT x, y, x // 16 AS parent_x, y // 16 AS parent_y FROM tiles WHERE (x // 16, y // 16) IN (SELECT ({sql_x('lon', 6)}, {sql_y('lat', 6)}) FROM points WHERE event_id % 3 = 0)")
def overscale_parent(read):
    child = _tiles(read).select("x", "y").distinct().withColumns({"parent_x": F.shiftright("x", 4), "parent_y": F.shiftright("y", 4)})
    there = points(read).where("event_id % 3 = 0").select(T.tile_x(F.col("lon"), F.lit(6)).alias("parent_x"), T.tile_y(F.col("lat"), F.lit(6)).alias("parent_y")).distinct()
    return child.join(there, ["parent_x", "parent_y"], "left_semi")


def _have(read):
    """Tiles that exist, at mixed zooms."""
    z = (F.col("event_id") % 5 * 2 + 2).cast("int")
    return points(read).where("event_id % 10 < 3").select(z.alias("z"), T.tile_x(F.col("lon"), z).alias("x"), T.tile_y(F.col("lat"), z).alias("y")).distinct()


def _want(read):
    z = (F.col("event_id") % 4 + 3).cast("int")
    return points(read).where("event_id % 10 >= 3").select(z.alias("z"), T.tile_x(F.col("lon"), z).alias("x"), T.tile_y(F.col("lat"), z).alias("y")).distinct()


_HAVE = f"""{POINTS}, have AS (SELECT DISTINCT CAST(event_id % 5 * 2 + 2 AS INT) AS z, {sql_x('lon', '(event_id % 5 * 2 + 2)')} AS x, {sql_y('lat', '(event_id % 5 * 2 + 2)')} AS y FROM points WHERE event_id % 10 < 3),
want AS (SELECT DISTINCT CAST(event_id % 4 + 3 AS INT) AS z, {sql_x('lon', '(event_id % 4 + 3)')} AS x, {sql_y('lat', '(event_id % 4 + 3)')} AS y FROM points WHERE event_id % 10 >= 3)"""


def nearest_up(want, have):
    """(z, x, y, parent_zoom): the deepest existing ancestor. Each tile has z ancestors, so the explosion is bounded."""
    up = want.withColumn("pz", F.explode(F.expr("sequence(0, z - 1)"))).withColumns({"px": F.expr("shiftright(x, z - pz)"), "py": F.expr("shiftright(y, z - pz)")})
    h = have.select(F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py"))
    return up.join(h, ["pz", "px", "py"]).groupBy("z", "x", "y").agg(F.max("pz").alias("parent_zoom"))


@query(f"WITH {_HAVE} SELECT w.z, w.x, w.y, max(h.z) AS parent_zoom FROM want w JOIN have h ON h.z < w.z AND h.x = w.x // CAST(pow(2, w.z - h.z) AS BIGINT) AND h.y = w.y // CAST(pow(2, w.z - h.z) AS BIGINT) GROUP BY ALL")
def nearest_ancestor(read):
    return nearest_up(_want(read), _have(read))


_DEEP = _HAVE.replace("event_id % 5 * 2 + 2", "event_id % 3 + 8").replace("event_id % 10 < 3", "event_id % 10 = 0")


@query(f"""WITH {_DEEP}, orphan AS (SELECT * FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.z < w.z AND h.x = w.x // CAST(pow(2, w.z - h.z) AS BIGINT) AND h.y = w.y // CAST(pow(2, w.z - h.z) AS BIGINT))),
d AS (SELECT o.z, o.x, o.y, h.z AS child_z, h.x AS child_x, h.y AS child_y, min(h.z) OVER (PARTITION BY o.z, o.x, o.y) AS least FROM orphan o JOIN have h ON h.z > o.z AND o.x = h.x // CAST(pow(2, h.z - o.z) AS BIGINT) AND o.y = h.y // CAST(pow(2, h.z - o.z) AS BIGINT))
SELECT z, x, y, child_z, child_x, child_y FROM d WHERE child_z = least""")
def nearest_descendants(read):
    z = (F.col("event_id") % 3 + 8).cast("int")
    have = points(read).where("event_id % 10 = 0").select(z.alias("z"), T.tile_x(F.col("lon"), z).alias("x"), T.tile_y(F.col("lat"), z).alias("y")).distinct()
    want = _want(read)
    orphans = want.join(nearest_up(want, have), ["z", "x", "y"], "left_anti")
    up = have.select(F.col("z").alias("child_z"), F.col("x").alias("child_x"), F.col("y").alias("child_y")).withColumn("z", F.explode(F.expr("sequence(0, child_z - 1)")))
    up = up.withColumns({"x": F.expr("shiftright(child_x, child_z - z)"), "y": F.expr("shiftright(child_y, child_z - z)")})
    found = up.join(orphans, ["z", "x", "y"])
    return found.withColumn("least", F.min("child_z").over(Window.partitionBy("z", "x", "y"))).where("child_z = least").select("z", "x", "y", "child_z", "child_x", "child_y")


@query(f"WITH {REGIONS}, {SEGMENTS}, {POINTS} SELECT asset, count(*) AS hits FROM points p JOIN segments s ON lon >= west AND lon <= east AND lat >= south AND lat <= north GROUP BY asset")
def point_in_rect(read):
    z = F.lit(routing.ROUTING_ZOOM)
    p = points(read).withColumns({"cell_x": T.tile_x(F.col("lon"), z), "cell_y": T.tile_y(F.col("lat"), z)})
    inside = F.col("lon").between(F.col("seg_west"), F.col("seg_east")) & F.col("lat").between(F.col("seg_south"), F.col("seg_north"))
    cells = routing.region_cells(regions(read), wide=True)
    return p.join(cells, ["cell_x", "cell_y"]).where(inside).groupBy("asset").agg(F.count("*").alias("hits"))


@query("SELECT event_id, CASE WHEN value / 100 <= 2.85 THEN 1.0 WHEN value / 100 <= 4.25 THEN 1.0 + -1.0 * (value / 100 - 2.85) / 1.4 ELSE 0.0 END AS fade, 512.0 * pow(2.0, event_id % 8) / (2 * pi()) AS radius, CASE WHEN value IS NULL OR value / 100 <= 0 THEN 2.0 ELSE least(greatest(value / 100, 2.0), 3.0) END AS ratio FROM events")
def piecewise_fade(read):
    v = F.col("value") / 100
    return read("events").select("event_id", T.piecewise(v, [(2.85, 1.0), (4.25, 0.0)]).alias("fade"), T.globe_radius((F.col("event_id") % 8).cast("double")).alias("radius"), T.pixel_ratio(v).alias("ratio"))


# regions of a binary hierarchy: two of three have an extract, every tenth has no bounds
@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k, p_partkey % 3 <> 0 AS url, p_partkey % 10 <> 0 AS box FROM part),
up AS (SELECT k, k AS a, 0 AS d FROM n UNION ALL SELECT up.k, a // 2, d + 1 FROM up WHERE a > 1),
root AS (SELECT k, arg_min(a, d) AS root FROM up WHERE a BETWEEN 4 AND 7 GROUP BY k), above AS (SELECT DISTINCT a AS k FROM up JOIN n USING (k) WHERE d > 0 AND url)
SELECT 'r/' || k AS id, 'r--' || k AS slug, 'r/' || coalesce(root, k) AS continent, CAST(k % 300 - 170 AS DOUBLE) AS west, 'tiles-r--' || k || '.pmtiles' AS asset_name, 'tiles-r--' || k || '.json' AS metadata_name
FROM n LEFT JOIN root USING (k) WHERE url AND box AND k NOT IN (SELECT k FROM above)""")
def region_plan(read):
    k = "p_partkey"
    index = read("part").selectExpr(f"'r/' || {k} AS id", f"CASE WHEN {k} > 1 THEN 'r/' || {k} DIV 2 END AS parent", "CAST(NULL AS STRING) AS name", f"CASE WHEN {k} % 3 <> 0 THEN 'http://h/' || {k} END AS pbf_url",
                                    f"CASE WHEN {k} % 10 <> 0 THEN struct(CAST({k} % 300 - 170 AS DOUBLE) AS west, -1.0D AS south, 180.0D AS east, 1.0D AS north) END AS bounds")
    return planning.base_plan(index, ["r/4", "r/5", "r/6", "r/7"], "tiles").select("id", "slug", "continent", "west", "asset_name", "metadata_name")


@query(f"""WITH {REGIONS}, t AS (SELECT *, CAST(substr(asset, 2) AS INT) % 4 = 0 AS split, CASE WHEN west > east THEN east + 360 ELSE east END AS rgt FROM regions),
c AS (SELECT t.*, r.r, k.c, west + (rgt - west) / 4 * (k.c - 1) AS w, CASE WHEN k.c = 4 THEN rgt ELSE west + (rgt - west) / 4 * k.c END AS e, south + (north - south) / 2 * (r.r - 1) AS s, CASE WHEN r.r = 2 THEN north ELSE south + (north - south) / 2 * r.r END AS n
  FROM t, (SELECT unnest([1, 2]) AS r) r, (SELECT unnest([1, 2, 3, 4]) AS c) k WHERE split),
p AS (SELECT *, '' AS half, CASE WHEN w >= 180 THEN w - 360 ELSE w END AS pw, CASE WHEN w >= 180 THEN e - 360 ELSE e END AS pe FROM c WHERE NOT (w < 180 AND e > 180)
  UNION ALL SELECT *, '-s1', w, 180 FROM c WHERE w < 180 AND e > 180 UNION ALL SELECT *, '-s2', -180, e - 360 FROM c WHERE w < 180 AND e > 180)
SELECT asset AS id, asset AS name, west, south, east, north, CAST(NULL AS VARCHAR) AS parent FROM t WHERE NOT split
UNION ALL SELECT asset || '--s2-r' || r || '-c' || c || half, asset || ' split ' || r || '.' || c || half, round(pw, 6), round(s, 6), round(pe, 6), round(n, 6), asset FROM p""")
def pinned_split(read):
    plan = regions(read).select(F.col("asset").alias("id"), F.col("asset").alias("slug"), F.col("asset").alias("name"), "west", "south", "east", "north")
    splits = plan.where("CAST(substr(id, 2) AS INT) % 4 = 0").select("id", F.lit(2).alias("rows"), F.lit(4).alias("columns"), F.lit("s2").alias("generation"), F.lit(True).alias("antimeridian"))
    return planning.pinned_split(plan, splits).drop("slug")


# a star of eight corners and a hole in its middle for each part, some across the antimeridian
_STAR = ((3, 0), (1, 1), (0, 3), (-1, 1), (-3, 0), (-1, -1), (0, -3), (1, -1))
_HOLE = ((0.5, 0.0), (0.0, 0.5), (-0.5, 0.0), (0.0, -0.5))
_SHAPES = f"""corners AS (SELECT unnest([{", ".join(map(str, range(len(_STAR))))}]) AS i, unnest([{", ".join(f"{x}.0" for x, _ in _STAR)}]) AS dx, unnest([{", ".join(f"{y}.0" for _, y in _STAR)}]) AS dy, 0 AS ring, {len(_STAR)} AS m
  UNION ALL SELECT unnest([0, 1, 2, 3]), unnest([{", ".join(str(x) for x, _ in _HOLE)}]), unnest([{", ".join(str(y) for _, y in _HOLE)}]), 1, 4),
centres AS (SELECT p_partkey AS part, CAST(p_partkey * 37 % 360 - 180 AS DOUBLE) AS cx, CAST(p_partkey * 13 % 140 - 70 AS DOUBLE) AS cy, (1 + p_size % 5) / 4.0 AS r FROM part),
edges AS (SELECT part, cx + r * a.dx AS x1, cy + r * a.dy AS y1, cx + r * b.dx AS x2, cy + r * b.dy AS y2 FROM centres, corners a JOIN corners b ON a.ring = b.ring AND b.i = (a.i + 1) % a.m)"""


def _stars(read):
    k = F.col("p_partkey")
    c = read("part").select(k.alias("part"), (k * 37 % 360 - 180).cast("double").alias("cx"), (k * 13 % 140 - 70).cast("double").alias("cy"), ((F.col("p_size") % 5 + 1) / 4.0).alias("r"))
    wrap = lambda x: F.when(x > 180, x - 360.0).when(x < -180, x + 360.0).otherwise(x)
    ring = lambda corners: F.array(*(F.struct(wrap(F.col("cx") + F.col("r") * F.lit(float(x))).alias("x"), (F.col("cy") + F.col("r") * F.lit(float(y))).alias("y")) for x, y in corners))
    return c.select("part", F.array(ring(_STAR), ring(_HOLE)).alias("rings"))


@query(f"""WITH {POINTS}, {_SHAPES}, boxes AS (SELECT part, cx, cy, 3 * r AS w FROM centres),
p AS (SELECT event_id, lon, lat FROM points UNION ALL SELECT event_id, lon + 360, lat FROM points WHERE lon < 0 UNION ALL SELECT event_id, lon - 360, lat FROM points WHERE lon >= 0),
near AS (SELECT event_id, part, lon, lat FROM p JOIN boxes ON lon BETWEEN cx - w AND cx + w AND lat BETWEEN cy - w AND cy + w)
SELECT DISTINCT event_id, part FROM (SELECT event_id, n.part, lon, lat FROM near n JOIN edges e ON e.part = n.part AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)""")
def point_in_polygon(read):
    """All points in stars with holes; the same ring across the antimeridian is given with longitudes of both sides."""
    p = points(read).select("event_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return polygons.points_in_polygons(p, _stars(read), "event_id", "part", cell=2.0)


@query(f"""WITH {POINTS}, l AS (SELECT n_nationkey AS nation, CAST((n_nationkey * 37) % 340 - 170 AS DOUBLE) AS x1, CAST((n_nationkey * 13) % 120 - 60 AS DOUBLE) AS y1 FROM nation),
s AS (SELECT nation, x1, y1, x1 + 6 AS x2, y1 + 2 AS y2 FROM l UNION ALL SELECT nation, x1 + 6, y1 + 2, x1 + 5, y1 + 9 FROM l),
t AS (SELECT event_id, nation, lon, lat, x1, y1, x2, y2, least(1.0, greatest(0.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM points, s),
d AS (SELECT event_id, nation, sqrt(pow(lon - x1 - t * (x2 - x1), 2) + pow(lat - y1 - t * (y2 - y1), 2)) AS d FROM t)
SELECT event_id, nation, round(min(d), 9) AS distance FROM d WHERE d <= 1.5 GROUP BY 1, 2""")
def points_near_lines(read):
    """Points no further than a tolerance from lines, as a click on a map finds them."""
    k = F.col("n_nationkey")
    x, y = ((k * 37) % 340 - 170).cast("double"), ((k * 13) % 120 - 60).cast("double")
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    lines = read("nation").select(k.alias("nation"), F.array(F.array(pt(x, y), pt(x + 6, y + 2), pt(x + 5, y + 9))).alias("geom"))
    p = points(read).select("event_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return polygons.points_near_lines(p, lines, "event_id", "nation", 1.5).select("event_id", "nation", F.round("distance", 9).alias("distance"))


# a rectangle with a step on top and a hole; areas, centres and the widest run of the row, by hand
@query("""WITH p AS (SELECT p_partkey AS part, CAST(p_partkey * 7 % 500 AS DOUBLE) AS x, CAST(p_partkey * 3 % 400 AS DOUBLE) AS y, CAST(1 + p_size % 9 AS DOUBLE) * 4 AS s FROM part)
SELECT part, round(x + s * (2 * 1.0 + 0.25 * 0.5 - 0.09375 * 0.5) / 2.15625, 6) AS cx, round(y + s * (2 * 0.5 + 0.25 * 1.125 - 0.09375 * 0.5625) / 2.15625, 6) AS cy, round(x + 1.3125 * s, 6) AS sx, round(y + 0.5625 * s, 6) AS sy FROM p""")
def surface_points(read):
    """Centres of area and points on the surface of concave polygons with a hole, by the rules that name them."""
    k = F.col("p_partkey")
    x, y, s = (k * 7 % 500).cast("double"), (k * 3 % 400).cast("double"), ((F.col("p_size") % 9 + 1) * 4).cast("double")
    ring = lambda corners: F.array(*(F.struct((x + s * F.lit(a)).alias("x"), (y + s * F.lit(b)).alias("y")) for a, b in corners))
    shape = F.array(ring(((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 1.25), (0.0, 1.25))), ring(((0.375, 0.375), (0.625, 0.375), (0.625, 0.75), (0.375, 0.75))))
    shapes = read("part").select(k.alias("part"), shape.alias("rings"))
    by = lambda rule: polygons.rule_geometry(F.col("rings"), F.lit("polygon"), F.lit(rule))[0][0]
    c, on = by("polygon_centroid"), by("polygon_point_on_surface")
    return shapes.select("part", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), F.round(on["x"], 6).alias("sx"), F.round(on["y"], 6).alias("sy"))


also("distinct_tiles", "distinct_tiles_all")
