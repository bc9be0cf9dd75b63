"""Queries that write archives into the shared folder and read them back by byte ranges."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tilewright.plans.registry import query
from tilewright.plans.storage import shared_path
from tilewright.sources import ranged

# a tile for each event, at zoom 20; equal tiles recur
_TILES = "tiles AS (SELECT 20 AS z, CAST(event_id % 1024 AS INT) AS x, CAST(event_id // 1024 AS INT) AS y, event_type || ':' || (event_id % 977) AS tile FROM events)"


def _tiles(read):
    i = F.col("event_id")
    return read("events").select(F.lit(20).alias("z"), (i % 1024).cast("int").alias("x"), F.floor(i / 1024).cast("int").alias("y"), F.encode(F.concat("event_type", F.lit(":"), (i % 977).cast("string")), "UTF-8").alias("tile"))


def _archive(read):
    tiles = _tiles(read)
    path = os.path.join(shared_path(tiles.sparkSession), "events.pmtiles")
    return tiles.sparkSession, path, ranged.write_tiles(tiles, path, {"name": "events"})


@query(f"WITH {_TILES} SELECT z, x, y, tile FROM tiles WHERE x BETWEEN 100 AND 300")
def archive_box(read):
    """The tiles of all events as one archive, and those of a box read back by ranges."""
    spark, path, _ = _archive(read)
    return ranged.read_tiles(spark, [path], min_z=20, max_z=20, min_x=100, max_x=300).select("z", "x", "y", F.decode("tile", "UTF-8").alias("tile"))


@query(f"WITH {_TILES}, c AS (SELECT DISTINCT tile FROM tiles) SELECT count(*) AS addressed, (SELECT count(*) FROM c) AS contents, (SELECT CAST(sum(strlen(tile)) AS BIGINT) FROM c) AS tile_bytes, min(z) AS min_zoom, max(z) AS max_zoom, 'events' AS name, true AS verified FROM tiles")
def archive_publish(read):
    """Header, metadata and digest of the published archive, as they are read back from the file."""
    spark, path, _ = _archive(read)
    reader = ranged.RangeReader(path)
    h = ranged.header_of(reader)
    row = (h["addressed"], h["contents"], h["tiles_bytes"], h["min_zoom"], h["max_zoom"], ranged.metadata_of(reader)["name"], ranged.verified(spark, path))
    return spark.createDataFrame([row], "addressed long, contents long, tile_bytes long, min_zoom int, max_zoom int, name string, verified boolean")


@query(f"WITH {_TILES} SELECT x, y, tile FROM tiles WHERE x = 77 AND y = 0")
def archive_point(read):
    """One address of the archive; the other directories aren't read."""
    spark, path, _ = _archive(read)
    return ranged.read_tile(spark, path, 20, 77, 0).select("x", "y", F.decode("tile", "UTF-8").alias("tile"))


# an extract of all events as nodes, a way of four of them for each part, and a square of four ways for each tenth part
_NODES = "n AS (SELECT event_id AS id, (event_id * 7919) % 360000 / 1000.0 - 180.0 AS lon, (event_id * 104729) % 170000 / 1000.0 - 85.0 AS lat FROM events), m AS (SELECT count(*) AS events FROM events)"


def _extract(read):
    from tilewright.sources import extracts

    events, parts = read("events"), read("part")
    spark, n = events.sparkSession, events.count()
    i, k = F.col("event_id"), F.col("p_partkey")
    none = lambda kind: F.lit(None).cast(kind)
    refs, members, tags = "array<bigint>", "array<struct<kind:string,ref:bigint,role:string>>", "map<string,string>"
    nodes = events.select(F.lit("node").alias("kind"), i.alias("id"), F.when(i % 50 == 0, F.create_map(F.lit("type"), "event_type")).otherwise(F.create_map().cast(tags)).alias("tags"), ((i * 7919) % 360000 / 1000.0 - 180.0).alias("lon"), ((i * 104729) % 170000 / 1000.0 - 85.0).alias("lat"), none(refs).alias("refs"), none(members).alias("members"))
    way = lambda id_, name, own: parts.select(F.lit("way").alias("kind"), id_.alias("id"), F.create_map(F.lit("name"), name).alias("tags"), none("double").alias("lon"), none("double").alias("lat"), own.cast(refs).alias("refs"), none(members).alias("members"))
    ways = way(k * 10, F.col("p_name"), F.array(*((k * 3 + j * 11) % n for j in range(4))))
    # four ways that meet end to end, two of them the other way round
    ends = [(0, 1), (2, 1), (2, 3), (0, 3)]
    for j, (a, b) in enumerate(ends):
        ways = ways.unionByName(way(k * 10 + 1 + j, F.lit("side"), F.array((k * 5 + a) % n, (k * 5 + b) % n)).where("id % 100 < 10"))
    member = lambda j: F.struct(F.lit("way").alias("kind"), (k * 10 + 1 + j).alias("ref"), F.lit("outer" if j else "").alias("role"))
    relations = parts.where("p_partkey % 10 = 0").select(F.lit("relation").alias("kind"), k.alias("id"), F.create_map(F.lit("type"), F.lit("multipolygon")).alias("tags"), none("double").alias("lon"), none("double").alias("lat"), none(refs).alias("refs"), F.array(*map(member, range(4))).alias("members"))
    path = os.path.join(shared_path(spark), "extract.osm.pbf")
    extracts.write_extract(nodes.unionByName(ways).unionByName(relations), path, 1000)
    return lambda kind: extracts.read_extract(spark, [path], 1 << 16, [kind])


@query(f"""WITH {_NODES}, w AS (SELECT p_partkey AS part, p_name AS name, unnest([0, 1, 2, 3]) AS j FROM part), r AS (SELECT part, name, j, n.lon, n.lat FROM w, m, n WHERE n.id = (part * 3 + j * 11) % events)
SELECT part * 10 AS id, name, count(*) AS points, round(arg_min(lon, j), 6) AS first_lon, round(arg_max(lat, j), 6) AS last_lat, round(sum(lon), 6) AS lons FROM r GROUP BY part, name""")
def extract_lines(read):
    """Ways of an extract with the places of their nodes, written and read back in pieces."""
    from tilewright.sources.extracts import way_lines

    lines = way_lines(_extract(read)).where("tags['name'] <> 'side'")
    return lines.select("id", F.col("tags")["name"].alias("name"), F.size("points").cast("long").alias("points"), F.round(F.col("points")[0]["lon"], 6).alias("first_lon"), F.round(F.element_at("points", -1)["lat"], 6).alias("last_lat"), F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p["lon"]), 6).alias("lons"))


@query(f"""WITH {_NODES}, w AS (SELECT p_partkey AS part, unnest([0, 1, 2, 3]) AS j FROM part WHERE p_partkey % 10 = 0), r AS (SELECT part, n.lon, n.lat FROM w, m, n WHERE n.id = (part * 5 + j) % events)
SELECT part AS id, CAST(1 AS INT) AS rings, CAST(count(*) + 1 AS BIGINT) AS points, round(min(lon), 6) AS west, round(max(lat), 6) AS north FROM r GROUP BY part""")
def extract_polygons(read):
    """Rings of multipolygons, put together from ways that run either way round."""
    from tilewright.sources.extracts import multipolygons

    ring = F.col("outer")[0]
    return multipolygons(_extract(read)).where("left = 0").select("id", F.size("outer").alias("rings"), F.size(ring).cast("long").alias("points"), F.round(F.array_min(F.transform(ring, lambda p: p["lon"])), 6).alias("west"), F.round(F.array_max(F.transform(ring, lambda p: p["lat"])), 6).alias("north"))
