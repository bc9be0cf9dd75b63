"""Golden cases of the core operators, codecs and stateful streams."""

from __future__ import annotations

import datetime
import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import classes, style
from tilewright.functions import expressions as E
from tilewright.functions import text as X
from tilewright.functions import tilemath as T
from tilewright.operators import cache, features, inventory, metrics, planning, routing
from tilewright.operators.profile import RULES, apply_profile, centroid
from tilewright.sources import archives, mvt
from tilewright.streaming import state

FEATURE = "payload_idx int, feature_idx int, layer string, fid long, gtype int, props map<string,string>, geom array<array<struct<x:double,y:double>>>"


def merged(spark, rows):
    f = spark.createDataFrame(rows, FEATURE).withColumn("fkey", features.feature_key(F.col("gtype"), F.col("fid"), F.col("props"), F.col("geom")))
    return sorted(features.merge(f, ["layer", "fkey"], ["payload_idx", "feature_idx"]).collect(), key=lambda r: (r["fid"], r["payload_idx"]))


def test_lines_merge_by_id(spark):
    short, long = [[(0.0, 100.0), (2048.0, 100.0)]], [[(0.0, 100.0), (2048.0, 100.0), (4096.0, 100.0)]]
    got = merged(spark, [(1, 0, "transportation", 42, 2, {}, short), (2, 0, "transportation", 42, 2, {}, long), (2, 1, "transportation", 99, 2, {}, [[(100.0, 200.0), (300.0, 300.0)]])])
    assert [r["fid"] for r in got] == [42, 99] and [len(p) for p in got[0]["geom"]] == [3]
    back = merged(spark, [(1, 0, "t", 1, 2, {}, long), (2, 0, "t", 1, 2, {}, [short[0][::-1]]), (3, 0, "t", 1, 2, {}, [[(9.0, 9.0), (8.0, 8.0)]])])
    assert [len(p) for p in back[0]["geom"]] == [3, 2]


def test_a_lone_line_keeps_its_parts(spark):
    parts = [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], [(0.0, 0.0), (1.0, 0.0)]]
    assert [[len(p) for p in r["geom"]] for r in merged(spark, [(1, 0, "t", 1, 2, {}, parts)])] == [[3, 2]]
    assert [[len(p) for p in r["geom"]] for r in merged(spark, [(1, 0, "t", 1, 2, {}, parts), (2, 0, "t", 1, 2, {}, parts)])] == [[3, 2]]
    assert [[len(p) for p in r["geom"]] for r in merged(spark, [(1, 0, "t", 1, 2, {}, parts[1:]), (2, 0, "t", 1, 2, {}, parts)])] == [[3]]


def test_hierarchies(spark):
    rows = [(k, k - 1 if k else None) for k in range(200)] + [(300, 301), (301, 302), (302, 300), (303, 300), (400, 999), (500, 500)]
    df = spark.createDataFrame(rows, "id long, parent long")
    got = {r["id"]: (r["root"], r["depth"]) for r in planning.ancestors_root(df).collect()}
    assert all(got[k] == (0, k) for k in range(200)) and got[400] == (400, 0)
    assert all(got[k] == (None, None) for k in (300, 301, 302, 303, 500))
    stop = {r["id"]: r["root"] for r in planning.ancestors_root(df, stop=F.col("id").isin(50, 120)).collect()}
    assert (stop[49], stop[50], stop[119], stop[120], stop[199]) == (0, 50, 50, 120, 120)
    assert sorted(r["id"] for r in planning.leaves(df.where("id < 300"), F.col("id") % 3 == 0).collect()) == [198]
    assert planning.ancestors_root(df.limit(0)).count() == 0


def test_region_index(spark, tmp_path):
    box = lambda *p: {"type": "MultiPolygon", "coordinates": [[[list(x) for x in p]]]}
    feature = lambda g, **p: {"type": "Feature", "properties": p, "geometry": g}
    index = {"type": "FeatureCollection", "features": [
        feature(None, id="europe", name="Europe"), feature(box((1, 2), (3, 4.5), (-1e0, 3)), id="a/b", parent="europe", urls={"pbf": "http://x"}),
        feature(box((170, 0), (-170, 1)), id="c", parent="a/b", urls={"pbf": "http://y"}), feature(box((0, 0), (1, 1)), name="no id"), feature(box((5, 5), (6, 6)), id="d", parent="zz", name="D", urls={"pbf": "http://z"}),
    ]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    read = planning.read_index(spark, str(tmp_path / "index.json"))
    bounds = {r["id"]: r["bounds"] and tuple(r["bounds"]) for r in read.collect()}
    assert bounds == {"europe": None, "a/b": (-1.0, 2.0, 3.0, 4.5), "c": (170.0, 0.0, -170.0, 1.0), "d": (5.0, 5.0, 6.0, 6.0)}
    plan = planning.base_plan(read, ["europe"], "tiles")
    assert [(r["id"], r["slug"], r["name"], r["continent"], r["asset_name"]) for r in plan.collect()] == [("c", "c", "c", "europe", "tiles-c.pmtiles"), ("d", "d", "D", "d", "tiles-d.pmtiles")]
    assert [r["id"] for r in planning.base_plan(read, ["europe"], "tiles", scope="europe").collect()] == ["c"]
    planning.plan_json(plan, f"{tmp_path}/plan")
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/plan").orderBy("id").collect()] == ["c", "d"]
    (tmp_path / "other.json").write_text('{"type": "Feature"}')
    for scan in (archives.read_collection, archives.read_features):
        with pytest.raises(Exception, match="not a FeatureCollection"):
            scan(spark, str(tmp_path / "other.json")).collect()


def test_styles(spark, tmp_path):
    layers = [{"id": "bg", "type": "background", "paint": {"background-color": "rgb(1, 2, 3)"}}, {"id": "r", "type": "line", "source": "s", "source-layer": "road", "minzoom": 3, "filter": ["==", ["get", "class"], "x"], "paint": {"line-width": ["get", "sizerank"]}}, {"id": "h", "type": "fill", "source": "s", "source-layer": "hillshade"}, {"id": "q", "type": "fill", "source": "s", "source-layer": "zz"}]
    (tmp_path / "style.json").write_text(json.dumps({"version": 8, "layers": layers}))
    (tmp_path / "empty.json").write_text("{}")
    read = style.read_layers(spark, str(tmp_path))
    got = {r["id"]: r for r in style.normalized_colors(style.convert(read)).collect()}
    assert got["bg"]["paint"] == '{"background-color": "#010203"}' and got["bg"]["reason"] is None and got["r"]["minzoom"] == 3.0
    assert json.loads(got["r"]["filter"]) == ["case", ["==", classes.ROAD_CLASS, "x"], True, False] and json.loads(got["r"]["paint"]) == {"line-width": ["get", "rank"]}
    assert got["h"]["reason"].startswith("replaced") and got["q"]["reason"] == "unmapped source-layer: zz"
    report = style.compatibility_report(style.convert(read)).first()
    assert (report["layers"], report["kept"], report["skipped"], json.loads(report["mappings"])) == (4, 2, 2, {"road": ["transportation"]})
    assert style.class_replaced({"a": ["x", ["get", "class"], ["get", "class", 1]]}, 7) == {"a": ["x", 7, ["get", "class", 1]]}
    assert style.boundary_recoded(["all", ["==", 0, "true"], ["!=", ["get", "admin_level"], 2]]) == ["all", ["==", ["get", "disputed"], 1], ["!=", ["get", "admin_level"], 6]]


def test_more_sources(spark, tmp_path):
    for k in (0, 200):
        (tmp_path / f"ne_bathymetry_{k}.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point"}}]}))
    assert sorted(r["depth"] for r in archives.read_depths(spark, f"{tmp_path}/ne*.json", 2).collect()) == [0, 200]
    with pytest.raises(ValueError):
        archives.read_depths(spark, f"{tmp_path}/ne*.json")
    (tmp_path / "icons" / "a").mkdir(parents=True)
    (tmp_path / "icons" / "a" / "bar.svg").write_text("<svg/>")
    assert [r["name"] for r in archives.read_icons(spark, f"{tmp_path}/icons").collect()] == ["bar"]
    (tmp_path / "build.log").write_text("0:24:22 INF - overall   24m22s cpu:1h30m23s gc:1m avg:3.7\n0:24 INF other\n0:24:22 INF - osm_pass1  37s cpu:2m\n")
    assert sorted(tuple(r)[1:] for r in archives.read_build_log(spark, f"{tmp_path}/build.log").collect()) == [("osm_pass1", 37, 120), ("overall", 1462, 5423)]
    (tmp_path / "rows.json").write_text(json.dumps({"fields": [{"name": "a"}, {}], "rows": [["1", "2"], ["3", None]]}))
    assert [r["row"] for r in archives.named_rows(spark, f"{tmp_path}/rows.json").collect()] == [{"a": "1", "column_1": "2"}, {"a": "3", "column_1": None}]
    (tmp_path / "p1.json").write_text('{"assets": [{"name": "a", "state": "uploaded", "size": 3}]}')
    (tmp_path / "p2.json").write_text('[{"name": "b", "state": "new", "size": 0}]')
    assert sorted(tuple(r) for r in archives.read_pages(spark, f"{tmp_path}/p*.json").collect()) == [("a", "uploaded", 3), ("b", "new", 0)]
    hints = spark.createDataFrame([({"k": "v"}, '{"type":"Point","coordinates":[1,2]}', 3, 9)], "properties map<string,string>, geometry string, minzoom int, maxzoom int")
    archives.write_collection(hints, f"{tmp_path}/out")
    assert json.loads(spark.read.text(f"{tmp_path}/out").first()[0])["tippecanoe"] == {"minzoom": 3, "maxzoom": 9}
    files = spark.createDataFrame([(bytearray(b"PMTiles" + b"x" * 200), 207), (bytearray(b"PMTilex" + b"x" * 200), 207), (bytearray(b"PMTiles"), 7)], "content binary, length long")
    assert [r["valid"] for r in archives.valid_archive(files).collect()] == [True, False, False]
    assert spark.range(1).select(X.safe_label(F.lit("a\nb" + "c" * 300))).first()[0] == "a b" + "c" * 197


def square(a, b):
    return [[(a, a), (b, a), (b, b), (a, b), (a, a)]]


def test_polygons_merge_by_shape(spark):
    a, b = square(100.0, 1500.0), square(2500.0, 3900.0)
    assert len(merged(spark, [(1, 0, "depth", 7, 3, {}, a), (2, 0, "depth", 7, 3, {}, b)])) == 2
    assert len(merged(spark, [(1, 0, "depth", 7, 3, {}, a), (2, 0, "depth", 7, 3, {}, a)])) == 1
    assert len(merged(spark, [(1, 0, "depth", 7, 3, {"k": "1"}, a), (2, 0, "depth", 7, 3, {"k": "2"}, a)])) == 2


def test_clip_and_overscale(spark):
    df = spark.createDataFrame([(1, square(-100.0, 5000.0)[0]), (2, square(5000.0, 6000.0)[0]), (3, [(0.0, 0.0), (4096.0, 0.0)]), (4, [(-10.0, 2.0), (10.0, 2.0), (10.0, 8.0), (-10.0, 2.0)])], "id int, ring array<struct<x:double,y:double>>")
    got = {r["id"]: r["c"] for r in df.withColumn("c", features.clip_ring(F.col("ring"), 4096)).collect()}
    assert {(p["x"], p["y"]) for p in got[1]} == {(0.0, 0.0), (4096.0, 0.0), (4096.0, 4096.0), (0.0, 4096.0)} and got[1][0] == got[1][-1]
    assert got[2] is None and got[3] is None and [(p["x"], p["y"]) for p in got[4]][:1] and min(p["x"] for p in got[4]) == 0


def test_clip_without_result(spark):
    rings = [(1, None), (2, []), (3, [(float("nan"), 1.0), (0.0, 0.0), (1.0, 1.0)]), (4, [None, (0.0, 0.0), (5.0, 9.0)]), (5, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]), (6, [(0.2, 0.2), (0.3, 0.1), (0.1, 0.4)])]
    df = spark.createDataFrame(rings, "id int, ring array<struct<x:double,y:double>>").coalesce(1)
    got = {r["id"]: r["c"] for r in df.withColumn("c", features.clip_ring(F.col("ring"), 100)).collect()}
    assert [k for k, v in got.items() if v is not None] == [5] and [tuple(p) for p in got[5]] == [(0, 0), (9, 0), (9, 9), (0, 0)]
    assert df.limit(0).select(features.clip_ring(F.col("ring"), 100)).collect() == []


def test_clip_against_loops(spark):
    def one(ring, extent):
        if len(ring) < 3:
            return None
        ring = ring[:-1] if ring[0] == ring[-1] else ring
        for axis, bound, sign in ((0, 0, 1), (0, extent, -1), (1, 0, 1), (1, extent, -1)):
            out = []
            for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True):
                ins = [(p[axis] - bound) * sign >= 0 for p in (a, b)]
                if ins[0] != ins[1]:
                    other = a[1 - axis] + (b[1 - axis] - a[1 - axis]) * (bound - a[axis]) / (b[axis] - a[axis])
                    out.append((bound, other) if axis == 0 else (other, bound))
                if ins[1]:
                    out.append(b)
            ring = out
        ring = [tuple(math.floor(v + 0.5) for v in p) for p in ring]
        ring = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
        ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        return ring + ring[:1] if len(ring) >= 3 else None

    r = random.Random(7)
    at = lambda: float(r.choice([0, 50, 100, r.randint(-60, 160), r.uniform(-60, 160)]))
    rings = {i: [(at(), at()) for _ in range(r.randint(0, 9))] for i in range(600)}
    df = spark.createDataFrame([*rings.items()], "id int, ring array<struct<x:double,y:double>>")
    got = {row["id"]: row["c"] and [tuple(p) for p in row["c"]] for row in df.select("id", features.clip_ring(F.col("ring"), 100).alias("c")).collect()}
    assert got == {k: one(v, 100) for k, v in rings.items()}


def test_routing(spark):
    regions = spark.createDataFrame([("west", -10.0, -10.0, 1.0, 10.0), ("east", 0.0, -10.0, 10.0, 10.0), ("antimeridian", 170.0, -20.0, -170.0, 20.0)], "asset string, west double, south double, east double, north double")
    tiles = spark.createDataFrame([(6, 32, 31), (6, 63, 31), (6, 0, 31), (6, 64, 0), (17, 0, 0), (0, 0, 0)], "z int, x long, y long")
    got = {(r["x"], r["asset"]) for r in routing.route(tiles, regions).collect()}
    assert got == {(32, "west"), (32, "east"), (63, "antimeridian"), (0, "antimeridian")}
    assert {r["asset"] for r in routing.route_overview(tiles, regions).collect()} == {"west", "east", "antimeridian"}
    valid = tiles.select(T.tile_valid(F.col("z"), F.col("x"), F.col("y"), 16).alias("v")).collect()
    assert [r["v"] for r in valid] == [True, True, True, False, False, True]


def test_plan_split(spark):
    plan = spark.createDataFrame([("ru", 105.4219, 37.34659, -168.6841, 82.00023, 2400)], "id string, west double, south double, east double, north double, size long")
    sized = planning.grid_dimensions(plan, 300).withColumn("grid_rows", F.lit(2).cast("long")).withColumn("grid_columns", F.lit(4).cast("long"))
    cells = {r["id"]: r for r in planning.grid_split(sized).collect()}
    halves = [k for k in cells if k.endswith("-s1")]
    assert halves and all(cells[k]["east"] == 180 and cells[k[:-1] + "2"]["west"] == -180 for k in halves)


def test_ttl_and_prune(spark):
    df = spark.createDataFrame([(None,), (1000,), (1001,), (5001,)], "age long")
    assert [r[0] for r in df.select(cache.ttl_state(F.col("age"), 1000, 5000)).collect()] == ["miss", "fresh", "stale", "expired"]
    rows = spark.createDataFrame([(k, "v2" if k else "v1", 0, 10) for k in range(6)], "k int, version string, shard int, size int")
    assert sorted(r["k"] for r in cache.prune(rows, "shard", "version", F.lit("v2"), 25, [F.desc("k")], "size").collect()) == [4, 5]


def test_inventory(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "k int, v int")
    b = spark.createDataFrame([(2, 7), (3, None), (4, 1)], "k int, v int")
    assert {r["k"]: r["verdict"] for r in inventory.audit(a, b, "k", "v").collect()} == {1: "missing", 2: "mismatch", 3: "match", 4: "unexpected"}
    assert [r["k"] for r in inventory.mandatory(a, b, ["k"]).collect()] == [1]


def test_percentile_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [5, 1, 1, 9, 7, 3, 3]] + [("b", 2.0)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p99"]) for r in metrics.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (3.0, 9.0), "b": (2.0, 2.0)}


def test_expressions(spark):
    assert E.normalize(["none", ["==", "a", 1], ["!in", "b", "x"]]) == ["!", ["any", ["==", ["get", "a"], 1], ["!", ["match", ["get", "b"], ["x"], True, False]]]]
    df = spark.createDataFrame([({"a": "3", "c": "x"},), ({"a": "30"},), ({},)], "p map<string,string>")
    p = F.col("p")
    one = lambda e, **k: [r[0] for r in df.select(E.compile_expr(e, p, **k)).collect()]
    assert one(["<", ["get", "a"], 5]) == [True, False, False] and one(["has", "c"]) == [True, False, False]
    assert one(["interpolate", ["linear"], ["zoom"], 0, 0, 10, 5], zoom=4.0) == [2.0] * 3
    assert one(["coalesce", ["get", "c"], "none"]) == ["x", "none", "none"] and one(["max", 1, ["get", "a"]])[:2] == [3.0, 30.0]
    assert E.literals(["all", ["==", ["get", "k"], "v"], 3]) == ["k", "v"] and E.literals(["x", 3, True], (int, float)) == [3]


def test_profile_matches_several_rules(spark):
    df = spark.createDataFrame([(1, "polygon", {"landuse": "farmland", "name": "f"}), (2, "line", {"highway": "primary_link"}), (3, "point", {})], "osm_id long, geom_kind string, tags map<string,string>")
    got = sorted((r["osm_id"], r["layer"], r["attrs"].get("class")) for r in apply_profile(df).collect())
    assert got == [(1, "landcover", "farmland"), (1, "landuse", "farmland"), (2, "transportation", "primary")] and len(RULES) == 55
    assert apply_profile(df, zoom=3).count() == 1 and apply_profile(df, rules=[]).count() == 0
    tags = [("polygon", {"natural": "glacier"}), ("polygon", {"natural": "water", "name": "it's"}), ("line", {"highway": "residential", "bridge": "no"}), ("line", {"railway": "tram", "tunnel": "culvert"}), ("line", {"highway": "primary_link", "bridge": "viaduct"}), ("line", None)]
    many = spark.createDataFrame([(k, *t) for k, t in enumerate(tags)], "osm_id long, geom_kind string, tags map<string,string>")
    attrs = {(r["osm_id"], r["layer"]): r["attrs"] for r in apply_profile(many).collect()}
    assert attrs[0, "landcover"] == {"class": "ice"} and attrs[1, "water"] == {"class": "lake", "name": "it's"} and (5, "transportation") not in attrs
    assert attrs[2, "transportation"] == {"class": "minor", "subclass": "residential", "brunnel": "none", "ramp": "0"}
    assert attrs[3, "transportation"] == {"class": "transit", "subclass": "tram", "brunnel": "tunnel"}
    assert attrs[4, "transportation"] == {"class": "primary", "subclass": "primary_link", "brunnel": "bridge", "ramp": "1"}


def test_centroid(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)],), ([(1.0, 1.0), (3.0, 5.0)],), ([],)], "ring array<struct<x:double,y:double>>")
    assert [tuple(r["c"]) for r in df.select(centroid(F.col("ring")).alias("c")).collect()] == [(2.0, 1.0), (2.0, 3.0), (None, None)]


def test_text(spark):
    df = spark.createDataFrame([("Foo / Bar é--x",)], "t string")
    assert df.select(X.slugify(F.col("t"))).first()[0] == "foo--bar--x"
    size = F.lit(36).cast("long")
    ranges = {h: df.select(X.byte_range(F.lit(h), size).alias("r")).first()["r"] for h in ("bytes=5-14", "bytes=46-", "bytes=-4", "bytes=9-3")}
    assert tuple(ranges["bytes=5-14"]) == (5, 14) and ranges["bytes=46-"] is None and tuple(ranges["bytes=-4"]) == (32, 35) and ranges["bytes=9-3"] is None
    assert df.select(X.fnv_shard(F.lit("a"), 0)).first()[0] == -1 and df.select(X.fnv_shard(F.lit("a"), 1 << 40)).first()[0] == 0xE40C292C


def test_wire_round_trip(spark):
    layers = {"a": (2, 4096, [{"fid": 3, "gtype": 2, "props": {"k": "v"}, "geom": [[(0, 0), (5, -7)], [(1, 1), (2, 2), (3, 3)]]}, {"fid": None, "gtype": 3, "props": {}, "geom": [[(0, 0), (9, 0), (9, 9), (0, 0)]]}, {"fid": 9, "gtype": 1, "props": {"k": "v"}, "geom": [[(4, 4)]]}])}
    data = mvt.encode_tile(layers)
    back = mvt.decode_tile(data)
    assert [(f["fid"], f["gtype"], f["geom"], f["props"]) for f in back] == [(f["fid"], f["gtype"], f["geom"], f["props"]) for f in layers["a"][2]]
    assert mvt.decode_tile(b"") == []
    for bad in (b"\xff\xff\xff", data[:-3]):
        with pytest.raises(ValueError):
            mvt.decode_tile(bad)
    with pytest.raises(ValueError):
        mvt.decode_tile(b"x" * 2048, {"bytes": 1024})


def test_archives(spark, tmp_path):
    tiles = spark.createDataFrame([(1, 0, 1, bytearray(b"t1")), (2, 3, 0, bytearray(b"t2")), (2, 3, 1, bytearray())], "z int, x int, y int, tile binary")
    archives.write_tiles(tiles, f"{tmp_path}/tiles")
    assert bytes(archives.read_tile(spark, f"{tmp_path}/tiles", 2, 3, 0).first()["tile"]) == b"t2" and archives.read_tile(spark, f"{tmp_path}/tiles", 2, 3, 1).count() == 0
    back = archives.unpack_sqlite(archives.pack_sqlite(tiles, {"name": "x"}), "archive")
    assert sorted((r["z"], r["x"], r["y"], bytes(r["tile"])) for r in back.collect()) == [(1, 0, 1, b"t1"), (2, 3, 0, b"t2"), (2, 3, 1, b"")]
    d = tmp_path / "tree" / "3" / "2"
    d.mkdir(parents=True)
    (d / "1.pbf").write_bytes(gzip.compress(b"p"))
    assert [tuple(r)[:3] for r in archives.read_tile_tree(spark, str(tmp_path / "tree")).collect()] == [(3, 2, 1)]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"FEATURECLA": "Desert"}, "geometry": {"type": "Point"}}, {"type": "Feature", "properties": {}, "geometry": None}]}))
    assert archives.read_collection(spark, str(tmp_path / "c.json")).count() == 1
    (tmp_path / "m.json").write_text(json.dumps({"version": 2, "regions": [{"id": "a", "asset": "b", "bounds": [0, 0, 1, 1]}]}))
    assert archives.read_manifest(spark, str(tmp_path / "m.json")).first()["version"] == 2


def run_stream(spark, tmp_path, rows, schema, make):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = make(source).writeStream.format("memory").queryName("out_" + tmp_path.name.replace("-", "_")).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out_" + tmp_path.name.replace("-", "_")).collect()


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def test_ttl_stream(spark, tmp_path):
    rows = [("k", at(0)), ("k", at(1000)), ("k", at(1500)), ("k", at(7000)), ("k", at(7500))]
    got = run_stream(spark, tmp_path, rows, "key string, at timestamp", lambda s: state.ttl_cache(s, 1000, 5000))
    assert [r["state"] for r in sorted(got, key=lambda r: r["at"])] == ["miss", "fresh", "stale", "expired", "fresh"]


def test_circuit_stream(spark, tmp_path):
    rows = [("k", at(1000), False), ("k", at(1001), False), ("k", at(1500), True), ("k", at(2101), True), ("k", at(2200), False)]
    got = run_stream(spark, tmp_path, rows, "key string, at timestamp, ok boolean", lambda s: state.circuit_breaker(s, 2, 1000))
    assert [r["verdict"] for r in sorted(got, key=lambda r: r["at"])] == ["failed", "failed", "refused", "passed", "failed"]


def test_single_file_archives(spark, monkeypatch):
    from tilewright.sources import pmtiles

    monkeypatch.setattr(pmtiles, "ROOT_BYTES", 120)

    assert [pmtiles.tile_number(*a) for a in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]
    for n in (0, 4, 5, 20, 21, 341, 99_999, 123_456_789):
        assert pmtiles.tile_number(*pmtiles.tile_address(n)) == n
    rows = [(z, x, y, b"same" if z < 3 else f"{z}/{x}/{y}".encode()) for z in range(8) for x in range(1 << z) for y in range(1 << z)]
    data = pmtiles.write_archive(rows, {"name": "t"})
    head = pmtiles.read_header(data)
    assert (head["min_zoom"], head["max_zoom"], head["addressed"], head["about"]) == (0, 7, len(rows), {"name": "t"}) and head["leaves_bytes"] > 0
    assert sorted(pmtiles.read_archive(data)) == sorted(rows)
    for bad in (b"PMTiles", data[:-9], b"x" * 200):
        with pytest.raises(ValueError):
            list(pmtiles.read_archive(bad))
    df = spark.createDataFrame([("a", 1, 0, 1, bytearray(b"t1")), ("a", 0, 0, 0, bytearray(b"t0")), ("b", 2, 3, 0, bytearray(b"t2"))], "asset string, z int, x int, y int, tile binary")
    packed = pmtiles.pack_archives(df).selectExpr("asset AS path", "archive AS content")
    assert sorted((r["path"], r["z"], r["x"], r["y"], bytes(r["tile"])) for r in pmtiles.read_archives(packed).collect()) == [("a", 0, 0, 0, b"t0"), ("a", 1, 0, 1, b"t1"), ("b", 2, 3, 0, b"t2")]


def test_archives_by_region(spark):
    from tilewright.sources import archives

    rows = [(k // 7, 5, k, k % 3, b"t%d" % k) for k in range(40)] + [(0, 5, 3, 0, b"t3")]
    tiles = spark.createDataFrame(rows, "region long, z int, x int, y int, tile binary")
    packed = archives.pack_sqlite_by(tiles, "region", {"name": "x"})
    assert sorted(r["region"] for r in packed.collect()) == list(range(6))
    back = sorted((r["x"], r["y"], bytes(r["tile"])) for r in archives.unpack_sqlite(packed, "archive").collect())
    assert back == [(k, k % 3, b"t%d" % k) for k in range(40)]


def test_round_trips_take_every_row(spark):
    from datetime import datetime

    from tilewright.plans import features

    lines = spark.createDataFrame([(k, 1 + k % 9, k % 5, 1 + k % 3, "N", "O") for k in range(1, 120)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string")
    events = spark.createDataFrame([(k, 1, "view", 1.0, datetime(2024, 1, 1)) for k in range(6000)], "event_id long, user_id long, event_type string, value double, ts timestamp")
    tables = {"lineitem": lines, "events": events}
    assert sum(r["features"] for r in features.mvt_roundtrip_all(tables.get).collect()) == 119
    assert sum(r["tiles"] for r in features.sqlite_roundtrip_all(tables.get).collect()) == 6000


def test_etags_of_all_events(spark):
    from tilewright.plans import metrics

    rows = [(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 2, "a"), (43, 3, "c"), (44, 3, "d")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    got = sorted(map(tuple, metrics.etag_consistency_all({"events": events}.get).collect()))
    assert got == [(1, 2, False), (2, 1, True), (3, 2, False)]


def test_whole_texts_are_recoded(spark):
    import hashlib

    from tilewright.plans import features, recode

    rows = [(1, "Ab/c " + "x" * 80 + " End!", "en"), (2, "Caf\u00e9 Noir", "fr"), (3, "plain", None), (4, None, "en")]
    tables = {"documents": spark.createDataFrame(rows, "doc_id long, text string, lang string")}
    md5 = lambda t: t if t is None else hashlib.md5(t.encode()).hexdigest()
    slugs = {1: "ab--c-" + "x" * 80 + "-end", 2: "caf-noir", 3: "plain", 4: None}
    assert {r["doc_id"]: r["digest"] for r in recode.slugify_all(tables.get).collect()} == {i: md5(t) for i, t in slugs.items()}
    assert {r["doc_id"]: r["digest"] for r in features.hex_parameter_all(tables.get).collect()} == {i: md5(t if t is None else "\\x" + t.encode().hex()) for i, t, _ in rows}


def test_tiles_of_all_points(spark):
    from tilewright.plans import tiles

    tables = {"events": spark.createDataFrame([(k, 1) for k in range(2000)], "event_id long, user_id long")}
    got = [tuple(r) for r in tiles.distinct_tiles_all(tables.get).collect()]
    assert len(got) == len(set(got)) and [r for r in got if r[0] == 0] == [(0, 0, 0)] and len([r for r in got if r[0] == 10]) > 1000


def test_collections_are_read_once_as_texts(spark, tmp_path):
    from tilewright.sources import archives

    for k in range(3):
        features = ",".join('{"type":"Feature","properties":{"n":"%d","e":null},\n"geometry":%s}' % (i, "null" if i % 4 == 0 else '{"type":"Point","coordinates":[1,2]}') for i in range(400))
        (tmp_path / f"c_{k}.json").write_text('{"type":"FeatureCollection",\n"features":[' + features + "]}")
    (tmp_path / "empty.json").write_text("")
    found = archives.read_collection(spark, str(tmp_path))
    assert found.count() == 900 and found.select("geometry").distinct().collect() == [('{"type":"Point","coordinates":[1,2]}',)]
    assert {r["properties"]["n"] for r in found.collect()} == {str(i) for i in range(400) if i % 4}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "FileScan json" not in plan


def test_layer_copy_compares_the_layer_first_and_is_compiled(spark):
    from tilewright.operators import features as G

    df = spark.createDataFrame([("a", 1, {"k": "v", "s": None, "t": "w"}, [[(1.0, 2.0)]]), ("b", 2, {"k": "v"}, [[(1.0, 2.0)]]), ("a", 3, {}, [[(1.0, 2.0)]]), ("a", 4, {"k": "v"}, [[(9e9, 2.0)]])], f"layer string, fid long, props map<string,string>, geom {G.GEOMETRY}")
    got = G.layer_copy(df, "a", "c", {"k": "new", "s": None}, F.lit(4096.0))
    assert sorted((r["layer"], r["fid"], r["props"]) for r in got.collect()) == [("c", 1, {"t": "w", "k": "new"}), ("c", 3, {"k": "new"})]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_layers_of_a_style_are_taken_one_by_one():
    import json

    from tilewright.functions.style import members_of

    for style in ({}, {"layers": None}, {"layers": []}, {"a": [1, {"layers": [2]}], "layers": [{"x": 1}, {"y": [1, 2]}], "b": "]"}, {"layers": [{"q": i} for i in range(50)]}):
        for indent in (None, 2):
            assert list(members_of(json.dumps(style, indent=indent), "layers")) == (style.get("layers") or [])
    assert list(members_of('{"layers":[{"a":1}],"layers":[{"b":2},{"c":3}]} ', "layers")) == [{"b": 2}, {"c": 3}]
    for bad in ("", "[]", '{"layers":[1,]}', '{"layers":[1}', '{"a":1,}', '{"a":1} x', '{"layers":{"a":1}}'):
        with pytest.raises(ValueError):
            list(members_of(bad, "layers"))
