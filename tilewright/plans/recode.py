"""Queries on recoding, text functions, the profile and compiled expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import classes as K
from tilewright.functions import expressions as E
from tilewright.functions import text as X
from tilewright.functions import tilemath as T
from tilewright.operators.profile import apply_profile
from tilewright.plans.registry import also, query


def _case(value: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} IN ({', '.join(repr(n) for n in names)}) THEN '{to}'" for names, to in rules) + f" ELSE {default} END"


_WORDS = ["motorway", "residential", "rail", "busway", "farmland", "forest", "suburb", "city", "park", "marsh", "ice", "quarry", "living_street", "track", "unknown", "school", "state"]
_PICK = f"(list_value({', '.join(repr(w) for w in _WORDS)}))[p_partkey % {len(_WORDS)} + 1]"


def _words(read):
    return read("part").select("p_partkey", "p_size", F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % len(_WORDS) + 1).cast("int")).alias("w"))


@query(f"WITH t AS (SELECT p_partkey, {_PICK} AS w FROM part) SELECT p_partkey, {_case('w', K.PLACE, 'w')} AS place, {_case('w', K.LANDCOVER, 'w')} AS landcover, {_case('w', K.LANDUSE, 'w')} AS landuse, {_case('w', K.OVERLAY, 'w')} AS overlay FROM t")
def match_recode(read):
    w = F.col("w")
    return _words(read).select("p_partkey", *(X.choose(w, rules, w).alias(n) for n, rules in (("place", K.PLACE), ("landcover", K.LANDCOVER), ("landuse", K.LANDUSE), ("overlay", K.OVERLAY))))


_ROADS = "motorway trunk primary secondary tertiary minor service track path pedestrian steps raceway rail transit ferry cable_car gondola residential unclassified living_street busway bus_guideway motorway_junction motorway_construction minor_construction path_construction raceway_construction other".split()
_ROAD_ROWS = f"t AS (SELECT p_partkey, [{', '.join(repr(w) for w in _ROADS)}][p_partkey % {len(_ROADS)} + 1] AS c, p_size % 3 = 1 AS ramp, p_size % 5 = 0 AS ferry, CASE WHEN p_size % 2 = 0 THEN 'sub' || p_size % 4 END AS sub FROM part)"


def _roads(read):
    tags = ", ".join(f"'{w}'" for w in _ROADS)
    main = f"'class', element_at(array({tags}), CAST(p_partkey % {len(_ROADS)} + 1 AS INT)), 'ramp', CAST(CAST(p_size % 3 = 1 AS INT) AS STRING), 'brunnel', CASE WHEN p_size % 5 = 0 THEN 'ferry' ELSE 'none' END"
    return read("part").selectExpr("p_partkey", f"CASE WHEN p_size % 2 = 0 THEN map({main}, 'subclass', 'sub' || p_size % 4) ELSE map({main}) END AS props")


@query(f"""WITH {_ROAD_ROWS} SELECT p_partkey, CASE WHEN ferry THEN 'ferry' WHEN c = 'motorway' AND ramp THEN 'motorway_link' WHEN c IN ('trunk', 'primary', 'secondary', 'tertiary') AND ramp THEN 'link'
  WHEN c IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'service', 'track', 'path', 'transit', 'ferry') THEN c WHEN c IN ('pedestrian', 'steps') THEN 'path' WHEN c = 'rail' THEN 'major_rail' WHEN c IN ('cable_car', 'gondola') THEN 'aerialway' ELSE 'street' END AS road FROM t""")
def road_class(read):
    return _roads(read).select("p_partkey", E.compile_expr(K.ROAD_CLASS, F.col("props")).alias("road"))


@query(f"""WITH {_ROAD_ROWS} SELECT p_partkey, CASE WHEN c LIKE '%\\_construction' ESCAPE '\\' THEN 'construction' WHEN ramp AND c IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary') THEN c || '_link'
  WHEN c IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'service', 'track', 'path', 'transit', 'ferry', 'motorway_junction') THEN c WHEN c = 'living_street' THEN 'street_limited'
  WHEN c IN ('busway', 'bus_guideway') THEN 'primary' WHEN c = 'rail' THEN 'major_rail' ELSE 'street' END AS road,
  CASE WHEN c IN ('minor_construction', 'raceway_construction') THEN 'street' WHEN c IN ('path', 'path_construction') THEN coalesce(sub, 'path') WHEN c IN ('rail', 'transit') THEN coalesce(sub, c) ELSE replace(c, '_construction', '') END AS type FROM t""")
def road_class_v2(read):
    return _roads(read).select("p_partkey", E.compile_expr(K.ROAD_CLASS_RESTORED, F.col("props")).alias("road"), E.compile_expr(K.ROAD_TYPE, F.col("props")).alias("type"))


@query("SELECT event_id, CASE WHEN event_id % 15 < 6 THEN user_id % 12 <= 3 WHEN event_id % 15 < 10 THEN user_id % 12 <= 7 ELSE true END AS shown FROM events")
def zoom_step_filter(read):
    gate = ["<=", ["get", "rank"], ["step", ["zoom"], 3, 6, 7, 10, 99]]
    e = read("events").withColumn("props", F.create_map(F.lit("rank"), (F.col("user_id") % 12).cast("string")))
    return e.select("event_id", E.compile_filter(gate, F.col("props"), zoom=(F.col("event_id") % 15).cast("double")).alias("shown"))


_LAYER_WORDS = "waterway-river landuse-park wood-fill building-3d residential-area country-border road-casing tunnel-street bay-label cemetery grass-suburb plain Marine-Admin industrial-zone bridge-rail-outline garden".split()


@query(f"""WITH t AS (SELECT p_partkey, ['background', 'fill', 'line', 'symbol', 'raster'][p_size % 5 + 1] AS kind, lower([{', '.join(repr(w) for w in _LAYER_WORDS)}][p_partkey % {len(_LAYER_WORDS)} + 1] || ' ' || p_brand) AS k FROM part),
m AS (SELECT *, regexp_matches(k, 'water|ocean|lake|river|marine|bay') AS water, regexp_matches(k, 'park|grass|wood|forest|landcover|landuse|nature|green|garden|golf|pitch|cemetery') AS park FROM t)
SELECT p_partkey, CASE kind WHEN 'background' THEN 'land'
  WHEN 'fill' THEN CASE WHEN water THEN 'water' WHEN park AND regexp_matches(k, 'wood|forest') THEN 'park-dark' WHEN park THEN 'park' WHEN contains(k, 'building') THEN 'building' WHEN regexp_matches(k, 'residential|suburb|neighbourhood|industrial|commercial') THEN 'land-soft' ELSE 'land' END
  WHEN 'line' THEN CASE WHEN regexp_matches(k, 'boundary|admin|border') THEN 'boundary' WHEN water THEN 'water-deep'
    WHEN regexp_matches(k, 'road|street|transport|motorway|trunk|primary|secondary|tertiary|minor|path|bridge|tunnel|rail') THEN CASE WHEN regexp_matches(k, 'case|casing|outline') THEN 'road-casing' ELSE 'road' END END
  WHEN 'symbol' THEN CASE WHEN water THEN 'water-text' WHEN park THEN 'park-text' ELSE 'text' END END AS class, water FROM m""")
def regex_priority_class(read):
    words = ", ".join(f"'{w}'" for w in _LAYER_WORDS)
    p = read("part").selectExpr("p_partkey", "element_at(array('background', 'fill', 'line', 'symbol', 'raster'), p_size % 5 + 1) AS kind", f"element_at(array({words}), CAST(p_partkey % {len(_LAYER_WORDS)} + 1 AS INT)) AS id", "p_brand")
    return p.select("p_partkey", X.text_class(F.col("kind"), F.col("id"), F.col("p_brand")).alias("class"), X.shows_water(F.array("id", "p_brand")).alias("water"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '2' WHEN 1 THEN '4' WHEN 2 THEN '6' ELSE '3' END AS admin_level, p_size % 4 = 1 AS hit FROM part")
def domain_recode(read):
    level = (F.col("p_size") % 4).cast("string")
    renamed = F.create_map(*(F.lit(x) for pair in K.ADMIN_LEVEL.items() for x in pair))
    now = F.coalesce(F.try_element_at(renamed, level), level)
    # a filter written for the old coding, recoded, over properties in the new one
    old = E.recode(E.normalize(["==", "admin_level", "1"]), "admin_level", K.ADMIN_LEVEL)
    p = read("part").withColumn("props", F.create_map(F.lit("admin_level"), now))
    return p.select("p_partkey", F.col("props")["admin_level"].alias("admin_level"), E.compile_filter(old, F.col("props")).alias("hit"))


_FONTS = ["DIN Pro Bold", "DIN Pro Bold Italic", "DIN Pro Medium", "DIN Pro Semibold Italic", "DIN Pro Italic", "DIN Pro Regular", "Arial Unicode MS Bold", "Arial Unicode MS Italic", "Arial Unicode MS Regular", "Noto Sans Semibold", "Noto Sans semibold italic", "Noto Sans CJK", "Roboto Bold"]
_FONT_ROWS = f"f AS (SELECT p_partkey, [{', '.join(repr(w) for w in _FONTS)}][p_partkey % {len(_FONTS)} + 1] || CASE WHEN p_size % 4 = 0 THEN ' ' || p_type ELSE '' END AS name FROM part)"


def _fonts(read):
    words = ", ".join(f"'{w}'" for w in _FONTS)
    return read("part").selectExpr("p_partkey", f"element_at(array({words}), CAST(p_partkey % {len(_FONTS)} + 1 AS INT)) || CASE WHEN p_size % 4 = 0 THEN ' ' || p_type ELSE '' END AS name")


@query(f"""WITH {_FONT_ROWS}, b AS (SELECT *, name ILIKE '%bold%' AS bold, name ILIKE '%italic%' AS italic, starts_with(name, 'DIN Pro') OR starts_with(name, 'Arial Unicode MS') OR starts_with(name, 'Noto Sans') AS known FROM f)
SELECT p_partkey, CASE WHEN NOT known THEN name WHEN bold AND italic THEN 'Open Sans Semibold Italic' WHEN bold THEN 'Open Sans Semibold' WHEN italic THEN 'Open Sans Italic' ELSE 'Open Sans Regular' END AS font,
  CASE name WHEN 'DIN Pro Regular' THEN 'Open Sans Regular' WHEN 'DIN Pro Medium' THEN 'Open Sans Semibold' WHEN 'DIN Pro Bold' THEN 'Open Sans Bold' WHEN 'DIN Pro Italic' THEN 'Open Sans Italic' WHEN 'Arial Unicode MS Regular' THEN 'Open Sans Regular' ELSE name END AS exact,
  CASE name WHEN 'DIN Pro Regular' THEN 'Open Sans Regular' WHEN 'DIN Pro Medium' THEN 'Open Sans Regular' WHEN 'DIN Pro Bold' THEN 'Open Sans Semibold' WHEN 'DIN Pro Italic' THEN 'Open Sans Italic' WHEN 'Arial Unicode MS Regular' THEN 'Noto Sans Regular' WHEN 'Arial Unicode MS Bold' THEN 'Noto Sans Semibold' ELSE name END AS restored FROM b""")
def case_regex_map(read):
    name = F.col("name")
    return _fonts(read).select("p_partkey", X.font_family(name).alias("font"), X.looked_up(name, X.FONT_MAP).alias("exact"), X.looked_up(name, X.FONT_MAP_RESTORED).alias("restored"))


@query("SELECT doc_id, regexp_matches(text, '(?i)licen[cs]e|password|token') AS leaks, len(regexp_extract_all(text, '(?i)licen[cs]e|password|token')) AS n FROM documents")
def term_scan(read):
    pattern = "(?i)licen[cs]e|password|token"
    return read("documents").select("doc_id", F.col("text").rlike(pattern).alias("leaks"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("n"))


_HSL = """h AS (SELECT p_partkey, CAST(p_partkey % 360 AS DOUBLE) AS h, (p_size % 11) / 10.0 AS s, (p_partkey % 101) / 100.0 AS l FROM part),
c AS (SELECT *, h / 60 AS q, (1 - abs(2 * l - 1)) * s AS c FROM h), x AS (SELECT *, c * (1 - abs(q % 2 - 1)) AS x, l - c / 2 AS m, CAST(floor(q) AS INT) + 1 AS k FROM c),
b AS (SELECT p_partkey, [[c, x, 0, 0, x, c][k] + m, [x, c, c, x, 0, 0][k] + m, [0, 0, x, c, c, x][k] + m] AS v FROM x)"""


@query(f"WITH {_HSL} SELECT p_partkey, '#' || array_to_string(list_transform(v, lambda e: printf('%02X', CAST(floor(least(greatest(e * 255, 0), 255) + 0.5) AS INT))), '') AS color FROM b")
def hsl_to_hex(read):
    return read("part").select("p_partkey", X.hsl_to_hex((F.col("p_partkey") % 360).cast("double"), F.col("p_size") % 11 / 10.0, F.col("p_partkey") % 101 / 100.0).alias("color"))


# colours in eleven notations, with channels of the part's size and key
@query("""WITH c AS (SELECT p_partkey, p_partkey % 11 AS k, p_size * 7 - 60 AS n, p_size AS s, p_partkey % 256 AS b FROM part),
h AS (SELECT *, printf('%02X', CAST(least(greatest(n, 0), 255) AS INT)) AS red, printf('%02X', CAST(b AS INT)) AS blue, printf('%02X', CAST(floor(least(s * 2, 100) / 100.0 * 255 + 0.5) AS INT)) AS a FROM c)
SELECT p_partkey, CASE k WHEN 0 THEN '#' || repeat(substr(blue, 1, 1), 2) || 'BBCC' WHEN 1 THEN '#' || red || '14' || blue WHEN 2 THEN '#' || red || '14' || blue || CASE WHEN s < 50 THEN a ELSE '' END
  WHEN 3 THEN '#00000000' WHEN 4 THEN '#FFFFFF' WHEN 5 THEN '#000000' WHEN 6 THEN 'navy' WHEN 7 THEN '#' || repeat(substr(blue, 2, 1), 2) || '112233' WHEN 8 THEN '#' || printf('%02X', CAST(floor(b % 101 / 100.0 * 255 + 0.5) AS INT)) || 'FF00'
  WHEN 9 THEN '#' || repeat(printf('%02X', CAST(floor(least(s * 3, 100) / 100.0 * 255 + 0.5) AS INT)), 3) ELSE 'rgb(a, b, c)' END AS color FROM h""")
def color_dispatch(read):
    text = """CASE p_partkey % 11 WHEN 0 THEN lower('#' || substr(lpad(hex(p_partkey % 256), 2, '0'), 1, 1) || 'bc') WHEN 1 THEN 'rgb(' || (p_size * 7 - 60) || ', 20,' || p_partkey % 256 || ')'
      WHEN 2 THEN ' RGBA( ' || (p_size * 7 - 60) || ' , 20 , ' || p_partkey % 256 || ', ' || p_size * 2 || '% ) ' WHEN 3 THEN 'Transparent' WHEN 4 THEN ' white ' WHEN 5 THEN 'BLACK' WHEN 6 THEN 'navy'
      WHEN 7 THEN '#' || substr(lpad(hex(p_partkey % 256), 2, '0'), 2, 1) || '123' WHEN 8 THEN 'rgb(' || p_partkey % 256 % 101 || '%, 300%, -5)' WHEN 9 THEN 'hsl(' || (p_partkey % 1000 - 400) || ', 0%, ' || p_size * 3 || '%)' ELSE 'rgb(a, b, c)' END"""
    return read("part").select("p_partkey", X.color_to_hex(F.expr(text)).alias("color"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 5 WHEN event_id % 7 = 1 THEN 5 WHEN event_id % 100 BETWEEN 1 AND 64 THEN event_id % 100 ELSE 5 END AS v FROM events")
def bounded_integer(read):
    i = F.col("event_id")
    raw = F.when(i % 7 == 0, F.lit("many")).when(i % 7 == 1, F.concat((i % 100).cast("string"), F.lit(".5"))).otherwise((i % 100).cast("string"))
    return read("events").select("event_id", T.bounded_integer(raw, 5, 1, 64).alias("v"))


@query("WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(lower(text), '/', '--'), '[^a-z0-9-]+', '-', 'g'), '-{3,}', '--', 'g'), '^-|-$', '', 'g') AS slug FROM documents) SELECT doc_id, length(slug) AS n, md5(slug) AS digest FROM s")
def slugify_all(read):
    """Slugs of whole texts, as length and digest."""
    s = read("documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))
    return s.select("doc_id", F.length("slug").cast("long").alias("n"), F.md5("slug").alias("digest"))


@query("SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) IN ('http', 'https') AND NOT contains(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '@') AND regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) <> '' THEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) END AS origin FROM pages")
def safe_origin(read):
    return read("pages").select("page_id", X.safe_origin(F.col("url")).alias("origin"))


@query("""WITH h AS (SELECT event_id, event_id % 90 AS a, event_id % 70 + 10 AS b, event_id % 4 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN CASE WHEN a < 64 AND a <= least(b, 63) THEN a END WHEN 1 THEN CASE WHEN a < 64 THEN a END WHEN 2 THEN greatest(64 - b, 0) END AS start,
CASE k WHEN 0 THEN CASE WHEN a < 64 AND a <= least(b, 63) THEN least(b, 63) END WHEN 1 THEN CASE WHEN a < 64 THEN 63 END WHEN 2 THEN 63 END AS stop FROM h""")
def byte_range(read):
    i = F.col("event_id")
    a, b = (i % 90).cast("string"), (i % 70 + 10).cast("string")
    header = F.when(i % 4 == 0, F.concat(F.lit("bytes="), a, F.lit("-"), b)).when(i % 4 == 1, F.concat(F.lit("bytes="), a, F.lit("-"))).when(i % 4 == 2, F.concat(F.lit("bytes=-"), b)).otherwise(F.lit("bytes=1-2,4-5"))
    r = X.byte_range(header, F.lit(64).cast("long"))
    return read("events").select("event_id", r["start"].alias("start"), r["stop"].alias("stop"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(event_id % 16 AS INT) END AS z, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS INT) END AS x, CASE WHEN event_id % 3 < 2 THEN CAST(user_id AS INT) END AS y FROM events")
def parse_tile_path(read):
    i = F.col("event_id")
    path = F.concat(F.lit("/tiles/"), (i % 16).cast("string"), F.lit("/"), i.cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.when(i % 3 < 2, ".pbf").otherwise(".png"))
    t = X.tile_path(path)
    return read("events").select("event_id", *(t[c].alias(c) for c in "zxy"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, 'license')) = 2 THEN strlen(replace(text, 'license', 'LICENCE!')) END AS bytes FROM documents")
def exactly_one_replace(read):
    return read("documents").select("doc_id", F.octet_length(X.replace_once(F.col("text"), "license", "LICENCE!")).cast("long").alias("bytes"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN list_distinct_ordered ELSE w END AS fonts FROM (SELECT p_partkey, p_size, string_split(p_type, ' ') || string_split(p_type, ' ') AS w, string_split(p_type, ' ') AS list_distinct_ordered FROM part)")
def array_dedupe(read):
    w = F.split("p_type", " ")
    return read("part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.array_distinct(F.concat(w, w))).otherwise(F.concat(w, w)).alias("fonts"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'name:zh-Hans' WHEN 1 THEN 'name:en' WHEN 2 THEN 'class' ELSE 'name' END AS k, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/x-protobuf' WHEN 2 THEN 'text/html; charset=utf-8' ELSE 'application/octet-stream' END AS type, page_id % 4 IN (0, 1) AS gzip FROM pages")
def header_functions(read):
    i = F.col("page_id") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    return read("pages").select("page_id", X.language_key(pick("name_zh_Hans", "name_en", "class", "name")).alias("k"), X.content_type(pick("a/b.PNG", "x.pbf", "i.html", "noending")).alias("type"), X.accepts_gzip(pick("br, gzip", "GZIP", "gzipped", "deflate")).alias("gzip"))


# elements whose tags come from parts: a main tag by the part's key, others by its size
_MAIN = {
    "natural": "wood scrub heath grassland fell glacier sand beach wetland water peak volcano",
    "landuse": "forest meadow farmland orchard vineyard grass residential commercial industrial retail cemetery recreation_ground quarry farmyard",
    "leisure": "garden playground golf_course pitch park nature_reserve",
    "boundary": "national_park protected_area administrative",
    "waterway": "riverbank dock river canal stream drain ditch",
    "highway": "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential living_street service track pedestrian path footway cycleway steps",
    "railway": "rail narrow_gauge light_rail subway tram monorail", "route": "ferry", "aerialway": "cable_car gondola t-bar", "building": "yes house", "aeroway": "runway taxiway aerodrome helipad heliport",
    "place": "continent country state region city town village suburb neighbourhood hamlet", "amenity": "cafe", "tourism": "hotel", "addr:housenumber": "12", "shop": "bakery",
}
_TAGS = [(k, v) for k, values in _MAIN.items() for v in values.split()]


def _elements(read):
    main = f"element_at(array({', '.join(f"struct('{a}' AS k, '{b}' AS v)" for a, b in _TAGS)}), CAST(p_partkey % {len(_TAGS)} + 1 AS INT))"
    more = {
        "name": "CASE WHEN p_partkey % 5 < 3 THEN 'n' || p_partkey END", "name:en": "CASE WHEN p_size % 2 = 1 THEN 'e' || p_partkey END", "ref": "CASE WHEN p_size % 7 = 0 THEN 'A' || p_size END", "admin_level": "CAST(p_size % 9 AS STRING)",
        "disputed": "CASE WHEN p_size % 4 = 0 THEN 'yes' END", "maritime": "CASE WHEN p_size % 5 = 0 THEN 'yes' ELSE 'no' END", "water": "CASE WHEN p_size % 3 = 0 THEN 'pond' END", "population": "CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 100 AS STRING) ELSE 'many' END",
        "height": "p_size || '.5'", "min_height": "CASE WHEN p_size % 3 = 1 THEN 'low' ELSE '2' END", "ele": "p_size || '.25'", "location": "CASE WHEN p_size % 7 = 0 THEN 'underground' END",
        "bridge": "CASE p_size % 4 WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END", "tunnel": "CASE p_size % 6 WHEN 1 THEN 'culvert' WHEN 2 THEN 'yes' END", "surface": "CASE WHEN p_size % 3 = 2 THEN 'asphalt' END", "iata": "CASE WHEN p_size % 2 = 0 THEN 'IAT' END",
    }
    pairs = ", ".join(f"struct('{key}' AS k, {v} AS v)" for key, v in more.items())
    return read("part").selectExpr("p_partkey AS osm_id", f"element_at(array('point', 'line', 'polygon'), CAST(p_partkey DIV {len(_TAGS)} % 3 + 1 AS INT)) AS geom_kind", f"map_from_entries(filter(array({main}, {pairs}), x -> x.v IS NOT NULL)) AS tags")


# the rules once more, for SQL: number, layer, least zoom, kinds of elements, main tag, its values (* any), what else it needs
_PROFILE_SQL = """
  (1, 'landcover', 3, 'polygon', 'natural', 'wood scrub heath grassland fell glacier sand beach wetland', ''), (2, 'landcover', 3, 'polygon', 'landuse', 'forest meadow farmland orchard vineyard grass', ''),
  (3, 'landuse', 6, 'polygon', 'landuse', 'residential commercial industrial retail cemetery recreation_ground quarry farmland farmyard', ''), (4, 'landuse', 7, 'polygon', 'leisure', 'garden playground golf_course pitch', ''),
  (5, 'park', 5, 'polygon', 'boundary', 'national_park protected_area', ''), (6, 'park', 7, 'polygon', 'leisure', 'park nature_reserve', ''),
  (7, 'water', 4, 'polygon', 'natural', 'water', ''), (8, 'water', 5, 'polygon', 'waterway', 'riverbank dock', ''),
  (9, 'waterway', 6, 'line', 'waterway', 'river', ''), (10, 'waterway', 8, 'line', 'waterway', 'canal', ''), (11, 'waterway', 10, 'line', 'waterway', 'stream drain ditch', ''),
  (12, 'transportation', 4, 'line', 'highway', 'motorway motorway_link', ''), (13, 'transportation', 4, 'line', 'highway', 'trunk trunk_link', ''), (14, 'transportation', 6, 'line', 'highway', 'primary primary_link', ''),
  (15, 'transportation', 8, 'line', 'highway', 'secondary secondary_link', ''), (16, 'transportation', 9, 'line', 'highway', 'tertiary tertiary_link', ''), (17, 'transportation', 11, 'line', 'highway', 'unclassified residential living_street', ''),
  (18, 'transportation', 12, 'line', 'highway', 'service', ''), (19, 'transportation', 12, 'line', 'highway', 'track', ''), (20, 'transportation', 12, 'line', 'highway', 'pedestrian', ''),
  (21, 'transportation', 13, 'line', 'highway', 'path footway cycleway', ''), (22, 'transportation', 13, 'line', 'highway', 'steps', ''), (23, 'transportation', 8, 'line', 'railway', 'rail narrow_gauge', ''),
  (24, 'transportation', 9, 'line', 'railway', 'light_rail subway tram monorail', ''), (25, 'transportation', 7, 'line', 'route', 'ferry', ''), (26, 'transportation', 10, 'line', 'aerialway', 'cable_car gondola chair_lift drag_lift platter t-bar rope_tow', ''),
  (27, 'transportation_name', 7, 'line', 'highway', 'motorway trunk', 'name or ref'), (28, 'transportation_name', 8, 'line', 'highway', 'primary', 'name or ref'), (29, 'transportation_name', 10, 'line', 'highway', 'secondary tertiary', 'name or ref'),
  (30, 'transportation_name', 12, 'line', 'highway', 'unclassified residential', 'name'), (31, 'building', 13, 'polygon', 'building', '*', ''), (32, 'aeroway', 9, 'line', 'aeroway', 'runway taxiway', ''),
  (33, 'aeroway', 10, 'polygon', 'aeroway', 'aerodrome runway taxiway helipad', ''), (34, 'aerodrome_label', 8, 'point polygon', 'aeroway', 'aerodrome heliport', ''),
  (35, 'boundary', 0, 'line', 'boundary', 'administrative', '2'), (36, 'boundary', 3, 'line', 'boundary', 'administrative', '4'), (37, 'boundary', 6, 'line', 'boundary', 'administrative', '5 6'), (38, 'boundary', 8, 'line', 'boundary', 'administrative', '7 8'),
  (39, 'place', 0, 'point', 'place', 'continent', ''), (40, 'place', 2, 'point', 'place', 'country', ''), (41, 'place', 3, 'point', 'place', 'state', ''), (42, 'place', 4, 'point', 'place', 'region', ''), (43, 'place', 5, 'point', 'place', 'city', ''),
  (44, 'place', 7, 'point', 'place', 'town', ''), (45, 'place', 9, 'point', 'place', 'village', ''), (46, 'place', 10, 'point', 'place', 'suburb neighbourhood hamlet', ''),
  (47, 'poi', 11, 'point', 'amenity', '*', ''), (48, 'poi', 12, 'polygon', 'amenity', '*', ''), (49, 'poi', 11, 'point', 'tourism', '*', ''), (50, 'poi', 12, 'polygon', 'tourism', '*', ''),
  (51, 'water_name', 5, 'polygon', 'natural', 'water', 'name'), (52, 'water_name', 6, 'line', 'waterway', 'river canal stream', 'name'), (53, 'mountain_peak', 8, 'point', 'natural', 'peak volcano', ''),
  (54, 'housenumber', 16, 'point', 'addr:housenumber', '*', ''), (55, 'housenumber', 16, 'polygon', 'addr:housenumber', '*', '')"""


@query(f"""WITH tags(nr, k, v) AS (VALUES {", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_TAGS))}),
e AS (SELECT p_partkey AS id, p_size AS n, k, v, ['point', 'line', 'polygon'][p_partkey // {len(_TAGS)} % 3 + 1] AS g, CASE WHEN p_partkey % 5 < 3 THEN 'n' || p_partkey END AS name, CASE WHEN p_size % 7 = 0 THEN 'A' || p_size END AS ref FROM part JOIN tags ON p_partkey % {len(_TAGS)} = nr),
r(rule, layer, least, kinds, key, vals, needs) AS (VALUES {_PROFILE_SQL}),
h AS (SELECT * FROM e JOIN r ON k = key AND list_contains(string_split(kinds, ' '), g) AND (vals = '*' OR list_contains(string_split(vals, ' '), v))
  AND (needs = '' OR needs = 'name' AND name IS NOT NULL OR needs = 'name or ref' AND (name IS NOT NULL OR ref IS NOT NULL) OR layer = 'boundary' AND list_contains(string_split(needs, ' '), CAST(n % 9 AS VARCHAR)))),
a AS (SELECT *, CASE
    WHEN rule = 1 THEN CASE WHEN v = 'wood' THEN 'wood' WHEN v IN ('scrub', 'heath') THEN 'scrub' WHEN v = 'glacier' THEN 'ice' WHEN v IN ('sand', 'beach') THEN 'sand' WHEN v = 'wetland' THEN 'wetland' ELSE 'grass' END
    WHEN rule = 2 THEN CASE WHEN v = 'forest' THEN 'wood' WHEN v IN ('farmland', 'orchard', 'vineyard') THEN 'farmland' ELSE 'grass' END
    WHEN rule IN (7, 51) THEN CASE WHEN n % 3 = 0 THEN 'pond' ELSE 'lake' END
    WHEN rule BETWEEN 12 AND 16 THEN replace(v, '_link', '') WHEN rule IN (17, 30) THEN 'minor' WHEN rule = 21 THEN 'path' WHEN rule = 23 THEN 'rail' WHEN rule = 24 THEN 'transit' WHEN rule = 26 THEN 'aerialway' WHEN rule < 54 AND layer <> 'boundary' THEN v END AS class,
  CASE WHEN rule IN (25, 26) THEN 'none' WHEN rule BETWEEN 12 AND 30 THEN CASE WHEN n % 4 = 1 THEN 'bridge' WHEN n % 6 IN (1, 2) THEN 'tunnel' ELSE 'none' END END AS brunnel FROM h)
SELECT id AS osm_id, CAST(rule AS INT) AS rule, layer, CAST(least AS INT) AS min_zoom, array_to_string(list_sort(list_filter([
  'class=' || class, 'brunnel=' || brunnel, CASE WHEN layer = 'transportation' OR layer = 'poi' THEN 'subclass=' || v END,
  CASE WHEN rule BETWEEN 12 AND 22 THEN 'ramp=' || CASE WHEN contains(v, '_link') THEN '1' ELSE '0' END END,
  CASE WHEN rule BETWEEN 12 AND 21 AND n % 3 = 2 THEN 'surface=asphalt' END, CASE WHEN rule BETWEEN 12 AND 17 OR layer = 'transportation_name' THEN 'ref=' || ref END,
  CASE WHEN layer NOT IN ('landcover', 'building', 'housenumber') AND rule <> 32 THEN 'name=' || name END, CASE WHEN layer = 'aeroway' THEN 'type=' || v END,
  CASE WHEN layer = 'building' THEN 'render_height=' || n || '.5' END, CASE WHEN layer = 'building' AND n % 3 <> 1 THEN 'render_min_height=2.0' END, CASE WHEN layer = 'building' THEN 'underground=' || (n % 7 = 0) END,
  CASE WHEN layer = 'aerodrome_label' AND n % 2 = 0 THEN 'iata=IAT' END, CASE WHEN layer = 'boundary' THEN 'admin_level=' || (n % 9) END, CASE WHEN layer = 'boundary' THEN 'disputed=' || CAST(n % 4 = 0 AS INT) END,
  CASE WHEN layer = 'boundary' THEN 'maritime=' || CAST(n % 5 = 0 AS INT) END, CASE WHEN layer = 'place' THEN 'name:latin=' || CASE WHEN n % 2 = 1 THEN 'e' || id ELSE name END END,
  CASE WHEN layer = 'place' AND rule < 46 AND n % 2 = 0 THEN 'population=' || n * 100 END, CASE WHEN layer = 'place' THEN 'rank=' || greatest(rule - 39, 1) END,
  CASE WHEN layer = 'mountain_peak' THEN 'ele=' || n || '.25' END, CASE WHEN layer = 'housenumber' THEN 'housenumber=' || v END], lambda x: x IS NOT NULL)), ';') AS attrs FROM a""")
def profile_union(read):
    pairs = F.sort_array(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return apply_profile(_elements(read)).select("osm_id", "rule", "layer", "min_zoom", F.concat_ws(";", pairs).alias("attrs"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag IN ('A', 'R') AND l_quantity >= 10 AND NOT (l_linestatus = 'F' AND l_linenumber > 4)) AS hit,
CAST(sum(CASE WHEN l_quantity <= 10 THEN 100 WHEN l_quantity <= 30 THEN CAST(floor((1.0 + 2.0 * (l_quantity - 10) / 20) * 100 + 0.5) AS BIGINT) ELSE 300 END) AS BIGINT) AS width FROM lineitem GROUP BY 1, 2""")
def expr_compiled_filter(read):
    rule = ["all", ["in", "flag", "A", "R"], [">=", "quantity", 10], ["none", ["all", ["==", "status", "F"], [">", "line", 4]]]]
    width = ["interpolate", ["linear"], ["get", "quantity"], 10, 1, 30, 3]
    props = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("quantity"), F.col("l_quantity").cast("string"), F.lit("status"), F.col("l_linestatus"), F.lit("line"), F.col("l_linenumber").cast("string"))
    li = read("lineitem").withColumn("props", props)
    w = F.floor(E.compile_expr(width, F.col("props")) * 100 + 0.5).cast("long")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(E.compile_filter(rule, F.col("props"))).alias("hit"), F.sum(w).alias("width"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'n' || p_partkey ELSE 'US' END AS v, p_size % 2 = 0 AS has FROM part")
def expr_rewrite(read):
    renamed = E.rewrite(["case", ["has", "house_num"], ["get", "house_num"], ["get", "worldview"]], {"house_num": "housenumber", "worldview": ["literal", "US"]})
    props = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("housenumber"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    p = read("part").withColumn("props", props)
    return p.select("p_partkey", E.compile_expr(renamed, F.col("props")).alias("v"), E.compile_filter(["has", "housenumber"], F.col("props")).alias("has"))


# small functions of names, requests and failures


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tiles-' || lower(replace(p_brand, '#', '-')) || '.pmtiles' WHEN 1 THEN 'tiles-' || p_brand || '.pmtiles' WHEN 2 THEN 'tiles-.pmtiles' ELSE 'other-a.pmtiles' END AS name, p_brand, p_size FROM part)
SELECT p_partkey, regexp_matches(name, '^tiles-[a-z0-9-]+\\.pmtiles$') AS valid, 'tiles-' || p_size || '.pmtiles' AS asset_name, 'tiles-' || p_size || '.json' AS metadata_name, CASE WHEN p_partkey % 3 = 0 THEN 'made' ELSE 'r:' || p_size END AS request, p_size % 9 <= 6 AS cached FROM t""")
def asset_names(read):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'tiles-' || lower(replace(p_brand, '#', '-')) || '.pmtiles' WHEN 1 THEN 'tiles-' || p_brand || '.pmtiles' WHEN 2 THEN 'tiles-.pmtiles' ELSE 'other-a.pmtiles' END")
    own = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'r ' || p_size WHEN 1 THEN ' r:' || p_size || ' ' ELSE 'r:' || p_size END")
    made = X.asset_names(F.col("p_size").cast("string"), "tiles")
    return read("part").select("p_partkey", X.asset_valid(name, "tiles").alias("valid"), made["asset_name"].alias("asset_name"), made["metadata_name"].alias("metadata_name"), X.request_id(own, F.lit("made")).alias("request"), X.cacheable(F.col("p_size") % 9).alias("cached"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'postgres://u:p@db' || c_nationkey || '.host.org/name' WHEN 1 THEN 'postgresql://u@h:5432/x' END AS url,
CASE c_custkey % 5 WHEN 0 THEN 'https://api.host.org/sql' WHEN 3 THEN 'https://api.b/sql' END AS endpoint FROM customer""")
def database_urls(read):
    raw = F.expr("CASE c_custkey % 5 WHEN 0 THEN ' postgres://u:p@db' || c_nationkey || '.host.org/name' WHEN 1 THEN 'postgresql://u@h:5432/x' WHEN 2 THEN 'postgres://h/x' WHEN 3 THEN 'mysql://u@a.b/x' ELSE 'postgres://u@h/' END")
    return read("customer").select("c_custkey", X.database_url(raw).alias("url"), X.sql_endpoint(F.trim(raw)).alias("endpoint"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 200 WHEN 3 THEN 400 WHEN 4 THEN 400 ELSE 403 END AS status, CASE event_type WHEN 'click' THEN 503 WHEN 'view' THEN 404 WHEN 'error' THEN CAST(400 + user_id % 100 AS INT) WHEN 'signup' THEN 503 ELSE 500 END AS error,
event_id % 3 = 0 OR event_id % 5 = 0 AS expected, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN CASE WHEN user_id > 1 THEN user_id END END AS size, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM events""")
def request_functions(read):
    path = F.expr("CASE event_id % 6 WHEN 0 THEN '/a/' || user_id WHEN 1 THEN '/../etc' WHEN 2 THEN '/a/../b%20c' WHEN 3 THEN '/a%00b' WHEN 4 THEN '/a%zz' ELSE '/a/%2e%2e/../x' END")
    kind = F.expr("CASE event_type WHEN 'click' THEN 'overloaded' WHEN 'view' THEN 'range' ELSE 'other' END")
    error = X.error_status(kind, F.expr("CASE WHEN event_type = 'error' THEN CAST(400 + user_id % 100 AS INT) END"), F.expr("CASE WHEN event_type = 'signup' THEN 'TILES_X' ELSE 'E' END"), "TILES_")
    expected = X.expected_failure(F.expr("CASE WHEN event_id % 3 = 0 THEN 'http://h/FAVICON.ico?x' ELSE 'http://h/favicon.icon' END"), F.expr("CASE WHEN event_id % 5 = 0 THEN 'net::ERR_ABORTED' END"))
    size = X.remote_size(F.expr("CASE WHEN event_id % 3 = 0 THEN 'bytes 0-0/' || event_id END"), F.expr("CASE WHEN event_id % 3 = 1 THEN CAST(user_id AS STRING) ELSE 'x' END"))
    return read("events").select("event_id", X.path_status(path).alias("status"), error.alias("error"), expected.alias("expected"), size.alias("size"), X.encoded_parameter(F.col("ts").cast("timestamp"), "timestamp").alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN least(o_custkey % 24, 5) ELSE 5 END AS minzoom, sqrt(pow(o_orderkey % 7, 2) + pow(o_custkey % 5, 2)) AS miss, 'https://h.org/' || o_orderkey || '/{z}' AS template, o_orderstatus <> 'P' AS shown FROM orders")
def layer_functions(read):
    z, k, c = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 24 END"), F.col("o_orderkey"), F.col("o_custkey")
    kind = F.expr("CASE o_orderstatus WHEN 'P' THEN 'sky' WHEN 'F' THEN 'fill' ELSE 'line' END")
    template = F.concat(F.lit("__ORIGIN__/"), k.cast("string"), F.lit("/{z}"))
    return read("orders").select("o_orderkey", T.entered_by(z, 5).alias("minzoom"), F.hypot((k % 7).cast("double"), (c % 5).cast("double")).alias("miss"), F.replace(template, F.lit("__ORIGIN__"), F.lit("https://h.org")).alias("template"), (~kind.isin(T.UNDRAWN)).alias("shown"))


# types of parts with accents and capitals
_ACCENTED = "names AS (SELECT p_partkey AS part, p_brand AS brand, CASE p_size % 3 WHEN 0 THEN translate(lower(p_type), 'aeo', 'áéö') WHEN 1 THEN lower(p_type) ELSE upper(p_type) END AS name FROM part)"


def _accented(read):
    low = F.lower("p_type")
    return read("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 3 == 0, F.translate(low, "aeo", "áéö")).when(F.col("p_size") % 3 == 1, low).otherwise(F.upper("p_type")).alias("name"))


@query(f"WITH {_ACCENTED} SELECT part, brand, name, row_number() OVER (PARTITION BY brand ORDER BY name COLLATE de, part) AS place FROM names")
def locale_order(read):
    """Names in the order of a locale, in which accents and case come after letters."""
    from pyspark.sql import Window

    return _accented(read).withColumn("place", F.row_number().over(Window.partitionBy("brand").orderBy(X.by_locale(F.col("name")), "part")))


@query(f"""WITH {_ACCENTED}, g AS (SELECT lower(strip_accents(name)) AS k, min(part) AS first, count(*) AS n FROM names GROUP BY 1)
SELECT part, first, n FROM names JOIN g ON g.k = lower(strip_accents(name))""")
def locale_groups(read):
    """Names that differ in case and accents alone, grouped and joined under one collation."""
    names = _accented(read).select("part", X.alike(F.col("name")).alias("name"))
    groups = names.groupBy("name").agg(F.min("part").alias("first"), F.count("*").alias("n"))
    return names.join(groups, "name").select("part", "first", "n")


also("slugify", "slugify_all")
