"""Queries on styles: layers derived from parts and orders, one a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import style as S
from tilewright.plans.registry import query

_SOURCES = [*S.TARGETS, "landuse_overlay", "natural_label", "contour", "hillshade", "unknown"]
_LIST = ", ".join(f"'{s}'" for s in _SOURCES)
# a third of the layers are symbols; every eleventh has no source
_ROWS = f"""l AS (SELECT p_partkey, [{_LIST}][p_partkey % {len(_SOURCES)} + 1] AS s, p_size % 3 = 0 AS symbol, p_partkey % 11 = 0 AS own, ['river-x', 'peak', 'Park', 'plain'][p_size % 4 + 1] AS id FROM part)"""


def _layers(read):
    kind = "CASE WHEN p_size % 3 = 0 THEN 'symbol' WHEN p_size % 3 = 1 THEN 'fill' ELSE 'line' END"
    layer = f"element_at(array({_LIST}), CAST(p_partkey % {len(_SOURCES)} + 1 AS INT))"
    texts = """CASE p_size % 3 WHEN 0 THEN '["==", ["get", "class"], "x"]' WHEN 1 THEN '["has", "name_zh_Hans"]' ELSE '["all", ["==", ["get", "admin_level"], 1], ["==", ["get", "maritime"], "true"]]' END"""
    return read("part").selectExpr("p_brand AS style", "CAST(p_partkey AS INT) AS place", "element_at(array('river-x', 'peak', 'Park', 'plain'), p_size % 4 + 1) AS id", f"{kind} AS type", "CASE WHEN p_partkey % 11 <> 0 THEN 'old' END AS source", f"{layer} AS source_layer",
                                   "CAST(NULL AS DOUBLE) AS minzoom", "CAST(NULL AS DOUBLE) AS maxzoom", f"{texts} AS filter", """'{"text-field": ["get", "house_num"], "size": ["get", "reflen"]}' AS layout""",
                                   """'{"fill-color": ["case", ["has", "extrude"], "rgb(' || p_size || ', 0, 255)", " white "], "x": "navy"}' AS paint""")  # fmt: skip


_TARGET_SQL = """CASE WHEN own OR s IN ('contour', 'hillshade', 'unknown') THEN NULL WHEN s = 'landuse_overlay' THEN CASE WHEN id = 'Park' THEN 'park' ELSE 'landuse' END
  WHEN s = 'natural_label' THEN CASE id WHEN 'river-x' THEN 'water_name' WHEN 'peak' THEN 'mountain_peak' ELSE 'place' END
  WHEN s IN ('waterway', 'water') AND symbol THEN 'water_name' WHEN s IN ('structure', 'road') THEN CASE WHEN symbol THEN 'transportation_name' ELSE 'transportation' END WHEN s = 'motorway_junction' THEN 'transportation_name'
  WHEN s = 'aeroway' AND symbol OR s = 'airport_label' THEN 'aerodrome_label' WHEN s = 'admin' THEN 'boundary' WHEN s = 'housenum_label' THEN 'housenumber' WHEN s = 'place_label' THEN 'place' WHEN s IN ('poi_label', 'transit_stop_label') THEN 'poi' ELSE s END"""
_REASON_SQL = "CASE WHEN own OR target IS NOT NULL THEN NULL WHEN s = 'hillshade' THEN 'replaced by open raster DEM hillshade' WHEN s = 'contour' THEN 'no equivalent contour layer in the public vector schema' ELSE 'unmapped source-layer: ' || s END"


@query(f"""WITH {_ROWS}, t AS (SELECT *, {_TARGET_SQL} AS target FROM l), p AS (SELECT p.p_partkey, p.p_size, p.p_brand, t.* EXCLUDE (p_partkey) FROM t JOIN part p USING (p_partkey))
SELECT CAST(p_partkey AS INT) AS place, target, {_REASON_SQL} AS reason,
  CASE p_size % 3 WHEN 0 THEN CASE WHEN own THEN 'plain' WHEN s IN ('road', 'structure', 'motorway_junction') THEN 'case road' WHEN s = 'landcover' THEN 'case match' ELSE 'case get' END
    WHEN 1 THEN CASE WHEN own THEN 'plain' ELSE 'any' END ELSE CASE WHEN own THEN 'plain' WHEN s = 'admin' THEN 'case coded' ELSE 'case all' END END AS filter,
  CASE WHEN own THEN 'house_num' ELSE 'housenumber' END AS field, CASE WHEN own THEN 'extrude' ELSE 'render_height' END AS has,
  '#' || printf('%02X', CAST(p_size AS INT)) || '00FF' AS color FROM p""")
def style_convert(read):
    """Targets and reasons of every layer, and what became of its filter, layout and paint."""
    c = S.normalized_colors(S.convert(_layers(read)))
    f = F.col("filter")
    third = F.col("place").isNotNull()
    sort = F.when(S.names_literal(f, F.lit('"motorway_link"')), "case road").when(S.names_literal(f, F.lit('"match"')), "case match").when(f.rlike(r'^\["case", \["==", \["get", "class"\]'), "case get")
    sort = sort.when(f == '["case", ["any", ["has", "name:zh-Hans"], ["has", "name"]], true, false]', "any").when(f == '["case", ["all", ["==", ["get", "admin_level"], 4], ["==", ["get", "maritime"], 1]], true, false]', "case coded").when(f.startswith('["case", ["all"'), "case all").otherwise("plain")
    return c.where(third).select("place", "target", "reason", sort.alias("filter"), F.get_json_object("layout", "$['text-field'][1]").alias("field"), F.get_json_object("paint", "$['fill-color'][1][1]").alias("has"), F.get_json_object("paint", "$['fill-color'][2]").alias("color"))


@query(f"""WITH {_ROWS}, t AS (SELECT l.*, p_brand AS style, {_TARGET_SQL} AS target FROM l JOIN part USING (p_partkey)), r AS (SELECT *, {_REASON_SQL} AS reason FROM t),
m AS (SELECT style, s, list_sort(list(DISTINCT target)) AS targets FROM r WHERE target IS NOT NULL GROUP BY 1, 2),
j AS (SELECT style, '{{' || string_agg('"' || s || '":["' || array_to_string(targets, '","') || '"]', ',' ORDER BY s) || '}}' AS mappings FROM m GROUP BY 1)
SELECT style, count(*) AS layers, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS skipped, coalesce(any_value(mappings), '{{}}') AS mappings FROM r LEFT JOIN j USING (style) GROUP BY style""")
def style_report(read):
    return S.compatibility_report(S.convert(_layers(read)))


@query("SELECT CAST(p_partkey AS INT) AS place FROM part WHERE p_size % 3 <> 1")
def style_drawn(read):
    return S.drawn(_layers(read), "old", ["fill"]).select("place")


_TREES = """trees AS (SELECT 'filter' AS field, CASE p_size % 3 WHEN 0 THEN '["==", ["get", "class"], "x"]' WHEN 1 THEN '["has", "name_zh_Hans"]' ELSE '["all", ["==", ["get", "admin_level"], 1], ["==", ["get", "maritime"], "true"]]' END AS tree FROM part
  UNION ALL SELECT 'layout', '{"text-field": ["get", "house_num"], "size": ["get", "reflen"]}' FROM part
  UNION ALL SELECT 'paint', '{"fill-color": ["case", ["has", "extrude"], "rgb(' || p_size || ', 0, 255)", " white "], "x": "navy"}' FROM part)"""


def _literals(read, *fields):
    """(field, n, path, at, kind, value) of the literals in these fields of all layers; equal trees are walked once, and n
    is how many there are."""
    from tilewright.operators import trees as W

    whole = _layers(read).select(F.explode(F.create_map(*(x for c in fields for x in (F.lit(c), F.col(c))))).alias("field", "tree"))
    return W.expression_literals(W.leaves(whole.groupBy("field", "tree").agg(F.count("*").alias("n")), ["field", "n"], "tree"))


# the oracle walks the texts with its own tree function; the first of an array names an operator
@query(f"""WITH {_TREES}, j AS (SELECT field, type, atom ->> '$' AS value, path, fullkey FROM trees, json_tree(tree) WHERE type NOT IN ('ARRAY', 'OBJECT', 'NULL') AND NOT ends_with(fullkey, '[0]'))
SELECT field, CASE type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'flag' ELSE 'number' END AS kind, value, count(*) AS n FROM j GROUP BY ALL""")
def style_literals(read):
    """Literals of filters, layouts and paints of every layer, whatever their depth."""
    return _literals(read, "filter", "layout", "paint").groupBy("field", "kind", "value").agg(F.sum("n").alias("n"))


@query("SELECT '#' || printf('%02X', CAST(p_size AS INT)) || '00FF' AS color, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT '#FFFFFF', count(*) FROM part")
def style_colors(read):
    """Distinct colours of all paints, normalised, with how often they occur."""
    from tilewright.functions.text import color_to_hex

    color = color_to_hex(F.col("value"))
    return _literals(read, "paint").where("kind = 'text'").select(color.alias("color"), "n").where(F.col("color").rlike("^#[0-9A-F]{6}([0-9A-F]{2})?$")).groupBy("color").agg(F.sum("n").alias("n"))


@query(f"""WITH {_ROWS}, t AS (SELECT p_brand AS style, l.*, {_TARGET_SQL} AS target FROM l JOIN part USING (p_partkey)), k AS (SELECT * FROM t WHERE own OR target IS NOT NULL)
SELECT style, target AS source_layer, CASE WHEN own THEN NULL ELSE 'open' END AS source, CASE WHEN symbol THEN '["Open Sans Bold","Open Sans Regular"]' END AS fonts, count(*) AS n FROM k GROUP BY ALL""")
def style_document(read):
    """Whole converted styles, written as documents and read back: sources, layers and fonts of what they hold."""
    from tilewright.functions.text import FONT_MAP
    from tilewright.plans.storage import shared_path
    from tilewright.sources.archives import write_files

    layout = F.when(F.col("type") == "symbol", '{"text-font": ["DIN Pro Bold", "Arial Unicode MS Regular"], "text-field": ["get", "name"]}').otherwise(F.col("layout"))
    made = S.style_documents(S.convert(_layers(read).withColumn("layout", layout)), "open", {"version": 8, "name": "converted", "sources": {"open": {"type": "vector"}}}, "converted", FONT_MAP)
    spark = made.sparkSession
    folder = shared_path(spark)
    write_files(made.select(F.concat("style", F.lit(".json")).alias("name"), F.col("document").alias("content")), folder)
    back = S.read_layers(spark, folder)
    name = F.url_decode(F.regexp_extract("style", r"([^/]+)\.json$", 1))
    return back.groupBy(name.alias("style"), "source_layer", "source", F.get_json_object("layout", "$['text-font']").alias("fonts")).agg(F.count("*").alias("n"))
