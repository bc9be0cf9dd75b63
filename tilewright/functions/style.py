"""Map styles as rows: layers of style documents, their expressions translated to another schema of tiles.

A style is a small document; its layers are rows, and expressions are JSON text in them. Trees are rewritten by small
functions over parsed JSON, in Arrow batches where there are many styles.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import classes as K
from tilewright.functions import text as X

LAYERS = "id string, type string, source string, source_layer string, minzoom double, maxzoom double, filter string, layout string, paint string"
# fixed values: roots of filters that renderers may read as legacy ones
AMBIGUOUS = {"==", "!=", ">", ">=", "<", "<=", "in", "!in", "all", "any", "none", "has", "!has"}
ROADS = {"road", "structure", "motorway_junction"}
_get = lambda key: ["get", key]

# fixed values: source layer -> target of shapes, target of symbols
TARGETS = {
    "landcover": ("landcover", "landcover"), "landuse": ("landuse", "landuse"), "waterway": ("waterway", "water_name"), "water": ("water", "water_name"), "depth": ("depth", "depth"),
    "structure": ("transportation", "transportation_name"), "aeroway": ("aeroway", "aerodrome_label"), "building": ("building", "building"), "road": ("transportation", "transportation_name"),
    "admin": ("boundary", "boundary"), "housenum_label": ("housenumber", "housenumber"), "place_label": ("place", "place"), "motorway_junction": ("transportation_name", "transportation_name"),
    "poi_label": ("poi", "poi"), "transit_stop_label": ("poi", "poi"), "airport_label": ("aerodrome_label", "aerodrome_label"),
}


def target_layer(source_layer: Column, kind: Column, layer_id: Column) -> Column:
    """The layer of the open schema that stands for a source layer; null where none does."""
    low = F.lower(layer_id)
    out = F.when(source_layer == "landuse_overlay", F.when(F.contains(low, F.lit("park")), "park").otherwise("landuse"))
    out = out.when(source_layer == "natural_label", F.when(low.rlike("water|ocean|sea|lake|bay|strait|river"), "water_name").when(low.rlike("peak|mountain|volcano"), "mountain_peak").otherwise("place"))
    for source, (shape, symbol) in TARGETS.items():
        out = out.when(source_layer == source, F.when(kind == "symbol", symbol).otherwise(shape) if shape != symbol else F.lit(shape))
    return out


def translated_get(key: str, source_layer: str | None):
    """The expression that reads an old property from the open schema."""
    if re.fullmatch(r"name_[A-Za-z0-9_-]+", key):
        return ["coalesce", _get("name:" + key[5:].replace("_", "-")), _get("name"), _get("name:latin"), ""]
    if key in ("class", "type") and source_layer in ROADS:
        return K.ROAD_CLASS
    if key == "class" and source_layer == "landcover":
        return ["match", _get("class"), "farmland", "crop", "ice", "snow", _get("class")]
    if key == "type":
        return ["coalesce", _get("subclass"), _get("class"), ""] if source_layer in ("poi_label", "transit_stop_label") else _get("class")
    # fixed values
    fixed = {
        "name": ["coalesce", _get("name"), _get("name:latin"), _get("name:nonlatin"), ""], "reflen": ["length", ["to-string", ["coalesce", _get("ref"), ""]]],
        "maki": ["coalesce", _get("subclass"), _get("class"), "marker"], "maki_beta": ["coalesce", _get("subclass"), _get("class"), "marker"],
        "extrude": ["case", ["has", "render_height"], "true", "false"], "abbr": ["coalesce", _get("name:short"), _get("name"), ""], "worldview": "US", "disputed": 0,
    }
    return fixed[key] if key in fixed else _get(K.RENAMED.get(key, key))


def translated_has(key: str):
    if re.fullmatch(r"name_[A-Za-z0-9_-]+", key):
        return ["any", ["has", "name:" + key[5:].replace("_", "-")], ["has", "name"]]
    own = {k: v for k, v in K.RENAMED.items() if k not in ("iso_3166_1", "mode", "stop_type")}
    return ["has", "render_height" if key == "extrude" else own.get(key, key)]


def translated(value, source_layer: str | None):
    """A tree with each get and has of a property translated; objects are entered too."""
    if isinstance(value, dict):
        return {k: translated(v, source_layer) for k, v in value.items()}
    if not isinstance(value, list):
        return value
    if len(value) > 1 and isinstance(value[1], str) and value[0] in ("get", "has"):
        return translated_get(value[1], source_layer) if value[0] == "get" else translated_has(value[1])
    return value[:1] + [translated(v, source_layer) for v in value[1:]]


def class_replaced(value, by):
    """A tree with by for each ["get", "class"]."""
    if isinstance(value, dict):
        return {k: class_replaced(v, by) for k, v in value.items()}
    if not isinstance(value, list):
        return value
    return by if value == _get("class") else [class_replaced(v, by) for v in value]


def forced(filter_):
    """A filter as an expression that can't be taken for a legacy one."""
    return ["case", filter_, True, False] if isinstance(filter_, list) and filter_ and filter_[0] in AMBIGUOUS else filter_


def boundary_recoded(value):
    """A boundary filter's comparisons in the coding of the open schema: levels, and texts of true and false as numbers."""
    if not isinstance(value, list) or not value or not isinstance(value[0], str):
        return value
    op, args = value[0], [boundary_recoded(v) for v in value[1:]]
    if op not in ("==", "!=", ">", ">=", "<", "<=") or len(args) < 2:
        return [op, *args]
    number = lambda v: {"true": 1, "false": 0}.get(v, v) if isinstance(v, str) else v
    left, right = args[:2]
    if left == _get("admin_level") and isinstance(right, (int, float)) and not isinstance(right, bool):
        right = {0: 2, 1: 4, 2: 6}.get(right, right)
    if left == 0 and not isinstance(left, bool) and right in ("true", "false"):
        left = _get("disputed")
    if left in (_get("maritime"), _get("disputed")):
        right = number(right)
    return [op, left, right, *args[2:]]


def members_of(text: str, name: str):
    """The elements of an array in a JSON object, one after another, none where it is absent or empty; the object is never
    whole in memory. Of a name that repeats the last counts."""
    decode, blanks = json.JSONDecoder().raw_decode, re.compile(r"[ \t\n\r]*")
    skip = lambda at: blanks.match(text, at).end()

    def expect(at: int, signs: str) -> int:
        at = skip(at)
        if text[at : at + 1] not in tuple(signs):
            raise ValueError(f"one of {signs} expected at {at}")
        return at

    def elements(at: int):
        """(place, element) of the array that begins here; at the end the place behind it and nothing."""
        at = skip(at + 1)
        while text[at : at + 1] != "]":
            value, after = decode(text, at)
            yield at, value
            at = expect(after, ",]")
            if text[at] == ",":
                at = skip(at + 1)
                if text[at : at + 1] == "]":
                    raise ValueError(f"an element expected at {at}")
        yield at + 1, None

    at, found = skip(expect(0, "{") + 1), None
    while text[at : at + 1] != "}":
        key, at = decode(text, expect(at, '"'))
        at = skip(expect(at, ":") + 1)
        if key == name and text[at : at + 1] == "[":
            found = at
            for at, _ in elements(at):  # noqa: B007
                pass
        else:
            value, at = decode(text, at)
            if key == name:
                if value:
                    raise ValueError(f"{name} is not an array")
                found = None
        at = expect(at, ",}")
        if text[at] == ",":
            at = expect(at + 1, '"')
    if skip(at + 1) != len(text):
        raise ValueError("more text than one object")
    if found is not None:
        held = None
        for own in elements(found):
            if held is not None:
                yield held[1]
            held = own


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """(style, place, id, type, source, source_layer, minzoom, maxzoom, filter, layout, paint) of the layers of styles,
    expressions as JSON text. A path without styles gives no rows; a style without layers gives none of its own."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("style"), "value")

    def run(batches):
        names = [c.split(" ")[0] for c in LAYERS.split(", ")]
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.float64(), pa.float64(), *[pa.string()] * 3]
        dump = lambda v: None if v is None else json.dumps(v, ensure_ascii=False)
        number = lambda v: None if v is None else float(v)
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["style", "place", *names])

        for batch in batches:
            for style, text in zip(batch.column(0), batch.column(1), strict=True):
                for place, x in enumerate(members_of(text.as_py(), "layers")):
                    rows.append((style.as_py(), place, x.get("id"), x.get("type"), x.get("source"), x.get("source-layer"), number(x.get("minzoom")), number(x.get("maxzoom")), *(dump(x.get(k)) for k in ("filter", "layout", "paint"))))
                    if len(rows) == 2000:
                        yield made()
                        rows.clear()
        if rows:
            yield made()

    return raw.mapInArrow(run, f"style string, place int, {LAYERS}")


def convert(layers: DataFrame) -> DataFrame:
    """Layers of vector sources with target, reason and translated filter, layout and paint: layers without a source stay
    as they are; those without a target have a reason why they are skipped. Filters are forced to be expressions."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("filter", "layout", "paint")}
            for source, layer, *trees in zip(*(batch.column(k).to_pylist() for k in ("source", "source_layer", *out)), strict=True):
                for k, text in zip(out, trees, strict=True):
                    tree = None if text is None else json.loads(text)
                    if tree is not None and source is not None:
                        tree = translated(tree, layer)
                        if k == "filter":
                            tree = forced(boundary_recoded(tree) if layer == "admin" else tree)
                    out[k].append(None if tree is None else json.dumps(tree, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.string()) if c in out else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    made = layers.mapInArrow(run, layers.schema)
    target = F.when(F.col("source").isNotNull() & ~F.coalesce(F.col("source_layer").isin("hillshade", "contour"), F.lit(False)), target_layer(F.col("source_layer"), F.col("type"), F.col("id")))
    made = made.withColumn("target", target)
    reason = F.when(F.col("source").isNull() | F.col("target").isNotNull(), None).when(F.col("source_layer") == "hillshade", "replaced by open raster DEM hillshade")
    reason = reason.when(F.col("source_layer") == "contour", "no equivalent contour layer in the public vector schema").otherwise(F.concat(F.lit("unmapped source-layer: "), F.coalesce("source_layer", F.lit("none"))))
    return made.withColumn("reason", reason)


def compatibility_report(converted: DataFrame) -> DataFrame:
    """One row a style: (style, layers, kept, skipped, mappings): counts, and the sorted targets of each source layer as JSON."""
    counts = converted.groupBy("style").agg(F.count("*").alias("layers"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))
    pairs = converted.where("target IS NOT NULL").groupBy("style", "source_layer").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    maps = pairs.groupBy("style").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_layer", "targets"))))).alias("mappings"))
    return counts.join(maps, "style", "left").withColumn("mappings", F.coalesce("mappings", F.lit("{}")))


def drawn(layers: DataFrame, source: str, kinds: list[str]) -> DataFrame:
    """Layers of one source, or of none, that aren't of these kinds."""
    return layers.where((F.col("source").isNull() | (F.col("source") == source)) & ~F.coalesce(F.col("type").isin(kinds), F.lit(False)))


def names_literal(tree: Column, literal: Column) -> Column:
    """Whether JSON text has this literal in it."""
    return F.coalesce(F.contains(tree, literal), F.lit(False))


def normalized_colors(layers: DataFrame, column: str = "paint") -> DataFrame:
    """JSON text with every colour literal as hex: each text within it is taken out, recoded, and put back in its place."""
    pieces = F.regexp_extract_all(F.col(column), F.lit(r'("(?:[^"\\\\]|\\\\.)*"|[^"]+)'), 1)
    recoded = F.transform(pieces, lambda p: F.when(p.startswith('"') & ~F.contains(p, F.lit("\\")), F.concat(F.lit('"'), X.color_to_hex(F.substring(p, 2, 1 << 30).substr(F.lit(1), F.length(p) - 2)), F.lit('"'))).otherwise(p))
    return layers.withColumn(column, F.when(F.col(column).isNotNull(), F.array_join(recoded, "")))


def enter_by(minzoom: Column, zoom: int) -> Column:
    """The least zoom of a layer that must be there by a zoom: its own if that is lower; 24 stands for none."""
    return F.least(F.coalesce(minzoom, F.lit(24.0)), F.lit(float(zoom)))


def restored_ranges(layers: DataFrame, originals: DataFrame) -> DataFrame:
    """layers with minzoom and maxzoom as the original layer of the same id has them: what the original lacks is deleted.
    Layers without an original stay as they are."""
    o = originals.select(F.col("id").alias("_id"), F.col("minzoom").alias("_min"), F.col("maxzoom").alias("_max"))
    met = layers.join(o, F.col("id") == F.col("_id"), "left")
    own = F.col("_id").isNotNull()
    return met.withColumns({"minzoom": F.when(own, F.col("_min")).otherwise(F.col("minzoom")), "maxzoom": F.when(own, F.col("_max")).otherwise(F.col("maxzoom"))}).select(layers.columns)


def with_class(expression: Column, replacement) -> Column:
    """JSON of an expression with replacement, a tree, wherever the class is read. A batch of texts is rewritten at once;
    a text that isn't JSON fails."""

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else json.dumps(class_replaced(json.loads(t), replacement), ensure_ascii=False) for t in texts.to_pylist()], pa.string())

    return rewrite(expression)


def mapped_fonts(layout: Column, fonts: dict[str, str]) -> Column:
    """Layouts with the names of text-font replaced, wherever they stand in it; others, and other members, stay."""

    def walk(value):
        if isinstance(value, list):
            return [walk(v) for v in value]
        if isinstance(value, dict):
            return {k: walk(v) for k, v in value.items()}
        return fonts.get(value, value) if isinstance(value, str) else value

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is not None and '"text-font"' in t:
                tree = json.loads(t)
                t = json.dumps(tree | {"text-font": walk(tree["text-font"])} if "text-font" in tree else tree, ensure_ascii=False)
            out.append(t)
        return pa.array(out, pa.string())

    return rewrite(layout)


def style_documents(converted: DataFrame, source: str, head: dict, prefix: str, fonts: dict[str, str]) -> DataFrame:
    """(style, document): the JSON of each converted style: head, then its kept layers in order of place.

    Layers with a target read it from source, and say under prefix:original-source-layer and prefix:open-source-layer where
    they come from; layers without a source stay. A style is a document of some hundred layers, so it is put together
    where its rows meet.
    """
    own = F.col("target").isNotNull()
    named = F.struct(F.col("source_layer").alias(f"{prefix}:original-source-layer"), F.col("target").alias(f"{prefix}:open-source-layer"))
    plain = F.to_json(F.struct("id", "type", F.when(own, F.lit(source)).alias("source"), F.col("target").alias("source-layer"), F.when(own, named).alias("metadata"), "minzoom", "maxzoom"))
    tree = lambda name, text: F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), text))
    members = F.array_compact(F.array(F.substring(plain, F.lit(2), F.length(plain) - 2), tree("filter", F.col("filter")), tree("layout", mapped_fonts(F.col("layout"), fonts)), tree("paint", F.col("paint"))))
    layers = converted.where("reason IS NULL").select("style", F.struct("place", F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("layer")).alias("l"))
    opening = json.dumps(head, ensure_ascii=False)[:-1]
    together = F.concat(F.lit(opening + (", " if head else "") + '"layers": ['), F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["layer"]), ","), F.lit("]}"))
    return layers.groupBy("style").agg(together.alias("document"))
