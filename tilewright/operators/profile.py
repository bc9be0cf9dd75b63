"""A declarative feature profile: rules as data, each a filter and a projection, all united.

An element may pass several rules; every match is a row. A rule is (layer, geometry, least zoom, condition, attributes);
a condition is a dictionary of tag: value, list of values or ANY, or ("all", ...) and ("any", ...) of conditions. A
value "%end" is matched at the end of a tag. Attributes are (name, value): a constant, tag(...), first(...) or a chain
of cases. One scan serves all rules: conditions make an array of rule numbers, which is exploded, and only hits make
attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.polygons import rule_geometry

ANY = object()


def tag(key: str, kind: str = "string") -> tuple:
    """The value of a tag, cast; null if it can't be."""
    return ("tag", key, kind)


def first(*values) -> tuple:
    """The first value that isn't null."""
    return ("first", *values)


def cases(*pairs, otherwise) -> tuple:
    """(condition, value) pairs in order, else otherwise."""
    return ("cases", pairs, otherwise)


# fixed values: the rules of the profile
_BRUNNEL = cases(({"bridge": ["yes", "true", "1", "viaduct"]}, "bridge"), ({"tunnel": ["yes", "true", "1", "culvert", "building_passage"]}, "tunnel"), otherwise="none")
_RAMP = cases(({"highway": "%_link"}, "1"), otherwise="0")
_NAME = ("name", tag("name"))


def _road(cls: str, key: str = "highway", ramp=None, rest=("surface", "ref")) -> tuple:
    return (("class", cls), ("subclass", tag(key)), ("brunnel", _BRUNNEL), *([("ramp", ramp)] if ramp else []), *((k, tag(k)) for k in rest), _NAME)


def _place(rank: str, population: bool = True) -> tuple:
    return (("class", tag("place")), _NAME, ("name:latin", first(tag("name:en"), tag("name"))), *([("population", tag("population", "long"))] if population else []), ("rank", rank))


_ROAD_NAME = (("class", cases(({"highway": ["unclassified", "residential", "living_street"]}, "minor"), otherwise=tag("highway"))), _NAME, ("ref", tag("ref")), ("brunnel", _BRUNNEL))
_BOUNDARY = (("admin_level", tag("admin_level", "int")), ("disputed", cases(({"disputed": "yes"}, "1"), otherwise="0")), ("maritime", cases(({"maritime": "yes"}, "1"), otherwise="0")), _NAME)
_WATER = (("class", first(tag("water"), "lake")), _NAME)
_named = lambda key: (("class", tag(key)), _NAME)
_poi = lambda key: (("class", tag(key)), ("subclass", tag(key)), _NAME)
_NUMBER = (("housenumber", tag("addr:housenumber")),)
_NAME_OR_REF = ("any", {"name": ANY}, {"ref": ANY})

RULES: list[tuple] = [
    ("landcover", "polygon", 3, {"natural": ["wood", "scrub", "heath", "grassland", "fell", "glacier", "sand", "beach", "wetland"]},
     (("class", cases(({"natural": "wood"}, "wood"), ({"natural": ["scrub", "heath"]}, "scrub"), ({"natural": "glacier"}, "ice"), ({"natural": ["sand", "beach"]}, "sand"), ({"natural": "wetland"}, "wetland"), otherwise="grass")),)),
    ("landcover", "polygon", 3, {"landuse": ["forest", "meadow", "farmland", "orchard", "vineyard", "grass"]},
     (("class", cases(({"landuse": "forest"}, "wood"), ({"landuse": ["farmland", "orchard", "vineyard"]}, "farmland"), otherwise="grass")),)),
    ("landuse", "polygon", 6, {"landuse": ["residential", "commercial", "industrial", "retail", "cemetery", "recreation_ground", "quarry", "farmland", "farmyard"]}, _named("landuse")),
    ("landuse", "polygon", 7, {"leisure": ["garden", "playground", "golf_course", "pitch"]}, _named("leisure")),
    ("park", "polygon", 5, {"boundary": ["national_park", "protected_area"]}, _named("boundary")),
    ("park", "polygon", 7, {"leisure": ["park", "nature_reserve"]}, _named("leisure")),
    ("water", "polygon", 4, {"natural": "water"}, _WATER),
    ("water", "polygon", 5, {"waterway": ["riverbank", "dock"]}, _named("waterway")),
    ("waterway", "line", 6, {"waterway": "river"}, _named("waterway")),
    ("waterway", "line", 8, {"waterway": "canal"}, _named("waterway")),
    ("waterway", "line", 10, {"waterway": ["stream", "drain", "ditch"]}, _named("waterway")),
    ("transportation", "line", 4, {"highway": ["motorway", "motorway_link"]}, _road("motorway", ramp=_RAMP)),
    ("transportation", "line", 4, {"highway": ["trunk", "trunk_link"]}, _road("trunk", ramp=_RAMP)),
    ("transportation", "line", 6, {"highway": ["primary", "primary_link"]}, _road("primary", ramp=_RAMP)),
    ("transportation", "line", 8, {"highway": ["secondary", "secondary_link"]}, _road("secondary", ramp=_RAMP)),
    ("transportation", "line", 9, {"highway": ["tertiary", "tertiary_link"]}, _road("tertiary", ramp=_RAMP)),
    ("transportation", "line", 11, {"highway": ["unclassified", "residential", "living_street"]}, _road("minor", ramp="0")),
    ("transportation", "line", 12, {"highway": "service"}, _road("service", ramp="0", rest=("surface",))),
    ("transportation", "line", 12, {"highway": "track"}, _road("track", ramp="0", rest=("surface",))),
    ("transportation", "line", 12, {"highway": "pedestrian"}, _road("pedestrian", ramp="0", rest=("surface",))),
    ("transportation", "line", 13, {"highway": ["path", "footway", "cycleway"]}, _road("path", ramp="0", rest=("surface",))),
    ("transportation", "line", 13, {"highway": "steps"}, _road("steps", ramp="0", rest=())),
    ("transportation", "line", 8, {"railway": ["rail", "narrow_gauge"]}, _road("rail", "railway", rest=())),
    ("transportation", "line", 9, {"railway": ["light_rail", "subway", "tram", "monorail"]}, _road("transit", "railway", rest=())),
    ("transportation", "line", 7, {"route": "ferry"}, (("class", "ferry"), ("subclass", "ferry"), ("brunnel", "none"), _NAME)),
    ("transportation", "line", 10, {"aerialway": ["cable_car", "gondola", "chair_lift", "drag_lift", "platter", "t-bar", "rope_tow"]}, (("class", "aerialway"), ("subclass", tag("aerialway")), ("brunnel", "none"), _NAME)),
    ("transportation_name", "line", 7, ("all", {"highway": ["motorway", "trunk"]}, _NAME_OR_REF), _ROAD_NAME),
    ("transportation_name", "line", 8, ("all", {"highway": "primary"}, _NAME_OR_REF), _ROAD_NAME),
    ("transportation_name", "line", 10, ("all", {"highway": ["secondary", "tertiary"]}, _NAME_OR_REF), _ROAD_NAME),
    ("transportation_name", "line", 12, ("all", {"highway": ["unclassified", "residential"]}, {"name": ANY}), _ROAD_NAME),
    ("building", "polygon", 13, {"building": ANY},
     (("class", tag("building")), ("render_height", tag("height", "double")), ("render_min_height", tag("min_height", "double")), ("underground", cases(({"location": "underground"}, "true"), otherwise="false")))),
    ("aeroway", "line", 9, {"aeroway": ["runway", "taxiway"]}, (("class", tag("aeroway")), ("type", tag("aeroway")))),
    ("aeroway", "polygon", 10, {"aeroway": ["aerodrome", "runway", "taxiway", "helipad"]}, (("class", tag("aeroway")), ("type", tag("aeroway")), _NAME)),
    ("aerodrome_label", "centroid", 8, {"aeroway": ["aerodrome", "heliport"]}, (("class", tag("aeroway")), _NAME, ("iata", tag("iata")), ("icao", tag("icao")))),
    ("boundary", "line", 0, ("all", {"boundary": "administrative"}, {"admin_level": "2"}), _BOUNDARY),
    ("boundary", "line", 3, ("all", {"boundary": "administrative"}, {"admin_level": "4"}), _BOUNDARY),
    ("boundary", "line", 6, ("all", {"boundary": "administrative"}, {"admin_level": ["5", "6"]}), _BOUNDARY),
    ("boundary", "line", 8, ("all", {"boundary": "administrative"}, {"admin_level": ["7", "8"]}), _BOUNDARY),
    ("place", "point", 0, {"place": "continent"}, _place("1")),
    ("place", "point", 2, {"place": "country"}, _place("1")),
    ("place", "point", 3, {"place": "state"}, _place("2")),
    ("place", "point", 4, {"place": "region"}, _place("3")),
    ("place", "point", 5, {"place": "city"}, _place("4")),
    ("place", "point", 7, {"place": "town"}, _place("5")),
    ("place", "point", 9, {"place": "village"}, _place("6")),
    ("place", "point", 10, {"place": ["suburb", "neighbourhood", "hamlet"]}, _place("7", population=False)),
    ("poi", "point", 11, {"amenity": ANY}, _poi("amenity")),
    ("poi", "polygon_centroid", 12, {"amenity": ANY}, _poi("amenity")),
    ("poi", "point", 11, {"tourism": ANY}, _poi("tourism")),
    ("poi", "polygon_centroid", 12, {"tourism": ANY}, _poi("tourism")),
    ("water_name", "polygon_point_on_surface", 5, ("all", {"natural": "water"}, {"name": ANY}), _WATER),
    ("water_name", "line", 6, ("all", {"waterway": ["river", "canal", "stream"]}, {"name": ANY}), _named("waterway")),
    ("mountain_peak", "point", 8, {"natural": ["peak", "volcano"]}, (("class", tag("natural")), _NAME, ("ele", tag("ele", "double")))),
    ("housenumber", "point", 16, {"addr:housenumber": ANY}, _NUMBER),
    ("housenumber", "polygon_centroid", 16, {"addr:housenumber": ANY}, _NUMBER),
]
#: Kinds of elements that a rule's geometry is made of.
KINDS = {"centroid": ("polygon", "point"), "polygon_centroid": ("polygon",), "polygon_point_on_surface": ("polygon",)}


def _keys(rule) -> set[str]:
    """Tags that a condition reads."""
    return {k for part in rule[1:] for k in _keys(part)} if isinstance(rule, tuple) else set(rule)


def _needed(rule) -> str | None:
    """A tag without which a condition can't hold, if there is one."""
    if isinstance(rule, dict):
        return next(iter(rule), None)
    return next((key for part in rule[1:] if (key := _needed(part))), None) if rule[0] == "all" else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tag(key: str) -> str:
    return f"try_element_at(tags, {_quoted(key)})"


def condition(rule, of=_tag) -> str:
    """A rule's condition as a SQL expression that is never null; of(key) is the expression of a tag.

    Expressions are text, parsed once: a profile has thousands of them, and a call to the JVM for each takes seconds.
    """
    if isinstance(rule, tuple):
        return "(" + f" {'AND' if rule[0] == 'all' else 'OR'} ".join(condition(r, of) for r in rule[1:]) + ")"

    def test(value, key: str) -> str:
        if value is ANY:
            return f"{of(key)} IS NOT NULL"
        values = value if isinstance(value, list) else [value]
        plain = [_quoted(v) for v in values if not v.startswith("%")]
        tests = [f"{of(key)} IN ({', '.join(plain)})"] * bool(plain) + [f"endswith({of(key)}, {_quoted(v[1:])})" for v in values if v.startswith("%")]
        return f"coalesce({' OR '.join(tests)}, false)"

    return "(" + " AND ".join(test(value, key) for key, value in rule.items()) + ")"


def value_of(value) -> str:
    """The SQL expression of an attribute's value, a string."""
    if isinstance(value, str):
        return _quoted(value)
    if value[0] == "tag":
        return _tag(value[1]) if value[2] == "string" else f"CAST(try_cast({_tag(value[1])} AS {value[2]}) AS STRING)"
    if value[0] == "first":
        return f"coalesce({', '.join(map(value_of, value[1:]))})"
    return "CASE " + " ".join(f"WHEN {condition(test)} THEN {value_of(then)}" for test, then in value[1]) + f" ELSE {value_of(value[2])} END"


def apply_profile(elements: DataFrame, rules: list[tuple] | None = None, zoom: int | None = None) -> DataFrame:
    """(osm_id, rule, layer, min_zoom, attrs) of elements (osm_id, geom_kind, tags); zoom: only what it shows. Elements with
    geom (parts of points) give geom too, as the rule names it: a centroid, a point on the surface, or what they have.

    Tags that conditions read are looked up once an element. An attribute is one chain of cases over the rules that make
    it in the same way.
    """
    rules = RULES if rules is None else rules
    shown = [(k, r) for k, r in enumerate(rules, 1) if zoom is None or zoom >= r[2]]
    keys = sorted({key for _, r in shown for key in _keys(r[3])})
    place = {key: i for i, key in enumerate(keys)}
    looked = F.expr(f"struct({', '.join(f'{_tag(key)} AS t{i}' for key, i in place.items()) or 'NULL AS t'})")
    of = lambda key: f"_t.t{place[key]}"
    kinds = lambda geometry: ", ".join(map(_quoted, KINDS.get(geometry, (geometry,))))
    groups: dict[str | None, list[str]] = {}
    for k, r in shown:
        groups.setdefault(_needed(r[3]), []).append(f"CASE WHEN geom_kind IN ({kinds(r[1])}) AND {condition(r[3], of)} THEN {k} END")
    # an element has few of the tags, so few groups of rules are tested
    numbers = ", ".join(f"CASE WHEN {f'{of(key)} IS NOT NULL' if key else 'true'} THEN array({', '.join(cases)}) END" for key, cases in groups.items())
    own = ["geom"] if "geom" in elements.columns else []
    hits = elements.select("osm_id", "geom_kind", "tags", *own, looked.alias("_t")).select("osm_id", "geom_kind", "tags", *own, F.explode(F.expr(f"array_compact(flatten(array_compact(array({numbers or 'array(CAST(NULL AS INT))'}))))")).alias("rule"))
    made: dict[str, dict[str, list[int]]] = {}
    for k, r in shown:
        for name, value in r[4]:
            made.setdefault(name, {}).setdefault(value_of(value), []).append(k)
    pairs = []
    for name, values in made.items():
        chain = " ".join(f"WHEN rule IN ({', '.join(map(str, which))}) THEN {value}" for value, which in values.items())
        pairs.append(f"struct({_quoted(name)} AS key, CASE {chain} END AS value)")
    attrs = f"map_from_entries(filter(array({', '.join(pairs)}), p -> p.value IS NOT NULL))" if pairs else "CAST(map() AS MAP<STRING, STRING>)"
    table = lambda values: f"get(array({', '.join(values)}), rule - 1)"
    geoms = [rule_geometry(F.col("geom"), F.col("geom_kind"), F.expr(table([_quoted(r[1]) for r in rules]))).alias("geom")] if own else []
    return hits.select("osm_id", "rule", *geoms, F.expr(table([_quoted(r[0]) for r in rules])).alias("layer"), F.expr(table([str(r[2]) for r in rules])).alias("min_zoom"), F.expr(attrs).alias("attrs"))


def centroid(ring: Column) -> Column:
    """struct(x, y): the area-weighted centre of a ring of struct(x, y); the mean of its points where it has no area."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    total = lambda of, pick: F.aggregate(of, F.lit(0.0), lambda s, p: s + pick(p))
    area = total(cross, lambda p: p["c"])
    axis = lambda c: F.when(area != 0, total(cross, lambda p: p["c"] * p[c]) / (3.0 * area)).otherwise(F.try_divide(total(ring, lambda p: p[c]), F.size(ring).cast("double")))
    return F.struct(axis("x").alias("x"), axis("y").alias("y"))
