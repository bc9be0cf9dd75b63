"""Tiled features: keys, merging, copies, budgets, overscaling and clipping. Geometry is array<array<struct<x,y>>>."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import base64url

GEOMETRY = "array<array<struct<x:double,y:double>>>"


def stable_properties(props: Column) -> Column:
    """Entries of a map, sorted by key, as JSON."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(props))))


def signature(gtype: Column, props: Column, geom: Column) -> Column:
    """Digest of type, sorted properties and every point in order, with the parts told apart. The text of an array of
    numbers is definite, and casts are compiled where functions of lambdas aren't."""
    return base64url(F.unhex(F.sha1(F.concat_ws("|", gtype.cast("string"), F.to_json(F.sort_array(F.map_entries(props))), geom.cast("string")))))


def feature_key(gtype: Column, fid: Column, props: Column, geom: Column) -> Column:
    """Polygons by signature; others by type and id, by signature without an id."""
    return F.when((gtype == 3) | fid.isNull(), signature(gtype, props, geom)).otherwise(F.concat_ws(":", gtype.cast("string"), fid.cast("string")))


#: What with_shape() adds: equal features have equal values of all of them.
SHAPE = ["key_type", "key_id", "key_a", "key_b"]


def with_shape(features: DataFrame) -> DataFrame:
    """features with the columns of SHAPE, a key as feature_key() is one, in numbers alone: a digest of 128 bits of the typed
    values stands for properties and points, so that nothing is written as text first and keys are short to compare."""
    whole = (F.col("gtype") == 3) | F.col("fid").isNull()
    entries = F.sort_array(F.map_entries("props"))
    return features.withColumns({"key_type": F.col("gtype"), "key_id": F.when(~whole, F.col("fid")), "key_a": F.when(whole, F.xxhash64("geom", entries)), "key_b": F.when(whole, F.xxhash64(F.lit(1), entries, "geom"))})


def distinct_polygons(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, props, geom, fid, copies) of polygons that are equal in every point and property: the least id and how many
    there are. Only numbers are reduced, so rows are hashed and never sorted."""
    shaped = features.select(*keys, F.sort_array(F.map_entries("props")).alias("_props"), "geom", "fid")
    one = shaped.groupBy(*keys, "_props", "geom").agg(F.min("fid").alias("fid"), F.count("*").alias("copies"))
    return one.select(*keys, F.map_from_entries("_props").alias("props"), "geom", "fid", "copies")


def contains_run(part: Column, piece: Column) -> Column:
    """Whether piece is a run of part's points, forward or backward."""
    n, m = F.size(part), F.size(piece)
    starts = F.when(m <= n, F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: (F.slice(part, i, m) == piece) | (F.slice(part, i, m) == F.reverse(piece)))


def union_parts(first: Column, parts: Column) -> Column:
    """first, the parts of a line as they are, and further ones in order of arrival: one within an earlier is skipped;
    ones within it go."""
    def add(have, new):
        without = F.filter(have, lambda p: ~contains_run(new, p))
        return F.when(F.exists(have, lambda p: contains_run(p, new)), have).otherwise(F.array_append(without, new))

    return F.aggregate(parts, first, add)


def merge(features: DataFrame, keys: list[str], order: list[str], extent: Column | None = None, scale: int = 64) -> DataFrame:
    """One feature for each key of tile and layer: the first by order, lines with the parts of all. With extent, features
    without points or beyond the extent times scale are left out first.

    The first row is found by a reduction. Only lines gather parts, as many as payloads hold of one feature; a line that
    occurs once stays as it is. Rows are grouped by sorting, which a hash of the keys in front makes a matter of numbers.
    """
    features = features if extent is None else features.where(sane(F.col("geom"), extent, scale))
    by = [F.xxhash64(*keys).alias("_h"), *keys]
    rest = [c for c in features.columns if c not in keys]
    names = lambda src: [F.col(f"{src}.{c}").alias(c) for c in rest]
    others = features.where("gtype <> 2 OR gtype IS NULL").groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, *names("_f"))
    at = F.struct(F.struct(*order).alias("at"), F.col("geom").alias("geom"))
    lines = features.where("gtype = 2").groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"), F.collect_list(at).alias("_p"))
    # rows of one place in the order are told apart by geometry
    parts = F.sort_array("_p")
    geom = F.when(F.size("_p") == 1, F.col("_f.geom")).otherwise(union_parts(F.get(parts, 0)["geom"], F.flatten(F.transform(F.slice(parts, 2, F.size("_p")), lambda p: p["geom"]))))
    return others.unionByName(lines.select(*keys, *(geom.alias("geom") if c == "geom" else x for c, x in zip(rest, names("_f"), strict=True))))


def layer_copy(features: DataFrame, source: str, target: str, overrides: dict[str, str], extent: Column | None = None, scale: int = 128) -> DataFrame:
    """The source layer under a new name, its properties overridden; null overrides take a property away. With extent,
    features without points or beyond the extent times scale are left out."""
    # the layer is compared first, so that geometries of the others aren't looked at
    features = features.where(F.col("layer") == source)
    features = features if extent is None else features.where(sane(F.col("geom"), extent, scale))
    drop = [k for k, v in overrides.items() if v is None]
    new = F.create_map(*(F.lit(x) for k, v in overrides.items() if v is not None for x in (k, v)))
    # entries are removed by value, as functions of lambdas aren't compiled
    entries = F.map_entries("props")
    for k in overrides:
        entries = F.array_remove(entries, F.struct(F.lit(k).alias("key"), F.col("props")[k].alias("value")))
    kept = F.map_from_entries(entries)
    return features.withColumn("layer", F.lit(target)).withColumn("props", F.map_concat(kept, new) if len(drop) < len(overrides) else kept)


def inspect_layers(features: DataFrame, keys: list[str]) -> DataFrame:
    """Features, points and the box of each layer."""
    pts = F.flatten("geom")
    along = {"x": F.transform(pts, lambda p: p["x"]), "y": F.transform(pts, lambda p: p["y"])}
    f = features.withColumn("_n", F.size(pts)).withColumns({f"_{a}{c}": fn(along[c]) for a, fn in (("min", F.array_min), ("max", F.array_max)) for c in "xy"})
    return f.groupBy(*keys).agg(F.count("*").alias("features"), F.sum("_n").alias("points"), *(getattr(F, a)(f"_{a}{c}").alias(f"{a}_{c}") for a in ("min", "max") for c in "xy"))


def budget_violations(features: DataFrame, keys: list[str], layers: int, count: int, points: int) -> DataFrame:
    """Totals of each tile and which limits it breaks."""
    n = F.size(F.flatten("geom"))
    t = features.groupBy(*keys).agg(F.count_distinct("layer").alias("layers"), F.count("*").alias("features"), F.sum(n).alias("points"), F.sum(F.size("props")).alias("properties"), F.max(n).alias("largest"))
    broken = F.array_compact(F.array(F.when(F.col("layers") > layers, F.lit("layers")), F.when(F.col("features") > count, F.lit("features")), F.when(F.col("points") > points, F.lit("points"))))
    return t.withColumn("broken", broken)


def sane(geom: Column, extent: Column, scale: int = 64) -> Column:
    """Not empty, finite, and within the extent times scale. Made of whole-array functions, which are compiled where functions
    of lambdas aren't: NaN counts as the largest number, and a search in an array with a null that finds nothing is null."""
    points, far = F.flatten(geom), extent * scale
    fine = lambda v: (F.array_max(v) <= far) & (F.array_min(v) >= -far) & F.array_contains(v, F.lit(1.7e308)).isNotNull()
    return F.coalesce((F.size(points) > 0) & fine(points["x"]) & fine(points["y"]), F.lit(False))


def dedupe_points(part: Column) -> Column:
    """Points without those that repeat the one before."""
    return F.filter(part, lambda p, i: (i == 0) | (F.get(part, i - 1) != p))


def overscale(geom: Column, scale: Column, offset_x: Column, offset_y: Column) -> Column:
    return F.transform(geom, lambda part: F.transform(part, lambda p: F.struct((p["x"] * scale - offset_x).alias("x"), (p["y"] * scale - offset_y).alias("y"))))


def _clip_side(offsets, points, axis: int, bound: float, keep_greater: bool):
    """Rings cut by one side of the box; points on the side are inside. Each edge adds its crossing and its end."""
    v = points[axis]
    inside = v >= bound if keep_greater else v <= bound
    before = np.arange(-1, len(v) - 1)
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = offsets[1:][filled] - 1
    crosses = inside != inside[before]
    ends = np.concatenate([[0], np.cumsum(crosses.astype(np.int64) + inside)])
    cut = [np.empty(ends[-1]), np.empty(ends[-1])]
    edge, start = np.flatnonzero(crosses), before[crosses]
    for k in (0, 1):
        cut[k][ends[1:][inside] - 1] = points[k][inside]
        # crossing edges have different ends on this axis
        at = bound if k == axis else points[k][start] + (points[k][edge] - points[k][start]) * (bound - v[start]) / (v[edge] - v[start])
        cut[k][ends[edge]] = at
    return ends[offsets], cut


def _kept(offsets, points, keep):
    """Points that stay, and where their rings begin and end."""
    return np.concatenate([[0], np.cumsum(keep)])[offsets], [v[keep] for v in points]


def clip_arrays(offsets, points, extent: int):
    """Rings as flat arrays, clipped to 0..extent, rounded half up, repeats dropped and closed. A ring that vanishes has no
    points. Rings of fewer than three points, or with a point that isn't finite, vanish."""
    lo, n = offsets[:-1], np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~(np.isfinite(points[0]) & np.isfinite(points[1])))])
    n = np.where((n < 3) | (bad[offsets[1:]] > bad[lo]), 0, n)
    last = np.maximum(lo + n - 1, 0)
    if len(points[0]):
        first = np.minimum(lo, len(points[0]) - 1)
        n = n - ((n > 0) & (points[0][first] == points[0][last]) & (points[1][first] == points[1][last]))
    offsets = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(lo - offsets[:-1], n) + np.arange(offsets[-1])
    points = [v[take] for v in points]
    for axis, bound, greater in ((0, 0.0, True), (0, float(extent), False), (1, 0.0, True), (1, float(extent), False)):
        offsets, points = _clip_side(offsets, points, axis, bound, greater)
    points = [np.floor(v + 0.5) + 0.0 for v in points]
    new = np.ones(len(points[0]), dtype=bool)
    new[1:] = (np.diff(points[0]) != 0) | (np.diff(points[1]) != 0)
    new[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    offsets, points = _kept(offsets, points, new)
    n = np.diff(offsets)
    some = np.flatnonzero(n > 1)
    lo, last = offsets[some], offsets[some + 1] - 1
    open_end = np.ones(len(points[0]), dtype=bool)
    open_end[last[(points[0][lo] == points[0][last]) & (points[1][lo] == points[1][last])]] = False
    offsets, points = _kept(offsets, points, open_end)
    n, lo = np.diff(offsets), offsets[:-1]
    closed = np.where(n >= 3, n + 1, 0)
    out = np.concatenate([[0], np.cumsum(closed)])
    place = np.arange(out[-1]) - np.repeat(out[:-1], closed)
    take = np.repeat(lo, closed) + place % np.repeat(np.maximum(n, 1), closed)
    return out, [v[take] for v in points]


def clip_ring(ring: Column, extent: int) -> Column:
    """The ring clipped to 0..extent, rounded half up, repeats dropped and closed; null if it vanishes. A null ring, one of
    fewer than three points and one with a null or infinite coordinate give null. A batch of rings is clipped at once."""

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def clip(rings: pa.Array) -> pa.Array:
        flat, counts = pc.list_flatten(rings), pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
        points = [pc.struct_field(flat, c).cast("float64").to_numpy(zero_copy_only=False) for c in "xy"]
        offsets, (x, y) = clip_arrays(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), points, extent)
        values = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=pa.array(np.diff(offsets) == 0))

    return clip(ring)
