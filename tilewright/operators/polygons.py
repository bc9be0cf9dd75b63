"""Points in any polygon, points near lines, and the points that stand for polygons; built-in functions alone.

A polygon is a list of rings of struct(x, y), closed or not; even-odd over all its rings decides what is inside, so holes
and islands need no marks. Polygons meet points on the cells of a grid that their boxes cover; then their edges, exploded
over the bands of rows that they cross, meet the points of a band, and the parity of crossings is a sum over that
equi-join. No geometry is tested against all others, and a long ring is spread over bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import let
from tilewright.plans.storage import durable, partitions

RINGS = "array<array<struct<x:double,y:double>>>"


def _axis(rings: Column, c: str) -> Column:
    return F.transform(F.flatten(rings), lambda p: p[c])


def unwrapped(rings: Column) -> Column:
    """Rings whose box would be wider than 180 degrees lie across the antimeridian: their western points move by 360."""
    xs = _axis(rings, "x")
    wide = F.array_max(xs) - F.array_min(xs) > 180
    moved = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.when(p["x"] < 0, p["x"] + 360.0).otherwise(p["x"]).alias("x"), p["y"].alias("y"))))
    return F.when(wide, moved).otherwise(rings)


def edges_of(polygons: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, x1, y1, x2, y2) of each edge; open rings are closed, edges along a row and rings of fewer than three points
    add nothing."""
    ring = polygons.select(key, F.explode(rings).alias("ring")).where(F.size("ring") >= 3)
    pairs = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return ring.select(key, F.explode(pairs).alias("e")).select(key, "e.*").where("y1 <> y2")


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def points_in_polygons(points: DataFrame, polygons: DataFrame, point: str, polygon: str, rings: str = "rings", cell: float = 1.0, wraps: bool = True) -> DataFrame:
    """(point, polygon) of points (point, x, y) inside polygons (polygon, rings).

    A point on a lower or left edge is inside, on an upper or right one outside, as even-odd with half-open edges has it.
    wraps: x are longitudes; polygons across the antimeridian hold points of both sides. Points without coordinates and
    polygons without rings are in nothing. cell: about the width of a middling polygon. An id has one polygon.

    Polygons of equal rings are tested once, under the least of their ids, and meet what is in them at the end. Files say
    little about the rows that cells and edges become, so none of these joins may broadcast.
    """
    first = "_first"
    own = polygons.select(polygon, (unwrapped(F.col(rings)) if wraps else F.col(rings)).alias("rings")).where(F.size(F.flatten("rings")) > 0)
    own = own.select(polygon, F.xxhash64("rings").alias("_a"), F.xxhash64(F.lit(1), "rings").alias("_b"), "rings")
    own = durable(own.repartition(partitions(own.sparkSession, own), "_a", "_b"))
    shapes = durable(own.groupBy("_a", "_b", "rings").agg(F.min(polygon).alias(first)))
    members = own.join(shapes.withColumnRenamed("rings", "_r").hint("shuffle_hash"), ["_a", "_b"]).where(F.col("rings") == F.col("_r")).select(first, polygon).distinct()
    xs, ys = _axis(F.col("rings"), "x"), _axis(F.col("rings"), "y")
    boxes = shapes.select(first, F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    covered = boxes.withColumn("cx", F.explode(_cells(F.col("x0"), F.col("x1"), cell))).withColumn("cy", F.explode(_cells(F.col("y0"), F.col("y1"), cell)))
    placed = points.select(point, "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    if wraps:  # a western point is looked for east of 180 too
        placed = placed.unionByName(placed.where("x < 0").withColumn("x", F.col("x") + 360.0))
    near = placed.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)}).join(covered.hint("merge"), ["cx", "cy"])
    near = near.where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1").select(point, first, "x", "y", "cy")
    edges = edges_of(shapes, first, "rings").withColumn("cy", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), cell)))
    crossed = near.join(edges.hint("merge"), [first, "cy"]).where("(y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1")
    held = crossed.groupBy(point, first, "x", "y").count().where("count % 2 = 1").select(point, first).distinct()
    return held.join(members.hint("merge"), first).select(point, polygon)


def points_near_lines(points: DataFrame, lines: DataFrame, point: str, line: str, radius: float, geom: str = "geom") -> DataFrame:
    """(point, line, distance) of points (point, x, y) no further than radius from lines (line, geom: parts of points), the
    least distance of each pair. Segments meet points on cells as wide as the radius reaches; a part of one point is one."""
    part = lines.select(line, F.explode(geom).alias("part")).where(F.size("part") > 0)
    pairs = F.zip_with("part", F.concat(F.slice("part", 2, F.size("part")), F.slice("part", -1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    segments = part.select(line, F.explode(pairs).alias("e")).select(line, "e.*")
    cell = max(radius * 4, 1e-9)
    reach = lambda a, b: _cells(F.least(a, b) - radius, F.greatest(a, b) + radius, cell)
    spread = segments.withColumn("cx", F.explode(reach("x1", "x2"))).withColumn("cy", F.explode(reach("y1", "y2")))
    placed = points.select(point, "x", "y").withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    length = "((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
    along = F.expr(f"CASE WHEN {length} > 0 THEN least(1.0D, greatest(0.0D, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / {length})) ELSE 0.0D END")
    met = placed.join(spread, ["cx", "cy"]).withColumn("t", along)
    away = F.expr("sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))")
    return met.select(point, line, away.alias("distance")).where(F.col("distance") <= radius).groupBy(point, line).agg(F.min("distance").alias("distance"))


def _cross(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))


def _total(of: Column, pick) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda s, p: s + pick(p))


def centroid(rings: Column) -> Column:
    """struct(x, y): the centre of the first ring's area less that of all further rings, which are holes whichever way they
    turn; the mean of the first ring's points where no area is left; null without points."""

    def sums(ring: Column) -> Column:
        """Twice the area of a ring and its moments, with the sign that makes areas positive."""

        def signed(v):
            turn = F.when(v["a"] < 0, -1.0).otherwise(1.0)
            return F.struct((turn * v["a"]).alias("a"), (turn * v["x"]).alias("x"), (turn * v["y"]).alias("y"))

        whole = lambda v: F.struct(_total(v["c"], lambda p: p["c"]).alias("a"), _total(v["c"], lambda p: p["c"] * p["x"]).alias("x"), _total(v["c"], lambda p: p["c"] * p["y"]).alias("y"))
        return let(let(F.struct(_cross(ring).alias("c")), whole), signed)

    def middle(v):
        ring = F.get(v["rings"], F.lit(0))
        axis = lambda c: F.when(v["a"] > 0, v[c] / (3.0 * v["a"])).otherwise(F.try_divide(_total(ring, lambda p: p[c]), F.size(ring).cast("double")))
        return F.when(F.size(F.flatten(v["rings"])) > 0, F.struct(axis("x").alias("x"), axis("y").alias("y")))

    less = lambda each, c: F.aggregate(F.transform(each, lambda s, i: F.when(i == 0, s[c]).otherwise(-s[c])), F.lit(0.0), lambda x, y: x + y)
    together = lambda v: F.struct(v["rings"].alias("rings"), *(less(v["each"], c).alias(c) for c in "axy"))
    # each step is bound once, as what a lambda reads from outside is made anew for every element
    return let(let(F.struct(rings.alias("rings"), F.transform(rings, sums).alias("each")), together), middle)


def point_on_surface(rings: Column) -> Column:
    """struct(x, y): a point inside the polygon: the middle of the widest run of the row that lies halfway between the
    points next to the middle of its box. The first point where the polygon has no area; null without points."""

    def halfway(v):
        return F.struct(v["rings"].alias("rings"), v["ys"].alias("ys"), ((F.array_min(v["ys"]) + F.array_max(v["ys"])) / 2.0).alias("middle"))

    def row_of(v):
        below, above = F.filter(v["ys"], lambda y: y <= v["middle"]), F.filter(v["ys"], lambda y: y > v["middle"])
        return F.struct(v["rings"].alias("rings"), ((F.array_max(below) + F.array_min(above)) / 2.0).alias("row"))

    def crossed(v):
        def crossings(ring: Column) -> Column:
            pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
            cut = F.filter(pairs, lambda e: (e["y1"] > v["row"]) != (e["y2"] > v["row"]))
            return F.transform(cut, lambda e: (e["x2"] - e["x1"]) * (v["row"] - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

        return F.struct(F.get(F.flatten(v["rings"]), F.lit(0)).alias("first"), v["row"].alias("row"), F.sort_array(F.flatten(F.transform(v["rings"], crossings))).alias("xs"))

    def widest_of(v):
        ends = F.filter(F.transform(v["xs"], lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["i"] % 2 == 1)
        # the first of equally wide runs
        runs = F.transform(ends, lambda p: F.struct((p["x"] - F.get(v["xs"], p["i"] - 1)).alias("w"), (-p["i"]).alias("i"), ((p["x"] + F.get(v["xs"], p["i"] - 1)) / 2.0).alias("x")))
        return F.struct(v["first"].alias("first"), v["row"].alias("row"), F.array_max(runs).alias("widest"))

    def chosen(v):
        inside, first = F.struct(v["widest"]["x"].alias("x"), v["row"].alias("y")), F.struct(v["first"]["x"].alias("x"), v["first"]["y"].alias("y"))
        return F.when(v["first"].isNotNull(), F.when(v["widest"]["w"] > 0, inside).otherwise(first))

    out = F.struct(rings.alias("rings"), _axis(rings, "y").alias("ys"))
    for step in (halfway, row_of, crossed, widest_of, chosen):
        out = let(out, step)
    return out


def rule_geometry(geom: Column, kind: Column, rule: Column) -> Column:
    """The geometry that a rule of the profile names, as parts of points: centroids and points on the surface of polygons,
    and the element's own geometry for all other rules and kinds."""
    one = lambda p: F.when(p.isNotNull(), F.array(F.array(p)))
    polygon = kind == "polygon"
    return F.when(polygon & rule.isin("centroid", "polygon_centroid"), one(centroid(geom))).when(polygon & (rule == "polygon_point_on_surface"), one(point_on_surface(geom))).otherwise(geom)
