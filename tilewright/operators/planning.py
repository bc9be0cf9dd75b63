"""Planning of regions: hierarchies, covering bounds, grid splits and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import text as X
from tilewright.functions import tilemath as T
from tilewright.plans.storage import durable


def ancestors_root(nodes: DataFrame, id_: str = "id", parent: str = "parent", stop: Column | None = None) -> DataFrame:
    """(id, root, depth): the topmost ancestor, or the nearest ancestor-or-self where stop holds; null root and depth for
    nodes whose ancestors form a cycle.

    Pointers double each round, so a chain of n nodes takes log2(n) equi-joins instead of n. Each round is written to the
    shared folder, so that a plan doesn't hold the rounds before it. Rounds go on until all have arrived or depths are
    beyond the number of nodes, which only a cycle reaches.
    """
    halt = F.col("parent").isNull() if stop is None else (stop | F.col("parent").isNull())
    p = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("parent"), *([] if stop is None else [c for c in nodes.columns if c not in (id_, parent)]))
    p = p.select("id", F.when(halt, F.col("id")).otherwise(F.col("parent")).alias("up"), F.when(halt, 0).otherwise(1).cast("long").alias("depth"), F.coalesce(halt, F.lit(False)).alias("done"))
    known = p.select(F.col("id").alias("up"), F.col("done").alias("ends"))
    # a parent that isn't in the table ends the chain; done: the pointer has arrived
    p = durable(p.join(known, "up", "left").select("id", F.when(F.col("ends").isNotNull(), F.col("up")).otherwise(F.col("id")).alias("up"), F.when(F.col("ends").isNotNull(), F.col("depth")).otherwise(0).cast("long").alias("depth"), (F.col("done") | F.coalesce(F.col("ends"), F.lit(True))).alias("done")))
    left, reach = p.agg(F.count("*"), F.count_if(~F.col("done"))).first(), 1
    while left[1] and reach < left[0]:
        step = p.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("done").alias("arrived"))
        moving = p.where("NOT done").join(step, "up").select("id", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("arrived").alias("done"))
        p = durable(p.where("done").unionByName(moving))
        left, reach = p.agg(F.count("*"), F.count_if(~F.col("done"))).first(), reach * 2
    return p.select("id", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def leaves(nodes: DataFrame, wanted: Column) -> DataFrame:
    """(id) of wanted nodes of (id, parent, ...) without a wanted descendant at any depth, themselves aside in a cycle.
    Each round marks what is as far above again as the rounds before; it is written, and ends when nothing is new."""
    up = nodes.select("id", F.col("parent").alias("up")).where("up IS NOT NULL")
    above = durable(nodes.where(wanted).join(up, "id").select(F.col("up").alias("id")).distinct())
    n = above.count()
    while True:
        # pointers of 1, 2, 4 ... steps: all ancestors within the sum of them are marked
        grown = durable(above.unionByName(above.join(up, "id").select(F.col("up").alias("id"))).distinct())
        up = durable(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up")))
        before, n, above = n, grown.count(), grown
        if n == before:
            break
    return nodes.where(wanted).select("id").join(above, "id", "left_anti")


def covering_bounds(points: DataFrame, key: str) -> DataFrame:
    """(key, west, south, east, north) of points (key, lon, lat): the narrowest box, across the antimeridian if need be.

    The largest gap between neighbours on the circle is left out, the first of equal ones; boxes wider than 300 degrees
    become the whole circle.
    """
    p = points.select(key, T.normalize_360(F.col("lon")).alias("m"), "lat")
    w = Window.partitionBy(key).orderBy("m")
    distinct = p.select(key, "m").distinct()
    gaps = distinct.withColumn("next", F.coalesce(F.lead("m").over(w), F.min("m").over(Window.partitionBy(key)) + 360.0)).withColumn("gap", F.col("next") - F.col("m"))
    best = gaps.groupBy(key).agg(F.max_by(F.struct("m", "next", "gap"), F.struct("gap", -F.col("m"))).alias("b"))
    lats = p.groupBy(key).agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    width = 360.0 - F.col("b.gap")
    return best.join(lats, key).select(
        key, F.when(width > 300.0, F.lit(-180.0)).otherwise(F.round(T.signed_longitude(T.normalize_360(F.col("b.next"))), 6)).alias("west"), "south",
        F.when(width > 300.0, F.lit(180.0)).otherwise(F.round(T.signed_longitude(F.col("b.m")), 6)).alias("east"), "north",
    )


def grid_dimensions(plan: DataFrame, target: int, most: int = 24, least: int = 4) -> DataFrame:
    """plan (id, west, south, east, north, size) with cells, grid_columns, grid_rows."""
    unwrapped = F.when(F.col("east") < F.col("west"), F.col("east") + 360.0).otherwise(F.col("east"))
    lon_span = F.greatest(unwrapped - F.col("west"), F.lit(0.001))
    lat_span = F.greatest(F.col("north") - F.col("south"), F.lit(0.001))
    aspect = lon_span * F.greatest(F.lit(0.2), F.cos(F.radians((F.col("north") + F.col("south")) / 2))) / lat_span
    wanted = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.col("size") / float(target)))).cast("long")
    p = plan.withColumn("cells", wanted).withColumn("grid_columns", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("cells") * aspect))).cast("long"))
    return p.withColumn("grid_rows", F.greatest(F.lit(1), F.ceil(F.col("cells") / F.col("grid_columns"))).cast("long"))


def grid_split(plan: DataFrame) -> DataFrame:
    """(id, parent_id, west, south, east, north): the cells of each region with dimensions; one across the
    antimeridian becomes two, -s1 and -s2."""
    unwrapped = F.when(F.col("east") < F.col("west"), F.col("east") + 360.0).otherwise(F.col("east"))
    p = plan.withColumn("right", unwrapped)
    p = p.withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("grid_rows")))).withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("grid_columns"))))
    at = lambda low, high, k, n: F.when(k == n, high).otherwise(low + (high - low) * k / n)
    p = p.withColumn("w", at(F.col("west"), F.col("right"), F.col("c") - 1, F.col("grid_columns"))).withColumn("e", at(F.col("west"), F.col("right"), F.col("c"), F.col("grid_columns")))
    p = p.withColumn("s", at(F.col("south"), F.col("north"), F.col("r") - 1, F.col("grid_rows"))).withColumn("n", at(F.col("south"), F.col("north"), F.col("r"), F.col("grid_rows")))
    name = F.concat(F.col("id"), F.lit("--r"), F.col("r").cast("string"), F.lit("-c"), F.col("c").cast("string"))
    piece = lambda suffix, a, b: F.struct(F.concat(name, F.lit(suffix)).alias("id"), a.alias("west"), b.alias("east"))
    low, high = T.signed_longitude(F.col("w")), T.signed_longitude(F.col("e"))
    crossing = (F.col("w") < 180.0) & (F.col("e") > 180.0)
    p = p.withColumn("piece", F.explode(F.when(crossing, F.array(piece("-s1", F.col("w"), F.lit(180.0)), piece("-s2", F.lit(-180.0), high))).otherwise(F.array(piece("", F.when(F.col("w") >= 180.0, F.col("w") - 360.0).otherwise(low), high)))))
    return p.select(F.col("piece.id").alias("id"), F.col("id").alias("parent_id"), F.round("piece.west", 6).alias("west"), F.round("s", 6).alias("south"), F.round("piece.east", 6).alias("east"), F.round("n", 6).alias("north"))


def pinned_split(plan: DataFrame, splits: DataFrame) -> DataFrame:
    """plan (id, slug, name, west, south, east, north) with the regions that splits (id, rows, columns, generation,
    antimeridian) names replaced by their cells: ids get the generation, row and column, and -s1 or -s2 for the halves of a
    cell across the antimeridian. parent is the region that was split, null for others.

    splits is a short list that is written by hand.
    """
    cols = ["id", "slug", "name", "west", "south", "east", "north"]
    p = plan.select(*cols).join(splits.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    kept = p.where("_id IS NULL").select(*cols, F.lit(None).cast(plan.schema["id"].dataType).alias("parent"))
    t = p.where("_id IS NOT NULL").withColumn("right", F.when(F.col("antimeridian") & (F.col("east") < F.col("west")), F.col("east") + 360.0).otherwise(F.col("east")))
    t = t.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("rows")))).withColumn("c", F.explode(F.sequence(F.lit(1), F.col("columns"))))
    at = lambda low, high, k, n: low + (high - low) / n * k
    t = t.withColumn("w", at(F.col("west"), F.col("right"), F.col("c") - 1, F.col("columns"))).withColumn("e", F.when(F.col("c") == F.col("columns"), F.col("right")).otherwise(at(F.col("west"), F.col("right"), F.col("c"), F.col("columns"))))
    t = t.withColumn("s", at(F.col("south"), F.col("north"), F.col("r") - 1, F.col("rows"))).withColumn("n", F.when(F.col("r") == F.col("rows"), F.col("north")).otherwise(at(F.col("south"), F.col("north"), F.col("r"), F.col("rows"))))
    piece = lambda suffix, a, b: F.struct(F.lit(suffix).alias("suffix"), a.alias("west"), b.alias("east"))
    back = lambda x: x - 360.0
    halves = F.array(piece("-s1", F.col("w"), F.lit(180.0)), piece("-s2", F.lit(-180.0), back(F.col("e"))))
    pieces = F.when(F.col("antimeridian") & (F.col("w") < 180.0) & (F.col("e") > 180.0), halves).when(F.col("antimeridian") & (F.col("w") >= 180.0), F.array(piece("", back(F.col("w")), back(F.col("e"))))).otherwise(F.array(piece("", F.col("w"), F.col("e"))))
    t = t.withColumn("p", F.explode(pieces))
    end = F.concat(F.lit("--"), F.col("generation"), F.lit("-r"), F.col("r").cast("string"), F.lit("-c"), F.col("c").cast("string"), F.col("p.suffix"))
    name = F.concat(F.col("name"), F.lit(" split "), F.col("r").cast("string"), F.lit("."), F.col("c").cast("string"), F.col("p.suffix"))
    cells = t.select(F.concat("id", end).alias("id"), F.concat("slug", end).alias("slug"), name.alias("name"), F.round("p.west", 6).alias("west"), F.round("s", 6).alias("south"), F.round("p.east", 6).alias("east"), F.round("n", 6).alias("north"), F.col("id").alias("parent"))
    return kept.unionByName(cells)


def base_plan(index: DataFrame, roots: list[str], prefix: str, scope: str = "all") -> DataFrame:
    """(id, slug, name, continent, pbf_url, west, south, east, north, asset_name, metadata_name), by id: the regions of an
    index (id, parent, name, pbf_url, bounds) that have an extract and bounds and no extract at any depth below them.

    continent: the nearest of roots above, or the region itself; scope: all, or one continent or region.
    """
    found = ancestors_root(index.select("id", "parent"), stop=F.col("id").isin(roots)).select("id", F.when(F.col("root").isin(roots), F.col("root")).otherwise(F.col("id")).alias("continent"))
    free = leaves(index.select("id", "parent", "pbf_url"), F.col("pbf_url").isNotNull())
    plan = index.where("pbf_url IS NOT NULL AND bounds IS NOT NULL").join(free, "id", "left_semi").join(found, "id")
    if scope != "all":
        plan = plan.where((F.col("continent") == scope) | (F.col("id") == scope))
    plan = plan.withColumn("slug", X.slugify(F.col("id"))).withColumn("_a", X.asset_names(F.col("slug"), prefix))
    return plan.select("id", "slug", F.coalesce("name", "id").alias("name"), "continent", "pbf_url", *(F.col(f"bounds.{c}").alias(c) for c in ("west", "south", "east", "north")), "_a.asset_name", "_a.metadata_name").orderBy("id")


def plan_json(plan: DataFrame, path: str) -> None:
    """A plan as lines of JSON, an entry a line, in order of id."""
    plan.orderBy("id").write.json(path)


def coordinates(geometry: Column) -> Column:
    """The (lon, lat) pairs of a geometry's JSON, whatever their depth: the innermost arrays that begin with two numbers."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    inner = F.regexp_extract_all(geometry, F.lit(rf"\[\s*{number}\s*,\s*{number}\s*(?:,[^\[\]]*)?\]"), F.lit(0))
    part = lambda p, k: F.regexp_extract(p, rf"\[\s*{number}\s*,\s*{number}", k).try_cast("double")
    return F.transform(inner, lambda p: F.struct(part(p, 1).alias("lon"), part(p, 2).alias("lat")))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent, name, pbf_url, bounds) of a region index, a FeatureCollection: bounds is the narrowest box around a
    geometry's points, across the antimeridian if need be; null without a geometry."""
    from tilewright.sources.archives import read_features

    f = read_features(spark, path).select(F.get_json_object("properties", "$.id").alias("id"), F.get_json_object("properties", "$.parent").alias("parent"), F.get_json_object("properties", "$.name").alias("name"), F.get_json_object("properties", "$.urls.pbf").alias("pbf_url"), "geometry")
    f = f.where("id IS NOT NULL")
    points = f.select("id", F.explode(coordinates(F.get_json_object("geometry", "$.coordinates"))).alias("p")).select("id", "p.lon", "p.lat")
    boxes = covering_bounds(points, "id").select("id", F.struct("west", "south", "east", "north").alias("bounds"))
    return f.drop("geometry").join(boxes, "id", "left")


def buckets(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """rows with bucket: round robin over the order.

    A range sort makes partitions that follow each other; they are numbered and counted, and rows then count on within
    theirs, so no task orders everything. The sorted rows are kept once, as both reads must see the same partitions.
    """
    ranged = durable(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    numbered = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = ranged.groupBy("part").count()
    starts = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return numbered.join(starts, "part").withColumn("bucket", ((F.col("start") + F.col("k") - 1) % n).cast("long")).drop("part", "k", "start")
