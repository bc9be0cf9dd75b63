"""Tiles to the regions that they overlap.

From the routing zoom on, regions are exploded into the cells they cover, so that the range join becomes an equi-join
on the cell with a residual overlap test: no nested loop, and both sides can be shuffled by cell. Below that zoom there
are fewer than 4**routing_zoom / 3 distinct tiles; those are broadcast, a bound that doesn't depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tilemath as T

ROUTING_ZOOM = 6
FANOUT = 64


def region_segments(regions: DataFrame) -> DataFrame:
    """A row for each segment: (region columns, seg_west, seg_south, seg_east, seg_north)."""
    s = regions.withColumn("segment", F.explode(T.segments(*(F.col(c) for c in ("west", "south", "east", "north")))))
    return s.select(*regions.columns, *(F.col(f"segment.{c}").alias(f"seg_{c}") for c in ("west", "south", "east", "north")))


def region_cells(regions: DataFrame, zoom: int = ROUTING_ZOOM, wide: bool = False) -> DataFrame:
    """Segments with cell_x and cell_y, a row for each cell covered; wide: the cell that starts on the east edge as well."""
    z = F.lit(zoom)
    last = F.when(F.col("seg_east") == 180.0, F.lit(180.0)).otherwise(F.greatest(F.col("seg_west"), F.col("seg_east") - (0.0 if wide else T.EPSILON)))
    # 180 itself wraps to the first column, so the last column is named directly
    right = F.when(last == 180.0, F.lit(2**zoom - 1).cast("long")).otherwise(T.tile_x(last, z))
    s = region_segments(regions)
    s = s.withColumn("cell_x", F.explode(F.sequence(F.least(T.tile_x(F.col("seg_west"), z), right), right)))
    return s.withColumn("cell_y", F.explode(F.sequence(T.tile_y(F.col("seg_north"), z), T.tile_y(F.col("seg_south"), z))))


def cell_fanout(cells: DataFrame, limit: int = FANOUT) -> DataFrame:
    """(cell_x, cell_y, regions, over): how many regions a cell has and whether that is beyond the limit."""
    return cells.groupBy("cell_x", "cell_y").agg(F.count_distinct("asset").alias("regions")).withColumn("over", F.col("regions") > limit)


def _hit(z: Column, x: Column, y: Column) -> Column:
    return T.overlaps(T.tile_bounds(z, x, y), {c: F.col(f"seg_{c}") for c in ("west", "south", "east", "north")})


def route(tiles: DataFrame, regions: DataFrame, zoom: int = ROUTING_ZOOM, max_zoom: int = 16, keep: list[str] | None = None) -> DataFrame:
    """(z, x, y, asset) of distinct tiles of the routing zoom or deeper; tiles out of range route nowhere. keep: columns of
    tiles that are distinct already, which come along."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    own = tiles.select("z", "x", "y", *(keep or ())).where(T.tile_valid(z, x, y, max_zoom) & (z >= zoom))
    own = own if keep is not None else own.distinct()
    own = own.withColumn("cell_x", F.expr(f"shiftright(x, z - {zoom})")).withColumn("cell_y", F.expr(f"shiftright(y, z - {zoom})"))
    return own.join(region_cells(regions, zoom), ["cell_x", "cell_y"]).where(_hit(z, x, y)).select("z", "x", "y", *(keep or ()), "asset").distinct()


def route_overview(tiles: DataFrame, regions: DataFrame, zoom: int = ROUTING_ZOOM) -> DataFrame:
    """(z, x, y, asset) of tiles above the routing zoom, where each region is a candidate."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    few = tiles.select("z", "x", "y").where(T.tile_valid(z, x, y, zoom - 1)).distinct()
    return region_segments(regions).join(F.broadcast(few), _hit(z, x, y)).select("z", "x", "y", "asset").distinct()
