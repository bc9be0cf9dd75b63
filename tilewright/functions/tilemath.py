"""Web-Mercator tile arithmetic as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LATITUDE = 85.0511287798066
#: Boxes that only touch don't overlap.
EPSILON = 1e-10
WORLD_EXTENT = 4096


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, _lit(low)), _lit(high))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def normalize_longitude(lon: Column) -> Column:
    """Into [-180, 180), except that 180 stays."""
    return F.when(lon == 180.0, F.lit(180.0)).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def cells(zoom: Column) -> Column:
    """Tiles along one side."""
    return F.pow(F.lit(2.0), zoom)


def tile_x(lon: Column, zoom: Column) -> Column:
    at = F.floor((normalize_longitude(lon) + 180.0) / 360.0 * cells(zoom))
    return F.greatest(F.least(at, (cells(zoom) - 1).cast("long")), F.lit(0)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    north = clamp(lat, -MAX_LATITUDE, MAX_LATITUDE)
    at = F.floor((1 - F.asinh(F.tan(F.radians(north))) / F.pi()) / 2 * cells(zoom))
    return F.greatest(F.least(at, (cells(zoom) - 1).cast("long")), F.lit(0)).cast("long")


def sample_tile(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """The variant for samplers: longitudes aren't wrapped and latitudes clamp a little earlier."""
    x = F.floor((lon + 180.0) / 360.0 * cells(zoom))
    y = F.floor((1 - F.asinh(F.tan(F.radians(clamp(lat, -85.05112878, 85.05112878)))) / F.pi()) / 2 * cells(zoom))
    top = (cells(zoom) - 1).cast("long")
    return F.greatest(F.least(x, top), F.lit(0)), F.greatest(F.least(y, top), F.lit(0))


def tile_latitude(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / cells(zoom)))))


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    return {"west": x / cells(z) * 360.0 - 180.0, "south": tile_latitude(y + 1, z), "east": (x + 1) / cells(z) * 360.0 - 180.0, "north": tile_latitude(y, z)}


def tile_valid(z: Column, x: Column, y: Column, max_zoom: int) -> Column:
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.least(z, F.lit(max_zoom)), F.lit(0)).cast("int"))
    return F.coalesce(z.between(0, max_zoom) & (x >= 0) & (y >= 0) & (x < side) & (y < side), F.lit(False))


def bounds_valid(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Finite, in range and south of north; west may be east of east (across the antimeridian)."""
    good = lambda v, most: v.isNotNull() & ~F.isnan(v) & v.between(-most, most)
    return F.coalesce(good(west, 180.0) & good(east, 180.0) & good(south, 90.0) & good(north, 90.0) & (south < north), F.lit(False))


def tms_row(z: Column, y: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int")) - 1 - y


def segments(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Boxes of a region that don't cross the antimeridian: one, or two, or none if it has no height."""
    w, e = normalize_longitude(west), normalize_longitude(east)
    s, n = clamp(south, -MAX_LATITUDE, MAX_LATITUDE), clamp(north, -MAX_LATITUDE, MAX_LATITUDE)
    box = lambda a, b: F.struct(a.alias("west"), s.alias("south"), b.alias("east"), n.alias("north"))
    none = F.array().cast("array<struct<west:double,south:double,east:double,north:double>>")
    return F.when(s >= n, none).when(w <= e, F.array(box(w, e))).otherwise(F.array(box(w, F.lit(180.0)), box(F.lit(-180.0), e)))


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["west"] < b["east"] - EPSILON) & (a["east"] > b["west"] + EPSILON) & (a["south"] < b["north"] - EPSILON) & (a["north"] > b["south"] + EPSILON)


def normalize_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def signed_longitude(lon: Column) -> Column:
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


def interpolate_between(a: Column, b: Column, at: Column, va: Column, vb: Column) -> Column:
    """Value at a place between two; the first value where both places are one."""
    return F.when(a == b, va).otherwise(va + (vb - va) * (at - a) / (b - a))


def piecewise(value: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between (input, output) stops, constant beyond."""
    out = F.when(value <= stops[0][0], F.lit(float(stops[0][1])))
    for (a, va), (b, vb) in zip(stops, stops[1:], strict=False):
        out = out.when(value <= b, F.lit(float(va)) + F.lit(float(vb - va)) * (value - F.lit(float(a))) / F.lit(float(b - a)))
    return out.otherwise(F.lit(float(stops[-1][1])))


def globe_radius(zoom: Column) -> Column:
    return F.lit(512.0) * F.pow(F.lit(2.0), zoom) / (2 * F.pi())


def pixel_ratio(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (value <= 0), F.lit(2.0)).otherwise(clamp(value, 2.0, 3.0))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def bounded_integer(text: Column, fallback: int, low: int, high: int) -> Column:
    """A whole number in range, else the fallback (never the nearest bound)."""
    number = text.cast("string").try_cast("double")
    whole = F.when(number == F.floor(number), number)
    return F.when(whole.between(low, high), whole.cast("long")).otherwise(F.lit(fallback).cast("long"))


def backoff_ms(attempt: Column, base: int, most: int, noise: Column) -> Column:
    """Delay before retry number attempt (from 1): doubles, stops at most, times 0.75 to 1.25."""
    return round_half_up(F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)) * (F.lit(0.75) + F.lit(0.5) * noise)).cast("long")


# fixed values: kinds of layers that a flat map doesn't draw
UNDRAWN = ["sky", "hillshade", "model", "fill-extrusion"]


def entered_by(minzoom: Column, zoom: int) -> Column:
    """A layer's least zoom, brought down to zoom if it is later; 24 stands for none."""
    return F.least(F.coalesce(minzoom, F.lit(24)), F.lit(zoom))
