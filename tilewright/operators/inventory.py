"""Inventories as sets: semi and anti joins, audits, unions with precedence and constraints that return violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def healthy(assets: DataFrame) -> DataFrame:
    return assets.where((F.col("state") == "uploaded") & (F.coalesce("size", F.lit(0)) > 0))


def available(plan: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    return plan.join(healthy(assets).select(key), key, "left_semi")


def missing(plan: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    return plan.join(healthy(assets).select(key), key, "left_anti")


def audit(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, verdict): match, mismatch, missing or unexpected."""
    e = expected.select(key, F.col(value).alias("_e"), F.lit(True).alias("_in_e"))
    a = actual.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    verdict = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_e")), "mismatch").otherwise("match")
    return e.join(a, key, "full").select(key, verdict.alias("verdict"))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def override(base: DataFrame, surface: DataFrame, column: str, owned: list[str]) -> DataFrame:
    """base without the owned values, then surface, which is the authority for them."""
    return base.where(~F.col(column).isin(owned)).unionByName(surface)


def replace(rows: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Rows that have children (children.of) give way to them."""
    return rows.join(children.select(F.col("of").alias(key)).distinct(), key, "left_anti").unionByName(children.drop("of"))


def classified(parts: list[tuple[DataFrame, Column | None, str]]) -> DataFrame:
    """(class) of each row of each part that passes its filter; all are kept, repeated ones too."""
    out = None
    for rows, keep, name in parts:
        own = (rows if keep is None else rows.where(keep)).select(F.lit(name).alias("class"))
        out = own if out is None else out.unionByName(own)
    return out


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by order: min_by reduces before rows move, where a window would not."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def update_from(base: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with columns taken from other where its key is there; unmatched rows pass through."""
    o = other.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return base.join(o, keys, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def mandatory(base: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base whose key the dimension doesn't have; a join that must match is right where this is empty."""
    return base.join(dimension.select(*keys).distinct(), keys, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Keys with more than one content."""
    return rows.select(key, content.alias("_c")).groupBy(key).agg(F.count_distinct("_c").alias("contents")).where("contents > 1")


def archive_check(tiles: DataFrame, key: str, required: list[str], max_zoom: int) -> DataFrame:
    """(key, min_zoom, max_zoom, missing, valid) of archives of tiles (key, z, layer)."""
    a = tiles.groupBy(key).agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.collect_set("layer").alias("_l"))
    gone = F.sort_array(F.array_except(F.array(*map(F.lit, required)), F.col("_l")))
    return a.select(key, "min_zoom", "max_zoom", gone.alias("missing"), ((F.col("min_zoom") == 0) & (F.col("max_zoom") >= max_zoom) & (F.size(gone) == 0)).alias("valid"))


def manifest(regions: DataFrame, version: int = 2) -> DataFrame:
    """One row: the manifest of an inventory of regions as JSON, and how many they are. A region is an entry of one file."""
    ordered = F.sort_array(F.collect_list(F.struct("id", "asset"))).alias("regions")
    return regions.agg(F.to_json(F.struct(F.lit(version).alias("version"), ordered)).alias("manifest"), F.count("*").alias("available"))


def build_status(plan: DataFrame, available: DataFrame, phase: str) -> DataFrame:
    """One row (status): JSON of a build's state: regions of plan (id, continent) that are planned, by continent in order
    of names, those whose id available has, and those that are missing, by id."""
    have = available.select("id").distinct().withColumn("there", F.lit(True))
    met = plan.select("id", "continent").join(have, "id", "left")
    by = F.sort_array(F.collect_list(F.struct("continent", "n")))
    continents = met.groupBy("continent").agg(F.count("*").alias("n"), F.count("there").alias("there"), F.collect_list(F.when(F.col("there").isNull(), F.col("id"))).alias("missing"))
    whole = continents.agg(F.sum("n").alias("planned"), F.sum("there").alias("available"), by.alias("by"), F.sort_array(F.flatten(F.collect_list("missing"))).alias("missing"))
    status = F.struct(F.lit(1).alias("version"), F.lit(phase).alias("phase"), F.col("planned").alias("plannedRegionCount"), F.map_from_entries("by").alias("plannedByContinent"), F.col("available").alias("availableRegionCount"), F.size("missing").alias("missingRegionCount"), F.col("missing").alias("missingRegions"), (F.size("missing") == 0).alias("complete"))
    return whole.select(F.to_json(status).alias("status"))
