"""Registration of queries with their SQL, and the inputs that are derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    """Registers a function (read) -> DataFrame under its name; read(table) opens a table of the input folder."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def also(name: str, whole: str) -> None:
    """The query `whole` under an earlier name, which took a part of its table."""
    QUERIES[name] = QUERIES[whole]
    SQL[name] = SQL[whole]


# derived inputs, the same formula in both engines


def points(read) -> DataFrame:
    i = F.col("event_id")
    return read("events").select("event_id", "user_id", ((i * 7919) % 360000 / 1000.0 - 180.0).alias("lon"), ((i * 104729) % 170000 / 1000.0 - 85.0).alias("lat"))


POINTS = "points AS (SELECT event_id, user_id, (event_id * 7919) % 360000 / 1000.0 - 180.0 AS lon, (event_id * 104729) % 170000 / 1000.0 - 85.0 AS lat FROM events)"


def regions(read) -> DataFrame:
    k = F.col("n_nationkey")
    west = ((k * 37) % 360 - 180).cast("double")
    east = F.when(west + 40 > 180, west + 40 - 360).otherwise(west + 40)
    south = ((k * 13) % 120 - 70).cast("double")
    return read("nation").select(F.concat(F.lit("r"), k.cast("string")).alias("asset"), west.alias("west"), south.alias("south"), east.alias("east"), (south + 30).alias("north"))


REGIONS = """regions AS (SELECT 'r' || n_nationkey AS asset, CAST((n_nationkey * 37) % 360 - 180 AS DOUBLE) AS west, CAST((n_nationkey * 13) % 120 - 70 AS DOUBLE) AS south,
  CASE WHEN (n_nationkey * 37) % 360 - 180 + 40 > 180 THEN CAST((n_nationkey * 37) % 360 - 180 + 40 - 360 AS DOUBLE) ELSE CAST((n_nationkey * 37) % 360 - 180 + 40 AS DOUBLE) END AS east,
  CAST((n_nationkey * 13) % 120 - 70 + 30 AS DOUBLE) AS north FROM nation)"""


def sql_x(lon: str, z) -> str:
    norm = f"(CASE WHEN {lon} = 180 THEN 180.0 ELSE ({lon} + 180.0) - 360.0 * floor(({lon} + 180.0) / 360.0) - 180.0 END)"
    return f"CAST(greatest(0, least(floor(({norm} + 180.0) / 360.0 * pow(2.0, {z})), pow(2.0, {z}) - 1)) AS BIGINT)"


def sql_y(lat: str, z) -> str:
    return f"CAST(greatest(0, least(floor((1 - asinh(tan(radians(least(greatest({lat}, -85.0511287798066), 85.0511287798066)))) / pi()) / 2 * pow(2.0, {z})), pow(2.0, {z}) - 1)) AS BIGINT)"


def sql_lat(y: str, z) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y}) / pow(2.0, {z})))))"


SEGMENTS = """clamped AS (SELECT asset, west, east, greatest(least(south, 85.0511287798066), -85.0511287798066) AS south, greatest(least(north, 85.0511287798066), -85.0511287798066) AS north FROM regions),
segments AS (SELECT asset, west, south, east, north FROM clamped WHERE west <= east AND south < north
  UNION ALL SELECT asset, west, south, 180.0, north FROM clamped WHERE west > east AND south < north
  UNION ALL SELECT asset, -180.0, south, east, north FROM clamped WHERE west > east AND south < north)"""
