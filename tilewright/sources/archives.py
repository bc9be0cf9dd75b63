"""Tile archives, trees of tiles, feature collections and manifests: readers and writers.

Files are read through Spark's binaryFile and text sources, so any file system of the cluster works. A packed SQLite
archive is one file by nature; it is made by one task from rows that are sorted by address, and its bytes are a row.
"""

from __future__ import annotations

import gzip
import io
import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.tilemath import tms_row


def read_tile_tree(spark: SparkSession, path: str, ending: str = "pbf") -> DataFrame:
    """(z, x, y, tile) of files named z/x/y.ending below path; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ending}").load(path)
    pattern = rf"/(\d+)/(\d+)/(\d+)\.{ending}$"
    part = lambda k: F.regexp_extract("path", pattern, k).try_cast("int")
    return files.where(F.col("path").rlike(pattern)).select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), F.col("content").alias("tile"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """A table of tiles by zoom; empty ones are not written. Readers of one zoom skip the others' folders. Ranges of
    addresses are tasks, as the deepest zoom has most tiles."""
    tiles.where(F.octet_length("tile") > 0).repartitionByRange("z", "x", "y").sortWithinPartitions("z", "x", "y").write.partitionBy("z").parquet(path)


def read_tile(spark: SparkSession, path: str, z: int, x: int, y: int, most: int = 16 << 20) -> DataFrame:
    """The tile at an address, if it is within the limit of bytes: zoom prunes folders, x and y reach the scan."""
    return spark.read.parquet(path).where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y) & (F.octet_length("tile") <= most)).limit(1)


def archive_header(tiles: DataFrame) -> DataFrame:
    """(min_zoom, max_zoom, tiles, bytes)."""
    return tiles.agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count("*").alias("tiles"), F.sum(F.octet_length("tile")).alias("bytes"))


def valid_archive(files: DataFrame, magic: bytes = b"PMTiles", least: int = 127, most: int = 2 << 30) -> DataFrame:
    """binaryFile rows with valid: the magic at the start and a size within bounds. Only the start of content is compared."""
    return files.withColumn("valid", (F.substring("content", 1, len(magic)) == F.lit(magic)) & F.col("length").between(least, most))


def _archive(metadata: dict[str, str]) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
    db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
    db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
    db.executemany("INSERT INTO metadata VALUES (?, ?)", sorted(metadata.items()))
    return db


def _insert(db: sqlite3.Connection, batch: pa.RecordBatch) -> None:
    z, x, y, tile = (batch.column(c).to_pylist() for c in ("z", "x", "row", "tile"))
    db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", zip(z, x, y, (gzip.compress(t, 6, mtime=0) for t in tile), strict=True))


def _bytes(db: sqlite3.Connection) -> bytes:
    db.commit()
    data = db.serialize()
    db.close()
    return data


def pack_sqlite(tiles: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """One row (archive): an SQLite archive of tiles (z, x, y, tile) with rows flipped to TMS and tiles compressed.

    For the tiles of one region: a single file holds them, so a single task writes them. Repeated addresses keep one.
    """
    rows = tiles.dropDuplicates(["z", "x", "y"]).select("z", "x", tms_row(F.col("z"), F.col("y")).alias("row"), "tile").coalesce(1).sortWithinPartitions("z", "x", "row")

    def pack(batches):
        db = _archive(metadata)
        for batch in batches:
            _insert(db, batch)
        yield pa.RecordBatch.from_arrays([pa.array([_bytes(db)], pa.binary())], names=["archive"])

    return rows.mapInArrow(pack, "archive binary")


def pack_sqlite_by(tiles: DataFrame, region: str, metadata: dict[str, str]) -> DataFrame:
    """(region, archive): an archive as of pack_sqlite for each value of a long column. Regions meet by exchange and are
    packed one after another; a task holds the archive of one region. Repeated addresses of a region keep one."""
    rows = tiles.select(F.col(region).alias("region"), "z", "x", "y", "tile").repartition("region").dropDuplicates(["region", "z", "x", "y"])
    rows = rows.select("region", "z", "x", tms_row(F.col("z"), F.col("y")).alias("row"), "tile").sortWithinPartitions("region", "z", "x", "row")

    def pack(batches):
        row = lambda at, db: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_bytes(db)], pa.binary())], names=["region", "archive"])
        at = db = None
        for batch in batches:
            keys, start = batch.column("region").to_pylist(), 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if db is None or keys[start] != at:
                        if db is not None:
                            yield row(at, db)
                        at, db = keys[start], _archive(metadata)
                    _insert(db, batch.slice(start, i - start))
                    start = i
        if db is not None:
            yield row(at, db)

    return rows.withColumn("region", F.col("region").cast("long")).mapInArrow(pack, "region long, archive binary")


def unpack_sqlite(archives: DataFrame, column: str = "content") -> DataFrame:
    """(z, x, y, tile) of SQLite archives in a binary column."""

    def unpack(batches):
        for batch in batches:
            for data in batch.column(0):
                db = sqlite3.connect(":memory:")
                db.deserialize(data.as_py())
                cursor = db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles")
                while rows := cursor.fetchmany(1000):
                    z, x, y, tile = zip(*rows, strict=True)
                    plain = [gzip.GzipFile(fileobj=io.BytesIO(t)).read() if t[:2] == b"\x1f\x8b" else t for t in tile]
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x, pa.int32()), pa.array([(1 << a) - 1 - b for a, b in zip(z, y, strict=True)], pa.int32()), pa.array(plain, pa.binary())], names=["z", "x", "y", "tile"])
                db.close()

    return archives.select(column).mapInArrow(unpack, "z int, x int, y int, tile binary")


def read_collection(spark: SparkSession, path: str, geometry: str = "string") -> DataFrame:
    """(file, properties, geometry) of the features of FeatureCollections; features without geometry are left out. A
    document of another type stops the scan. Each file is read once, as a text; a reader of JSON over several lines goes
    through a large one many times."""
    schema = f"struct<type:string,features:array<struct<type:string,properties:map<string,string>,geometry:{geometry}>>>"
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    docs = raw.select("file", F.from_json("value", schema).alias("d")).select("file", "d.type", "d.features")
    found = F.when(F.col("type").eqNullSafe("FeatureCollection"), F.col("features")).otherwise(F.raise_error(F.concat(F.lit("not a FeatureCollection: "), F.col("file"))))
    return docs.select("file", F.explode(found).alias("f")).select("file", "f.properties", "f.geometry").where("geometry IS NOT NULL")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) of the features of a FeatureCollection, both as JSON text; a feature without geometry has null."""
    raw = spark.read.text(path, wholetext=True)
    checked = F.when(F.get_json_object("value", "$.type").eqNullSafe("FeatureCollection"), F.get_json_object("value", "$.features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")))
    f = raw.select(F.explode(F.from_json(checked, "array<string>")).alias("f"))
    return f.select(F.get_json_object("f", "$.properties").alias("properties"), F.get_json_object("f", "$.geometry").alias("geometry"))


def write_collection(features: DataFrame, path: str) -> None:
    """Features (properties, geometry as JSON, minzoom, maxzoom) as lines of GeoJSON with zoom hints."""
    hints = F.concat(F.lit('"tippecanoe":{"minzoom":'), F.col("minzoom").cast("string"), F.lit(',"maxzoom":'), F.col("maxzoom").cast("string"), F.lit("}"))
    line = F.concat(F.lit('{"type":"Feature",'), hints, F.lit(',"properties":'), F.to_json("properties"), F.lit(',"geometry":'), F.col("geometry"), F.lit("}"))
    features.select(line.alias("value")).write.text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(name, state, size) of asset listings: objects with an array assets, or bare arrays of assets, page by page."""
    asset = "array<struct<name:string,state:string,size:bigint>>"
    raw = spark.read.text(path, wholetext=True)
    found = F.coalesce(F.from_json("value", f"struct<assets:{asset}>")["assets"], F.from_json("value", asset))
    return raw.select(F.explode(found).alias("a")).select("a.*")


def read_manifest(spark: SparkSession, path: str, most: int = 4 << 20) -> DataFrame:
    """(version_hash, version, regions) of manifests, each with the digest of its text. A file of more than most bytes
    stops the scan before any is read; text that isn't JSON stops it too."""
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > most).select("path").first()
    if large:
        raise ValueError(f"{large[0]} has more than {most} bytes")
    checked = F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.lit("a manifest is not valid JSON")))
    raw = spark.read.text(path, wholetext=True).select(checked.alias("value"))
    parsed = F.from_json("value", "struct<version:int,regions:array<struct<id:string,asset:string,bounds:array<double>>>>")
    return raw.select(F.substring(F.sha2("value", 256), 1, 32).alias("version_hash"), parsed.alias("m")).select("version_hash", "m.version", "m.regions")


def depth_of(path):
    """The depth in a file's name: its last number."""
    return F.regexp_extract(path, r"_(\d+)\.[A-Za-z]+$", 1).try_cast("int")


def read_depths(spark: SparkSession, path: str, expected: int = 12) -> DataFrame:
    """(file, depth, properties, geometry) of collections whose depth stands in their names; another number of files than
    expected stops the scan."""
    files = spark.read.format("binaryFile").load(path).select("path").count()
    if files != expected:
        raise ValueError(f"{files} files, {expected} expected")
    c = read_collection(spark, path)
    return c.select("file", depth_of(F.col("file")).alias("depth"), "properties", "geometry")


def read_icons(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, content) of the *.svg files below path; name: the file's without ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.svg").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.svg$", 1).alias("name"), "path", "content")


def read_build_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, stage, wall, cpu) of the timing lines of build logs: "stage<tab or blanks>wall cpu:time" after a clock."""
    line = r"\s([A-Za-z_0-9]+)\s+((?:\d+[hms])+)\s+cpu:((?:\d+[hms])+)"
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.col("value").rlike(line))
    seconds = lambda k: sum((F.coalesce(F.regexp_extract(F.regexp_extract("value", line, k), rf"(\d+){u}", 1).try_cast("long"), F.lit(0)) * n for u, n in (("h", 3600), ("m", 60), ("s", 1))), F.lit(0))
    return raw.select("file", F.regexp_extract("value", line, 1).alias("stage"), seconds(2).alias("wall"), seconds(3).alias("cpu"))


def named_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row) of query responses {"fields": [{"name"}], "rows": [[...]]}: a map from name to value for each row; a field
    without a name is column_ and its place."""
    schema = "fields array<struct<name:string>>, rows array<array<string>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    row = F.col("row")
    names = F.transform(row, lambda _, i: F.coalesce(F.get(F.col("fields"), i)["name"], F.concat(F.lit("column_"), i.cast("string"))))
    return docs.select("fields", F.explode("rows").alias("row")).select(F.map_from_arrays(names, row).alias("row"))


def write_files(files: DataFrame, folder: str) -> None:
    """Rows (name, content as bytes or text) as files below a folder that all tasks share; names may have folders. Each is
    written beside its place and renamed, so that a task that runs twice leaves one whole file."""
    import os
    import uuid

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = os.path.normpath(f"{folder}/{name}")
                if not path.startswith(f"{os.path.normpath(folder)}/"):
                    raise ValueError(f"{name} leaves the folder")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("name")], names=["name"])

    files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
