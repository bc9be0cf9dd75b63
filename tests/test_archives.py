"""Archives as a data source: ranges, pushed bounds, retries, and publication in two phases."""

from __future__ import annotations

import hashlib
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tilewright.sources import pmtiles, ranged


def tiles_of(spark, n, distinct):
    i = F.col("id")
    return spark.range(n).select(F.lit(8).alias("z"), (i % 100).cast("int").alias("x"), F.floor(i / 100).cast("int").alias("y"), F.encode(F.repeat(F.concat(F.lit("tile"), (i % distinct).cast("string")), 20), "UTF-8").alias("tile"))


def rows(df):
    return sorted((r["z"], r["x"], r["y"], bytes(r["tile"])) for r in df.collect())


@pytest.mark.parametrize(("leaf", "distinct"), [(64, 4000), (64, 7), (4096, 500)])
def test_round_trip(spark, tmp_path, monkeypatch, leaf, distinct):
    monkeypatch.setattr(ranged, "LEAF", leaf)
    path = str(tmp_path / "a.pmtiles")
    tiles = tiles_of(spark, 6000, distinct)
    said = ranged.write_tiles(tiles.unionByName(tiles.limit(50)).unionByName(tiles.limit(3).withColumn("tile", F.lit(b"")).withColumn("z", F.lit(9))), path, {"name": "a"})
    assert sorted(os.listdir(tmp_path)) == ["a.pmtiles", "a.pmtiles.sha256"]
    assert said["addressed"] == 6000 and said["contents"] == distinct and said["bytes"] == os.path.getsize(path) and (said["leaves"] > 20) == (leaf == 64)
    with open(path, "rb") as f:
        data = f.read()
    assert open(f"{path}.sha256").read() == f"{hashlib.sha256(data).hexdigest()}  a.pmtiles\n" and ranged.verified(spark, path)
    want = rows(tiles)
    assert sorted(pmtiles.read_archive(data)) == want and rows(ranged.read_tiles(spark, [path])) == want
    got = ranged.read_tiles(spark, [path, path], part_bytes=2000)
    assert rows(got) == sorted(want * 2) and (got.rdd.getNumPartitions() > 2 or distinct == 7)
    box = [t for t in want if 10 <= t[1] <= 13 and t[2] >= 20]
    assert rows(ranged.read_tiles(spark, [path], min_x=10, max_x=13, min_y=20)) == box
    assert rows(ranged.read_tile(spark, path, 8, 5, 5)) == [t for t in want if t[1:3] == (5, 5)] and not rows(ranged.read_tile(spark, path, 8, 5, 200))
    assert ranged.metadata_of(ranged.RangeReader(path)) == {"name": "a"}


def test_filters_are_pushed(spark, tmp_path):
    path = str(tmp_path / "a.pmtiles")
    tiles = tiles_of(spark, 3000, 3000)
    ranged.write_tiles(tiles, path, {})
    own = ranged.FilteredReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    filters = [EqualTo(("z",), 8), GreaterThan(("x",), 9), LessThanOrEqual(("x",), 12), In(("y",), (3, 4))]
    assert list(own.pushFilters(filters)) == filters and own.bounds == {"z": [8, 8], "x": [10, 12], "y": [3, 4]}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = ranged.read_tiles(spark, [path]).where("z = 8 AND x > 9 AND x <= 12 AND y IN (3, 4)")
        assert rows(got) == [t for t in rows(tiles) if 9 < t[1] <= 12 and t[2] in (3, 4)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bytes_of_a_box(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranged, "LEAF", 256)
    path = str(tmp_path / "a.pmtiles")
    ranged.write_tiles(tiles_of(spark, 20_000, 20_000), path, {})
    reader = ranged.RangeReader(path)
    got = [t for t in ranged.tiles_in(reader, ranged.runs_of(8, 4, 6, 9, 11)) if 4 <= t[1] <= 9 and 6 <= t[2] <= 11]
    assert len(got) == 36 and reader.bytes < os.path.getsize(path) / 10


def test_runs_cover_boxes():
    r = random.Random(2)
    for _ in range(60):
        z = r.randint(0, 6)
        side = 1 << z
        x0, y0 = r.randrange(side), r.randrange(side)
        x1, y1 = r.randint(x0, side), r.randint(y0, side)
        for most in (4, 10_000):
            runs = ranged.runs_of(z, x0, y0, x1, y1, most)
            want = {pmtiles.tile_number(z, x, y) for x in range(x0, min(x1, side - 1) + 1) for y in range(y0, min(y1, side - 1) + 1)}
            have = {n for a, b in runs for n in range(a, b)}
            assert want <= have and (most == 4 or want == have)
    assert ranged.runs_of(3, 9, 0, 12, 4) == []
    assert len(ranged.runs_of(22, 5, 5, 2_000_000, 3_000_000)) <= ranged.RUNS


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: tiles start at 3 GB and the last ends at 5 GB."""
    path = str(tmp_path / "large.pmtiles")
    first, tiles, last = pmtiles.tile_number(3, 1, 1), 3 << 30, (2 << 30) - 4
    root = pmtiles._directory([(first, 1, 0, 5), (first + 1, 2, last, 4)])
    with open(path, "wb") as f:
        f.write(struct.pack(pmtiles.HEADER, pmtiles.MAGIC, 3, 127, len(root), 127 + len(root), 0, 127 + len(root), 0, tiles, 2 << 30, 3, 2, 2, 1, 2, 1, 1, 3, 3, 0, 0, 0, 0, 0, 0, 0))
        f.write(root)
        f.seek(tiles)
        f.write(b"first")
        f.seek(tiles + last)
        f.write(b"last")
    got = {r["tile"]: 0 for r in ranged.read_tiles(spark, [path]).collect()}
    assert set(map(bytes, got)) == {b"first", b"last"} and ranged.read_tiles(spark, [path]).count() == 3
    reader = ranged.RangeReader(path)
    assert len(list(ranged.tiles_in(reader, [(0, 1 << 62)]))) == 3 and reader.bytes < 1000
    os.truncate(path, tiles + 2)
    with pytest.raises(Exception, match="bytes at"):
        ranged.read_tiles(spark, [path]).count()


def test_retries_and_circuit():
    clock, paused, answers = [0.0], [], []

    def fetch(path, offset, length):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    def sleep(s):
        paused.append(s)

    reader = ranged.RangeReader("x", fetch=fetch, sleep=sleep, now=lambda: clock[0])
    answers[:] = [OSError("reset"), b"ab", b"abc"]
    assert reader.read(0, 3) == b"abc" and reader.retries == 2 and 0.09 <= paused[0] <= 0.15 and 0.18 <= paused[1] <= 0.3
    answers[:] = [ranged.RangeError("gone", 404)]
    with pytest.raises(OSError, match="gone"):
        reader.read(0, 3)
    assert not answers and reader.failures == 1
    for _ in range(5):
        answers[:] = [ranged.RangeError("busy", 503)] * 4
        with pytest.raises(OSError, match="busy"):
            reader.read(0, 3)
        assert not answers
    with pytest.raises(OSError, match="in a row"):
        reader.read(0, 3)
    clock[0] += ranged.COOLDOWN
    answers[:] = [b"abc"]
    assert reader.read(0, 3) == b"abc" and reader.failures == 0
    for bad in ((-1, 3), (0, -1), (0, ranged.MAX_RANGE + 1)):
        with pytest.raises(ValueError, match="not a range"):
            reader.read(*bad)


def test_failure_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "a.pmtiles")
    tiles = tiles_of(spark, 500, 500)
    ranged.write_tiles(tiles, path, {})
    before = open(path, "rb").read()
    broken = tiles.withColumn("tile", F.when(F.col("x") == 50, F.raise_error(F.lit("no tile"))).otherwise(F.col("tile")))
    with pytest.raises(Exception, match="no tile"):
        ranged.write_tiles(broken, path, {})
    temporary = str(tmp_path / "b.part")
    rows_ = spark.createDataFrame([(0, bytearray(b"abcd")), (4, bytearray(b"ef"))], "at long, data binary")
    with pytest.raises(Exception, match="instead of"):
        rows_.write.format("tilewright_archive").mode("append").options(path=temporary, total="7", header=b"abcd".hex()).save()
    dies = rows_.repartition(2).select("at", F.when(F.col("at") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("data")).cast("binary").alias("data"))
    with pytest.raises(Exception, match="lost"):
        dies.write.format("tilewright_archive").mode("append").options(path=temporary, total="6", header=b"abcd".hex()).save()
    assert sorted(os.listdir(tmp_path)) == ["a.pmtiles", "a.pmtiles.sha256"] and open(path, "rb").read() == before
    with open(path, "r+b") as f:
        f.seek(len(before) - 1)
        f.write(bytes([before[-1] ^ 1]))
    assert not ranged.verified(spark, path) and not ranged.verified(spark, path, most=10)


def test_empty_and_foreign_files(spark, tmp_path):
    path = str(tmp_path / "none.pmtiles")
    assert ranged.write_tiles(tiles_of(spark, 5, 5).limit(0), path, {})["addressed"] == 0
    assert ranged.read_tiles(spark, [path]).count() == 0
    other = tmp_path / "other"
    other.write_bytes(b"x" * 500)
    with pytest.raises(Exception, match="not an archive"):
        ranged.read_tiles(spark, [str(other)]).count()
    one = str(tmp_path / "one.pmtiles")
    ranged.write_tiles(tiles_of(spark, 5, 5), one, {})
    with pytest.raises(Exception, match="beyond 3"):
        ranged.read_tile(spark, one, 8, 1, 0, most=3).count()
