"""What the work of a query grows with."""

from __future__ import annotations

from tilewright.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_equal_trees_are_walked_once(spark, monkeypatch):
    from tilewright.operators import trees

    walked, leaves = [], trees.leaves
    monkeypatch.setattr(trees, "leaves", lambda rows, keys, column: walked.append(rows) or leaves(rows, keys, column))
    colors = catalog.QUERIES["style_colors"](spark, SMALL)
    parts = spark.read.parquet(f"{SMALL}/part.parquet")
    assert walked[0].count() == parts.select("p_size").distinct().count() < parts.count()
    assert {r["color"]: r["n"] for r in colors.collect()}["#FFFFFF"] == parts.count()


def test_addresses_as_arrays_equal_those_one_by_one():
    import random

    from tilewright.sources.pmtiles import tile_address, tile_addresses, tile_number, tile_numbers

    r = random.Random(5)
    tiles = [(z, r.randrange(1 << z), r.randrange(1 << z)) for z in (0, 1, 2, 3, 7, 20, 30) for _ in range(200)]
    numbers = [tile_number(*t) for t in tiles]
    assert tile_numbers(*zip(*tiles, strict=True)).tolist() == numbers
    assert list(zip(*(v.tolist() for v in tile_addresses(numbers)), strict=True)) == tiles == [tile_address(n) for n in numbers]


def test_a_small_tile_at_many_addresses_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import json

    from pyspark.sql import functions as F

    from tilewright.sources import ranged

    path = str(tmp_path / "a.pmtiles")
    i = F.col("id")
    tiles = spark.range(40000).select(F.lit(10).alias("z"), (i % 256).cast("int").alias("x"), F.floor(i / 256).cast("int").alias("y"), F.encode((i % 7).cast("string"), "UTF-8").alias("tile"))
    ranged.write_tiles(tiles, path, {})
    monkeypatch.setattr(ranged, "PART_TILES", 5000, raising=False)
    options = {"paths": json.dumps([path]), "min_x": "100", "max_x": "130"}
    reader = ranged.ArchiveReader(options)
    parts = reader.partitions()
    assert len(parts) > 2
    got = [row for p in parts for b in reader.read(p) for row in b.to_pylist()]
    want = tiles.where("x BETWEEN 100 AND 130").collect()
    assert sorted((g["z"], g["x"], g["y"], g["tile"]) for g in got) == sorted((w["z"], w["x"], w["y"], bytes(w["tile"])) for w in want)


def test_elements_of_other_kinds_are_not_decoded(monkeypatch):
    from tilewright.sources import extracts

    way = {"kind": "way", "id": 7, "tags": {"a": "b"}, "refs": [5, 3], "lon": None, "lat": None, "members": None}
    relations = [{"kind": "relation", "id": k, "tags": {}, "refs": None, "lon": None, "lat": None, "members": [{"kind": "way", "ref": 7, "role": ""}]} for k in (1, 2)]
    nodes = [{"kind": "node", "id": k, "tags": {"n": "x"} if k == 3 else {}, "lon": k / 10, "lat": -k / 7, "refs": None, "members": None} for k in (3, 5)]
    data = extracts.write_block([*nodes, way, *relations])
    assert [e[0] for e in extracts.read_block(data)] == ["node", "node", "way", "relation", "relation"]
    monkeypatch.setattr(extracts, "packed", lambda *_: 1 / 0)
    assert list(extracts.read_block(data, [])) == []
    monkeypatch.undo()
    assert [e[:2] for e in extracts.read_block(data, ["relation"])] == [("relation", 1), ("relation", 2)]
    assert [e[:2] for e in extracts.read_block(data, ["node"])] == [("node", 3), ("node", 5)]


def test_files_of_a_small_table_are_written_by_many_tasks(spark, monkeypatch):
    from tilewright.sources import archives

    seen, write = [], archives.write_files
    monkeypatch.setattr(archives, "write_files", lambda files, folder: seen.append(files) or write(files, folder))
    tiles = catalog.QUERIES["tile_tree_scan"](spark, SMALL)
    assert seen[0].rdd.getNumPartitions() > 1
    assert sum(r["tiles"] for r in tiles.collect()) == spark.read.parquet(f"{SMALL}/supplier.parquet").where("s_suppkey % 6 > 0").count()
