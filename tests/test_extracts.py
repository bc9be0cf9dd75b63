"""Map extracts: blocks and files round trip, pieces hold every blob once, rings close."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tilewright.sources import extracts
from tilewright.sources.extracts import SCHEMA
from tilewright.sources.ranged import RangeReader

ELEMENT = SCHEMA.removeprefix("path string, ")


def elements(n):
    r = random.Random(n)
    out = [("node", k * 3 - 50, {"name": f"n{k}"} if k % 4 == 0 else {}, round(r.uniform(-180, 180), 7), round(r.uniform(-90, 90), 7), None, None) for k in range(n)]
    out += [("way", k, {"highway": r.choice(["é", "b"])}, None, None, [r.randrange(n) * 3 - 50 for _ in range(r.randint(0, 9))], None) for k in range(n // 3)]
    out += [("relation", 2**40 + k, {"type": "multipolygon"}, None, None, None, [{"kind": r.choice(extracts.KINDS), "ref": r.randrange(n), "role": r.choice(["", "inner", "outer"])} for _ in range(k % 5)]) for k in range(n // 9)]
    return out


def plain(row):
    kind, i, tags, lon, lat, refs, members = row
    return kind, i, dict(tags), None if lon is None else round(lon, 7), None if lat is None else round(lat, 7), refs if refs is None else list(refs), members if members is None else [(m["kind"], m["ref"], m["role"]) for m in members]


def test_packed_numbers():
    r = np.random.default_rng(1)
    for numbers in ([], [0], [-1, 1, 63, 64, -64, -65, 2**62, -(2**62)], r.integers(-(10**12), 10**12, 500).tolist()):
        assert extracts.packed(extracts._pack(numbers)).tolist() == numbers
        assert extracts.packed(extracts._pack([abs(n) for n in numbers], False), False).tolist() == [abs(n) for n in numbers]


@pytest.mark.parametrize("part", [700, 1 << 26])
def test_round_trip(spark, tmp_path, part):
    rows = elements(900)
    path = str(tmp_path / "x.osm.pbf")
    df = spark.createDataFrame(rows, ELEMENT).repartition(5)
    size = extracts.write_extract(df, path, 100)
    got = extracts.read_extract(spark, [path], part)
    assert got.rdd.getNumPartitions() == -(-size // part)
    key = lambda x: (x[0], x[1])
    assert sorted((plain(r[1:]) for r in got.collect()), key=key) == sorted(map(plain, rows), key=key)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.osm.pbf"]


def test_broken_chains_are_errors(spark, tmp_path):
    path = tmp_path / "x.osm.pbf"
    extracts.write_extract(spark.createDataFrame(elements(300), ELEMENT), str(path), 50)
    data = path.read_bytes()
    path.write_bytes(data[:-10])
    with pytest.raises(Exception, match="no blob at"):
        extracts.read_extract(spark, [str(path)]).count()
    path.write_bytes(b"")
    assert extracts.read_extract(spark, [str(path)]).count() == 0
    # a marker within a blob is no header
    odd = tmp_path / "odd.osm.pbf"
    odd.write_bytes(extracts.blob("OSMHeader", b"") + extracts.blob("Other", extracts.MARK * 3) + extracts.blob("OSMData", extracts.write_block([{"kind": "node", "id": 5, "tags": {}, "lon": 1.0, "lat": 2.0}])))
    n = odd.stat().st_size
    assert sum(len(list(extracts.blobs_in(RangeReader(str(odd)), a, min(n, a + 9), n))) for a in range(0, n, 9)) == 1


def test_lines_and_rings(spark):
    square = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0), (4, 0.0, 1.0), (5, 0.4, 0.4), (6, 0.6, 0.4), (7, 0.5, 0.6)]
    rows = [("node", i, {}, x, y, None, None) for i, x, y in square]
    rows += [("way", i, {}, None, None, refs, None) for i, refs in ((10, [1, 2, 3]), (11, [1, 4, 3]), (12, [5, 6, 7, 5]), (13, [1, 99]), (14, []), (15, None))]
    member = lambda ref, role: {"kind": "way", "ref": ref, "role": role}
    rows += [("relation", 1, {"type": "multipolygon"}, None, None, None, [member(10, "outer"), member(11, ""), member(12, "inner"), member(13, "outer"), member(77, "outer"), {"kind": "node", "ref": 1, "role": ""}]), ("relation", 2, {"type": "route"}, None, None, None, [member(10, "")])]
    df = spark.createDataFrame(rows, ELEMENT)
    lines = {r["id"]: ([tuple(p) for p in r["points"]], r["missing"]) for r in extracts.way_lines(df).collect()}
    assert lines[10] == ([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 0) and lines[13] == ([(0.0, 0.0)], 1) and lines[14] == lines[15] == ([], 0)
    got = extracts.multipolygons(df).collect()
    assert len(got) == 1 and got[0]["left"] == 1
    assert [[tuple(p) for p in ring] for ring in got[0]["outer"]] == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]] and len(got[0]["inner"]) == 1
    assert extracts.joined_rings([[1, 2], [3, 2], [3, 1]]) == ([[1, 2, 3, 1]], 0) and extracts.joined_rings([[1, 2], [2, 1]]) == ([], 1)
