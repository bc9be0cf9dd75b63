"""Responses, places in the order of the input, positions of any depth and bounds of manifests, against loops."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tilewright.functions import text as X
from tilewright.operators.ordering import placed
from tilewright.operators.planning import coordinates
from tilewright.operators.responses import UNSATISFIABLE, decoded, range_responses, tile_responses
from tilewright.sources.archives import read_manifest


def met(header, size):
    """(start, stop) by the rule, or None."""
    m = re.fullmatch(r"bytes=([0-9]*)-([0-9]*)", header.strip())
    if not m or not any(m.groups()):
        return None
    first, last = (int(g) if g else None for g in m.groups())
    if any(v is not None and v >= 1 << 53 for v in (first, last)):
        return None
    if first is None:
        start, stop = max(size - last, 0), size - 1
        return (start, stop) if last > 0 and start < size else None
    stop = size - 1 if last is None else last
    return (first, min(stop, size - 1)) if first <= stop and first < size else None


def test_ranges_brute_force(spark):
    draw = random.Random(5)
    numbers = ["", "0", "00", "1", "7", "8", "9", "10", "300", str((1 << 53) - 1), str(1 << 53), str(1 << 63), "9" * 30]
    headers = [f"{draw.choice(['', ' ', chr(9)])}bytes={draw.choice(numbers)}-{draw.choice(numbers)}{draw.choice(['', '', ' ', '1,2'])}" for _ in range(400)] + ["bytes=1", "items=0-1", "bytes=-", " ", "bytes=a-b"]
    content = [draw.choice([None, b"", b"\x00", b"12345678", "éß€ x".encode()]) for _ in headers]
    rows = [(i, h, bytearray(c) if c is not None else None) for i, (h, c) in enumerate(zip(headers, content, strict=True))] + [(-1, None, bytearray(b"all")), (-2, "", bytearray(b"all")), (-3, None, None)]
    found = {r["id"]: r for r in range_responses(spark.createDataFrame(rows, "id int, range string, content binary")).collect()}
    assert len(found) == len(rows)
    for i, h, c in rows:
        c, r = bytes(c or b""), found[i]
        if not h:
            want = (200, None, c)
        elif (at := met(h, len(c))) is None:
            want = (416, f"bytes */{len(c)}", UNSATISFIABLE.encode())
        else:
            want = (206, f"bytes {at[0]}-{at[1]}/{len(c)}", c[at[0] : at[1] + 1])
        assert (r["status"], r["content_range"], bytes(r["body"])) == want, h
        assert r["content_length"] == len(want[2])


def tag(tile):
    return '"' + base64.urlsafe_b64encode(hashlib.sha256(tile).digest()).decode()[:24] + '"'


def test_tile_responses(spark):
    tiles = {(0, 0): b"", (0, 1): b"tile" * 500, (1, 0): None}
    asked = [(z, x, m, a, t) for z, x in [*tiles, (9, 9), (None, 1)] for m in ("GET", "HEAD", None) for a in (None, "", "gzip", "br, GZIP", "gzip;q=1", "xgzip") for t in (None, "other", tag(tiles.get((z, x)) or b""))]
    asked += [(0, 1, "GET", "gzip", None)] * 300  # one hot tile, equal requests
    requests = spark.createDataFrame(asked, "z int, x int, method string, accept_encoding string, if_none_match string").withColumn("tile", F.lit("own"))
    made = tile_responses(requests, spark.createDataFrame([(*k, bytearray(v) if v is not None else None) for k, v in tiles.items()], "z int, x int, tile binary"), ["z", "x"])
    rows = decoded(made).collect()
    assert len(rows) == len(asked) and all(r["tile"] == "own" for r in rows)
    for r in rows:
        tile = tiles.get((r["z"], r["x"])) or b""
        packed = r["accept_encoding"] in ("gzip", "br, GZIP")
        assert r["etag"] == tag(tile)
        if r["if_none_match"] == tag(tile):
            assert (r["status"], r["encoding"], r["content_length"], r["body"]) == (304, None, None, None)
            continue
        assert (r["status"], r["encoding"]) == (200, "gzip" if packed else None)
        assert r["content_length"] == len(gzip.compress(tile, 5, mtime=0) if packed else tile)
        assert (r["body"], r["plain"]) == (None, None) if r["method"] == "HEAD" else bytes(r["plain"]) == tile
    assert tile_responses(requests.limit(0), spark.createDataFrame([], "z int, x int, tile binary"), ["z", "x"]).count() == 0


def test_places_in_order(spark):
    draw = random.Random(8)
    rows = [(None if draw.random() < 0.1 else "hot" if draw.random() < 0.5 else draw.choice("abc"), draw.choice([None, 1, 2, 3, 4]), draw.randrange(50)) for _ in range(2000)]
    want = sorted((k or "", -1 if a is None else a, b) for k, a, b in rows)
    places, last = [], None
    for key, a, b in want:
        n = n + 1 if key == last else 0  # noqa: F821
        last = key
        places.append((key, a, b, n))
    df = spark.createDataFrame(rows, "k string, a int, b int").repartition(7)
    got = [(r["k"] or "", -1 if r["a"] is None else r["a"], r["b"], r["place"]) for r in placed(df, ["k"], ["a", "b"]).collect()]
    assert sorted(got) == sorted(places)
    assert placed(df.limit(0), ["k"], ["a", "b"]).count() == 0


def walked(value):
    if not isinstance(value, list):
        return []
    if len(value) >= 2 and all(isinstance(v, (int, float)) for v in value[:2]):
        return [(float(value[0]), float(value[1]))]
    return [p for v in value for p in walked(v)]


def test_coordinates_of_any_depth(spark):
    draw = random.Random(2)

    def tree(depth):
        if not depth:
            return [round(draw.uniform(-180, 180), draw.randrange(4)) for _ in range(2)] + [draw.choice([0, -1e-9, 2.5e20]) for _ in range(draw.randrange(3))]
        return [tree(depth - 1) for _ in range(draw.randrange(4))]

    trees = [tree(k % 5) for k in range(60)] + [[], None]
    rows = [(i, None if t is None else json.dumps(t)) for i, t in enumerate(trees)]
    for r in spark.createDataFrame(rows, "id int, t string").select("id", coordinates(F.col("t")).alias("p")).collect():
        assert [tuple(p) for p in r["p"] or []] == walked(trees[r["id"]])


def test_manifest_bounds(spark, tmp_path):
    text = json.dumps({"version": 2, "regions": []})
    (tmp_path / "m.json").write_text(text)
    assert read_manifest(spark, str(tmp_path), len(text)).first()["version_hash"] == hashlib.sha256(text.encode()).hexdigest()[:32]
    with pytest.raises(ValueError, match="more than"):
        read_manifest(spark, str(tmp_path), len(text) - 1)
    (tmp_path / "broken.json").write_text('{"version":')
    with pytest.raises(Exception, match="not valid JSON"):
        read_manifest(spark, str(tmp_path)).collect()


def test_null_header_has_no_range(spark):
    assert spark.range(1).select(X.byte_range(F.lit(None).cast("string"), F.lit(4)).alias("r")).first()["r"] is None
