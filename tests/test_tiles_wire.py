"""Tiles encoded over flat arrays against the encoder of one tile."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tilewright.sources import mvt


def shape(draw):
    """(gtype, geom) with one part or several, single points, repeated points, closed and open rings."""
    gtype = draw.choice([1, 2, 3])
    far = draw.choice([3, 4096, 1 << 40])
    parts = []
    for _ in range(draw.randrange(1, 4)):
        part = [(draw.randint(-far, far), draw.randint(-far, far)) for _ in range(draw.randrange(1, 7))]
        parts.append([*part, part[0]] if gtype == 3 and draw.random() < 0.7 else part)
    return gtype, parts


def test_flat_tiles_match_the_encoder_of_one_tile(spark):
    draw = random.Random(4)
    rows, want = [], {}
    for n in range(700):
        gtype, geom = shape(draw)
        address, layer = (draw.randrange(3), draw.randrange(3), 0), draw.choice("abc")
        fid = n if draw.random() < 0.9 else None
        props = {k: draw.choice(["", "é", "v" * 200, str(n), None]) for k in draw.sample("klmn", draw.randrange(4))}
        if fid is None and any(f["fid"] is None for f in want.get(address, {}).get(layer, ())):
            fid = n  # two without an id have no order
        rows.append((*address, layer, 2, 4096, fid, gtype, props, [[(float(x), float(y)) for x, y in p] for p in geom]))
        want.setdefault(address, {}).setdefault(layer, []).append({"fid": fid, "gtype": gtype, "props": props, "geom": geom})
    features = spark.createDataFrame(rows, mvt.FEATURES).repartition(5)
    got = {(r["z"], r["x"], r["y"]): bytes(r["tile"]) for r in mvt.encode_tiles(features).collect()}
    assert got.keys() == want.keys()
    for address, layers in want.items():
        ordered = {name: (2, 4096, sorted(layers[name], key=lambda f: (f["fid"] is None, f["fid"]))) for name in sorted(layers)}
        # the order of a map's entries isn't kept on the way to Spark, so bytes may differ where features don't
        assert mvt.decode_tile(got[address]) == mvt.decode_tile(mvt.encode_tile(ordered))
        assert len(got[address]) == len(mvt.encode_tile(ordered))
    assert mvt.encode_tiles(features.limit(0)).count() == 0


def test_streams_match_the_encoder_of_one_geometry():
    draw = random.Random(9)
    shapes = [shape(draw) for _ in range(2000)]
    nested = mvt.nested([g for _, g in shapes])
    for start, size in ((0, 2000), (3, 1500), (1999, 1), (5, 0)):
        own = shapes[start : start + size]
        assert mvt.flat_geometries(np.array([t for t, _ in own], np.int64), nested.slice(start, size)) == [mvt._geometry(t, g) for t, g in own]


def test_batches_that_split_tiles(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(n % 2, 0, 0, "l", 2, 4096, n, 1, {"k": str(n)}, [[(float(n), 1.0)]]) for n in range(100)]
        back = mvt.decode_tiles(mvt.encode_tiles(spark.createDataFrame(rows, mvt.FEATURES))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["fid"], r["z"], r["props"]["k"], r["geom"][0][0]["x"]) for r in back) == [(n, n % 2, str(n), float(n)) for n in range(100)]


def test_numbers_of_every_length():
    values = [0, 1, 127, 128, (1 << 14) - 1, 1 << 14, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    data, starts = mvt.varints(np.array(values, np.uint64))
    assert [data[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [mvt._varint(v) for v in values]
    assert len(mvt.varints(np.zeros(0, np.uint64))[0]) == 0


def test_points_that_are_no_numbers_are_refused(spark):
    rows = [(0, 0, 0, "l", 2, 4096, 1, 1, None, [[(float("nan"), 1.0)]])]
    with pytest.raises(Exception, match="not a number"):
        mvt.encode_tiles(spark.createDataFrame(rows, mvt.FEATURES)).collect()


def test_features_of_many_tiles_leave_in_small_batches(spark):
    rows = [(3, k, 0, "a", 2, 4096, f, 1, {"k": "v"}, [[(1.0, 2.0)]]) for k in range(30) for f in range(1000)]
    tiles = mvt.encode_tiles(spark.createDataFrame(rows, mvt.FEATURES).coalesce(1))
    assert mvt.decode_tiles(tiles).count() == 30_000
    seen = []
    taken = mvt.decode_tiles(_Frame(tiles.toArrow(), seen))
    assert taken == 30_000 and max(seen) <= 5000 and len(seen) >= 6


class _Frame:
    """Stands for a table of tiles: runs what is mapped over it here, and notes the rows of each batch that comes out."""

    def __init__(self, table, seen):
        self.table, self.seen = table, seen

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        self.seen += [b.num_rows for b in run(iter(self.table.combine_chunks().to_batches()))]
        return sum(self.seen)
