"""Typed payloads: kinds kept through bytes, limits, and merging against a plain loop."""

from __future__ import annotations

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.sources import typed
from tilewright.sources.mvt import _field, _varint

POINT = [[(1, 2)]]


def raw_value(v):
    """A value in each kind of the format: (kind, value)."""
    kind, v = v
    if kind == 1:
        return _field(1, v.encode())
    if kind == 2:
        return _varint(2 << 3 | 5) + struct.pack("<f", v)
    if kind == 3:
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    if kind == 6:
        return _varint(6 << 3) + _varint(v << 1 ^ v >> 63)
    return _varint(kind << 3) + _varint(int(v))


def payload(layers):
    """Bytes of {name: (extent, [(fid, gtype, {key: (kind, value)}, parts)])}."""
    out = b""
    for name, (extent, features) in layers.items():
        keys, values, body = {}, {}, b""
        for fid, gtype, props, parts in features:
            tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault(raw_value(v), len(values))) for k, v in props.items())
            own = (_varint(8) + _varint(fid) if fid is not None else b"") + _field(2, tags) + _varint(3 << 3) + _varint(gtype)
            body += _field(2, own + _field(4, typed._geometry(gtype, parts)))
        layer = _field(1, name.encode()) + body + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values)
        out += _field(3, layer + _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(2))
    return out


def rows(spark, tiles):
    return spark.createDataFrame([(0, 0, 0, k, bytearray(t) if t is not None else None) for k, t in enumerate(tiles)], "z int, x int, y int, payload int, tile binary")


def test_numbers_as_text():
    for v, want in ((2.0**53, "9007199254740992"), (2.0**63, "9223372036854776000"), (2.0**64, "18446744073709552000"), (-(2.0**60), "-1152921504606847000"), (1e21, "1e+21"), (1.5e22, "1.5e+22"), (float("inf"), "Infinity"), (float("-inf"), "-Infinity"), (float("nan"), "NaN"), (1e20, "100000000000000000000"), (0.5, "0.5"), (1e-7, "1e-7"), (0.00015, "0.00015"), (123.25, "123.25"), (-0.0, "0")):
        assert typed.number_text(v).removeprefix("-" if v == 0 else "") == want


def test_kinds_survive(spark):
    props = {"s": (1, "text"), "f": (2, 0.25), "d": (3, 2.5), "i": (4, 7), "u": (5, 2**53 - 1), "z": (6, -9), "b": (7, True), "n": (7, False), "far": (5, 2**63 + 5), "low": (4, 2**64 - 2**60), "inf": (3, float("inf")), "nan": (3, float("nan")), "empty": (1, "")}
    tile = payload({"a": (4096, [(2**64 - 1, 1, props, POINT), (2**63, 1, {}, POINT), (None, 1, {"i": (6, 3)}, POINT)])})
    merged = typed.merge_payloads(rows(spark, [tile]))
    for df in (rows(spark, [tile]), merged.withColumn("payload", F.lit(0))):
        got = typed.decode_payloads(df).orderBy("at").collect()
        assert [None if r["fid"] is None else int(r["fid"]) for r in got] == [2**64 - 1, 2**63, None]
        have = {k: next(x for x in v if x is not None) for k, v in got[0]["props"].items()}
        assert have == {"s": "text", "f": 0.25, "d": 2.5, "i": 7.0, "u": float(2**53 - 1), "z": -9.0, "b": True, "n": False, "far": "9223372036854776000", "low": "-1152921504606847000", "inf": "Infinity", "nan": "NaN", "empty": ""}
    kinds = [typed._Reader(v).varint() >> 3 for n, body in typed._Reader(bytes(merged.first()["tile"])).fields() if n == 3 for k, v in typed._Reader(body).fields() if k == 4]
    assert sorted(set(kinds)) == [1, 3, 5, 6, 7]


def test_limits(spark):
    ok = (7, 1, {"k": (5, 1)}, POINT)
    line = (7, 2, {}, [[(0, 0), (5, 5), (9, 9)]])
    cases = {
        None: (payload({"a": (4096, [ok])}), {}),
        "bytes": (payload({"a": (4096, [ok])}), {"bytes": 10}),
        "layers": (payload({"a": (4096, [ok]), "b": (4096, [ok])}), {"layers": 1}),
        "features": (payload({"a": (4096, [ok]), "b": (4096, [ok])}), {"features": 1}),
        "feature_points": (payload({"a": (4096, [line])}), {"feature_points": 2}),
        "points": (payload({"a": (4096, [line, line])}), {"points": 5}),
        "properties": (payload({"a": (4096, [(1, 1, {"k": (5, 1), "l": (5, 1)}, POINT)])}), {"properties": 1}),
        "name": (payload({"n" * 201: (4096, [ok])}), {}),
        "extent": (payload({"a": (255, [ok])}), {}),
        "coordinates": (payload({"a": (256, [(1, 1, {}, [[(0, 256 * 128 + 1)]])])}), {}),
        "empty": (payload({"a": (4096, [(1, 1, {}, [])])}), {}),
        "type": (payload({"a": (4096, [(1, 4, {}, POINT)])}), {}),
        "malformed": (payload({"a": (4096, [ok])})[:-1], {}),
    }
    for broken, (tile, limits) in cases.items():
        got = typed.payload_totals(rows(spark, [tile, b"", None]), limits, ["payload"]).orderBy("payload").collect()
        assert [r["broken"] for r in got] == [broken, None, None] and got[0]["bytes"] == len(tile)
        if broken:
            with pytest.raises(Exception, match="payload 0 of tile 0/0/0"):
                typed.decode_payloads(rows(spark, [tile]), limits).count()
    assert typed.payload_totals(rows(spark, [cases[None][0]])).select("layers", "features", "points").first() == (1, 1, 1)


def contains(line, piece):
    return any(line[i : i + len(piece)] in (piece, piece[::-1]) for i in range(len(line) - len(piece) + 1))


def merged_by_loop(tiles, scale):
    out = {}
    for tile in tiles:
        for _, name, version, extent, _, fid, gtype, props, geom in typed.read_payload(tile):
            layer = out.setdefault(name, (version, extent, {}))
            if any(abs(v) > extent * scale for p in geom for xy in p for v in xy):
                continue
            shape = (gtype, str(sorted(props.items())), str(geom))
            key = shape if gtype == 3 or fid is None else (gtype, fid)
            if key not in layer[2]:
                layer[2][key] = [fid, gtype, props, [list(p) for p in geom]]
            elif gtype == 2:
                parts = layer[2][key][3]
                for new in geom:
                    if not any(contains(p, new) for p in parts):
                        parts[:] = [p for p in parts if not contains(new, p)] + [list(new)]
    return [(name, *f) for name, (_, _, own) in out.items() for f in own.values()]


def test_merge_equals_loop(spark):
    r = random.Random(12)
    path = [(k * 10, k * k) for k in range(30)]

    def feature():
        gtype = r.choice([1, 2, 2, 3])
        a = r.randrange(20)
        parts = [[r.choice(path)]] if gtype == 1 else [path[a : a + r.randint(2, 9)] for _ in range(r.randint(1, 2))] if gtype == 2 else [[(0, 0), (r.choice([5, 9]), 0), (3, 8), (0, 0)]]
        if r.random() < 0.1:
            parts = [[(4096 * 64 + 1, 0)]] if gtype == 1 else parts
        if gtype == 2 and r.random() < 0.5:
            parts = [p[::-1] for p in parts]
        return r.choice([None, 1, 2, 2**63 + 1]), gtype, {"k": r.choice([(5, 1), (1, "1"), (7, True), (3, 1.5)])}, parts

    tiles = [payload({name: (4096, [feature() for _ in range(r.randint(1, 12))]) for name in r.sample(["a", "b", "road"], 2)}) for _ in range(6)]
    merged = typed.merge_payloads(rows(spark, [*tiles, None, b""])).first()["tile"]
    got = [(name, fid, gtype, props, [list(p) for p in geom]) for _, name, _, _, _, fid, gtype, props, geom in typed.read_payload(bytes(merged))]
    assert got == merged_by_loop(tiles, 64)
    only = typed.merge_payloads(rows(spark, tiles), include=["a", "b"], exclude=["b"]).first()["tile"]
    assert {f[1] for f in typed.read_payload(bytes(only))} == {"a"}
    assert typed.merge_payloads(rows(spark, tiles), include=["none"]).count() == 0 and typed.merge_payloads(rows(spark, [b"", None])).count() == 0


def test_extents_that_differ_stop(spark):
    tiles = [payload({"a": (4096, [(1, 1, {}, POINT)])}), payload({"a": (512, [(2, 1, {}, POINT)])})]
    with pytest.raises(Exception, match="has extents 512 and 4096"):
        typed.merge_payloads(rows(spark, tiles)).collect()


def test_merge_and_copy_leave_insane_features_out(spark):
    from tilewright.operators import features as G

    far = float(4096 * 64 + 1)
    geoms = [[[(1.0, 2.0)]], [[(far, 0.0)]], [[]], [[(float("nan"), 0.0)]], [[(0.0, None)]], [[(-far, 0.0)]], [[(far - 1, 1 - far)]], None]
    rows = [("a", k, 1, {"k": "v"}, None if g is None else [[{"x": x, "y": y} for x, y in p] for p in g]) for k, g in enumerate(geoms)]
    df = spark.createDataFrame(rows, f"layer string, fid long, gtype int, props map<string,string>, geom {G.GEOMETRY}")
    shaped = G.with_shape(df)
    assert sorted(r["fid"] for r in G.merge(shaped, ["layer", *G.SHAPE], ["fid"], F.lit(4096.0)).collect()) == [0, 6]
    assert sorted(r["fid"] for r in G.layer_copy(df, "a", "b", {"k": "w"}, F.lit(4096.0), 64).collect()) == [0, 6]
    assert G.merge(shaped, ["layer", *G.SHAPE], ["fid"]).count() == 8


def test_payloads_in_pieces_are_those_in_one(spark):
    tiles = [payload({name: (4096, [(k, 1 + k % 3, {"k": (5, k % 4), "s": (1, f"v{k}")}, [[(k, 1), (k + 9, 2), (k, 5), (k, 1)]]) for k in range(n)]) for name in ("a", "b")}) for n in (40, 3)]
    features = typed.decode_payloads(rows(spark, [*tiles, b""]))
    keys = ["z", "x", "y", "payload"]
    one = {r["payload"]: bytes(r["tile"]) for r in typed.encode_payloads(features, ["at"], keys).collect()}
    pieces = typed.encode_payloads(features, ["at"], keys, piece=100)
    held = {}
    for r in pieces.orderBy("payload", "piece").collect():
        assert len(r["tile"]) <= 100
        held[r["payload"]] = held.get(r["payload"], b"") + bytes(r["tile"])
    assert held == one and pieces.count() > 10
    assert sorted(map(str, typed.decode_payloads(pieces.orderBy(F.rand(3))).collect())) == sorted(map(str, features.collect()))
    assert sorted(typed.payload_totals(pieces, keys=keys).drop("z", "x", "y").collect()) == sorted(typed.payload_totals(rows(spark, tiles), keys=keys).drop("z", "x", "y").collect())
    merged = {r["piece"]: bytes(r["tile"]) for r in typed.merge_payloads(pieces, piece=64).collect()}
    assert b"".join(merged[k] for k in sorted(merged)) == bytes(typed.merge_payloads(rows(spark, tiles)).first()["tile"])


def test_a_payload_in_pieces_is_held_once():
    import tracemalloc

    piece = b"x" * (1 << 20)
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([k], pa.int32()), pa.array([piece], pa.binary())], names=["z", "piece", "tile"]) for k in range(24))
    tracemalloc.start()
    sizes = [len(tile) for _, tile in typed.whole(batches(), ["z"])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [24 << 20] and peak < 36 << 20


def in_pieces(spark, tiles, piece):
    from tilewright.plans.storage import durable

    return durable(typed.encode_payloads(typed.decode_payloads(rows(spark, tiles)), ["at"], ["z", "x", "y", "payload"], piece=piece))


def test_a_payload_in_pieces_is_nowhere_one(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("a payload is held as one")

    line = [[(k, k * k % 7) for k in range(40)]]
    tile = payload({"a": (4096, [(2**64 - k if k else None, 1 + k % 2, {"k": (5, k % 4), "s": (1, f"v{k % 5}"), "h": (3, -k / 2)}, line if k % 2 else [[(k, 1)]]) for k in range(300)]), "b": (512, [(1, 3, {}, [[(0, 0), (9, 0), (0, 9), (0, 0)]])])})
    want = [sorted(map(str, typed.decode_payloads(rows(spark, [tile])).collect())), typed.payload_totals(rows(spark, [tile])).collect()]
    pieces = in_pieces(spark, [tile], 50)  # lines have more bytes, and are cut
    assert pieces.where("cut").count() > 100 and max(len(r["tile"]) for r in pieces.collect()) <= 50
    assert b"".join(bytes(r["tile"]) for r in pieces.orderBy("piece").collect()) == bytes(typed.encode_payloads(typed.decode_payloads(rows(spark, [tile])), ["at"]).first()["tile"])
    assert pieces.select(F.shiftright("piece", 44)).distinct().count() > 1  # of more tasks than one
    monkeypatch.setattr(typed, "whole", whole)
    got = typed.payload_totals(pieces).collect()
    assert [r[4:] for r in got] == [r[4:] for r in want[1]] and got[0]["bytes"] == sum(r["size"] for r in pieces.collect())
    assert sorted(map(str, typed.decode_payloads(pieces).collect())) == want[0]


def test_limits_of_payloads_in_pieces_are_those_of_whole_ones(spark):
    shape = lambda n: [[(k, k * k) for k in range(n)]]
    tiles = [payload({name: (4096, [(k, 2, {"k": (5, 1), "l": (5, k)}, shape(n)) for k in range(m)]) for name in names}) for names, m, n in (("a", 3, 2), ("ab", 4, 2), ("abc", 2, 9), ("a", 30, 3))]
    whole = [bytes(r["tile"]) for r in typed.encode_payloads(typed.decode_payloads(rows(spark, tiles)), ["at"], ["z", "x", "y", "payload"]).orderBy("payload").collect()]
    pieces = in_pieces(spark, tiles, 64)
    for limits in ({}, {"bytes": 200}, {"layers": 2}, {"features": 7}, {"points": 20}, {"feature_points": 8}, {"properties": 1}, {"scale": 0}, {"least_extent": 5000}):
        got = typed.payload_totals(pieces, limits, ["payload"]).orderBy("payload").collect()
        assert got == typed.payload_totals(rows(spark, whole), limits, ["payload"]).orderBy("payload").collect()
        assert bool(limits) == any(r["broken"] for r in got)
    with pytest.raises(Exception, match="payload 2 of tile 0/0/0: 3 layers"):
        typed.decode_payloads(pieces, {"layers": 2}).count()
    with pytest.raises(Exception, match="payload 2 of tile 0/0/0: 9 points in [abc]/[01]"):
        typed.decode_payloads(pieces, {"feature_points": 8}).count()
    lies = pieces.withColumn("held", F.when(F.col("payload") == 0, F.col("held") + 1).otherwise(F.col("held")))
    with pytest.raises(Exception, match="other features than its index says"):
        typed.decode_payloads(lies).count()
    assert typed.payload_totals(lies, keys=["payload"]).orderBy("payload").collect() == typed.payload_totals(rows(spark, whole), keys=["payload"]).orderBy("payload").collect()


def test_merge_of_pieces_equals_loop(spark, monkeypatch):
    r = random.Random(31)
    path = [(k * 10, k * k) for k in range(30)]

    def feature():
        gtype = r.choice([1, 2, 2, 2, 3])
        a = r.randrange(20)
        parts = [[r.choice(path[:9])]] if gtype == 1 else [path[a : a + r.randint(2, 9)] for _ in range(r.randint(1, 2))] if gtype == 2 else [[(0, 0), (r.choice([5, 9]), 0), (3, 8), (0, 0)]]
        if r.random() < 0.1:
            parts = [[(4096 * 64 + 1, 0)]] if gtype == 1 else parts
        if gtype == 2 and r.random() < 0.5:
            parts = [p[::-1] for p in parts]
        props = [("k", r.choice([(5, 1), (1, "1"), (7, True), (3, 1.5)])), ("j", (6, -3)), ("none", (9, 0))][: r.randint(0, 3)]
        return r.choice([None, None, 1, 2, 2**63 + 1]), gtype, dict(r.sample(props, len(props))), parts

    tiles = [payload({name: (4096, [feature() for _ in range(r.randint(1, 60))]) for name in r.sample(["a", "b", "road"], 2)}) for _ in range(6)]
    pieces = in_pieces(spark, tiles, 90)
    want = bytes(typed.merge_payloads(rows(spark, tiles)).first()["tile"])

    def whole(*_):
        raise AssertionError("a tile is held as one")

    monkeypatch.setattr(typed, "whole", whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        merged = typed.merge_payloads(pieces, piece=90).orderBy("piece").collect()
        only = typed.merge_payloads(pieces, include=["a", "b"], exclude=["b"], piece=90)
        assert {f["layer"] for f in typed.decode_payloads(only.withColumn("payload", F.lit(0))).collect()} == {"a"}
        assert typed.merge_payloads(pieces, include=["none"], piece=90).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = b"".join(bytes(r["tile"]) for r in merged)
    assert got == want
    assert [(name, fid, gtype, props, [list(p) for p in geom]) for _, name, _, _, _, fid, gtype, props, geom in typed.read_payload(got)] == merged_by_loop(tiles, 64)
