"""Vector tiles on the wire: encode and decode by the public specification, in Arrow batches.

A tile is layers of features; geometry is a stream of move, line and close commands with zigzag deltas, properties are
pairs of indexes into each layer's keys and values.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.storage import partitions

FEATURES = "z int, x int, y int, layer string, version int, extent int, fid long, gtype int, props map<string,string>, geom array<array<struct<x:double,y:double>>>"
#: Limits of one tile: bytes, layers, features, points of a feature and of the tile.
LIMITS = {"bytes": 24 << 20, "layers": 256, "features": 500_000, "feature_points": 250_000, "points": 4_000_000}


#: Numbers of one byte.
_ONE = [bytes([n]) for n in range(128)]


def _varint(n: int) -> bytes:
    if 0 <= n < 128:
        return _ONE[n]
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 ^ n >> 63


def _geometry(gtype: int, parts: list[list[tuple[int, int]]]) -> bytes:
    out, cx, cy = [], 0, 0
    if gtype == 1:
        parts = [[p for part in parts for p in part]]
    for part in parts:
        closed = gtype == 3 and len(part) > 1 and part[0] == part[-1]
        pts = part[:-1] if closed else part
        head = len(pts) if gtype == 1 else 1
        for k, (x, y) in enumerate(pts):
            if k == 0:
                out.append(head << 3 | 1)
            elif k == 1 and gtype != 1:
                out.append((len(pts) - 1) << 3 | 2)
            out += [_zigzag(x - cx), _zigzag(y - cy)]
            cx, cy = x, y
        if gtype == 3:
            out.append(1 << 3 | 7)
    return b"".join(map(_varint, out))


def encode_tile(layers: dict[str, tuple[int, int, list[dict]]]) -> bytes:
    """Bytes of {name: (version, extent, [{fid, gtype, props, geom}])}; layers without features are left out."""
    out = b""
    for name, (version, extent, features) in layers.items():
        if not features:
            continue
        keys, values, body = {}, {}, b""
        for f in features:
            tags = []
            for k, v in (f["props"] or {}).items():
                if v is not None:
                    tags += [keys.setdefault(k, len(keys)), values.setdefault(v, len(values))]
            own = _varint(1 << 3) + _varint(f["fid"]) if f.get("fid") is not None else b""
            own += _field(2, b"".join(map(_varint, tags))) + _varint(3 << 3) + _varint(f["gtype"])
            own += _field(4, _geometry(f["gtype"], [[(int(x), int(y)) for x, y in part] for part in f["geom"]]))
            body += _field(2, own)
        layer = _field(1, name.encode()) + body + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _field(1, v.encode())) for v in values)
        out += _field(3, layer + _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(version))
    return out


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        n = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise ValueError("a number is cut off")
            b = self.data[self.at]
            self.at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    def fields(self):
        while self.at < len(self.data):
            tag = self.varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, self.varint()
                continue
            size = self.varint() if kind == 2 else {1: 8, 5: 4}.get(kind)
            if size is None or self.at + size > len(self.data):
                raise ValueError("a field is cut off")
            yield tag >> 3, self.data[self.at : self.at + size]
            self.at += size


def _value(data: bytes) -> str | None:
    for k, v in _Reader(data).fields():
        if k == 1:
            return v.decode()
        if k == 2:
            return repr(struct.unpack("<f", v)[0])
        if k == 3:
            return repr(struct.unpack("<d", v)[0])
        if k == 4:
            return str(v - (1 << 64) if v >> 63 else v)
        if k == 5:
            return str(v)
        if k == 6:
            return str(v >> 1 ^ -(v & 1))
        if k == 7:
            return "true" if v else "false"
    return None


def _packed(data: bytes) -> list[int]:
    if data.isascii():  # every number has one byte
        return list(data)
    out, n, shift = [], 0, 0
    for b in data:
        if b < 128:
            out.append(n | b << shift)
            n = shift = 0
        else:
            n, shift = n | (b & 127) << shift, shift + 7
            if shift > 63:
                break
    if shift:
        raise ValueError("a number is cut off")
    return out


def decode_tile(data: bytes, limits: dict[str, int] | None = None) -> list[dict]:
    """Features of a tile in order. No bytes are a valid empty tile; broken ones, or ones beyond a limit, raise ValueError."""
    most = LIMITS | (limits or {})
    if len(data) > most["bytes"]:
        raise ValueError(f"more than {most['bytes']} bytes")
    out, n_layers, total = [], 0, 0
    for number, body in _Reader(data).fields():
        if number != 3:
            continue
        n_layers += 1
        if n_layers > most["layers"]:
            raise ValueError(f"more than {most['layers']} layers")
        name, keys, values, raw, extent, version = None, [], [], [], 4096, 1
        for k, v in _Reader(body).fields():
            if k == 1:
                name = v.decode()
            elif k == 2:
                raw.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(_value(v))
            elif k == 5:
                extent = v
            elif k == 15:
                version = v
        if name is None:
            raise ValueError("a layer has no name")
        for f in raw:
            fid, gtype, tags, commands = None, 0, [], []
            for k, v in _Reader(f).fields():
                if k == 1:
                    fid = v - (1 << 64) if v >> 63 else v  # as a signed number of the same 64 bits
                elif k == 2:
                    tags = _packed(v)
                elif k == 3:
                    gtype = v
                elif k == 4:
                    commands = _packed(v)
            if gtype not in (1, 2, 3) or len(tags) % 2:
                raise ValueError("a feature is broken")
            parts, x, y, at = [], 0, 0, 0
            while at < len(commands):
                op, count = commands[at] & 7, commands[at] >> 3
                at += 1
                if op == 7:
                    if not parts:
                        raise ValueError("a ring closes before it starts")
                    parts[-1].append(parts[-1][0])
                    continue
                if op not in (1, 2) or at + 2 * count > len(commands) or op == 2 and not parts:
                    raise ValueError("a geometry is broken")
                for _ in range(count):
                    x += commands[at] >> 1 ^ -(commands[at] & 1)
                    y += commands[at + 1] >> 1 ^ -(commands[at + 1] & 1)
                    at += 2
                    if op == 1:
                        parts.append([])
                    parts[-1].append((x, y))
            points = sum(map(len, parts))
            total += points
            if not points or points > most["feature_points"] or total > most["points"]:
                raise ValueError("a geometry is empty or too large")
            try:
                props = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}
            except IndexError as e:
                raise ValueError("a property is missing") from e
            out.append({"layer": name, "version": version, "extent": extent, "fid": fid, "gtype": gtype, "props": props, "geom": parts})
            if len(out) > most["features"]:
                raise ValueError(f"more than {most['features']} features")
    return out


def nested(geometries: list[list[list[tuple]]]) -> pa.ListArray:
    """Geometries as one array, over flat arrays of their points."""
    parts = [p for g in geometries for p in g]
    xy = np.array([v for p in parts for v in p], np.float64).reshape(-1, 2)
    ends = lambda of: pa.array(np.concatenate([[0], np.cumsum([len(v) for v in of], dtype=np.int64)]).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in range(2)], names=["x", "y"])
    return pa.ListArray.from_arrays(ends(geometries), pa.ListArray.from_arrays(ends(parts), points))


#: Features in a batch that goes out of a task.
ROWS = 5000


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """Features of tiles (z, x, y, tile); a broken tile fails its task with its address. Properties are text, ids signed
    (those from 2 ** 63 up are negative, and encode to the same bits); sources.typed keeps kinds and unsigned ids.

    Tiles are taken one by one, and features go out as they come: a task holds one tile's and ROWS of those before."""

    def run(batches):
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in rows], pa.int32()) for k in range(3)), pa.array([r[3]["layer"] for r in rows], pa.string()), *(pa.array([r[3][c] for r in rows], pa.int32()) for c in ("version", "extent")),
                 pa.array([r[3]["fid"] for r in rows], pa.int64()), pa.array([r[3]["gtype"] for r in rows], pa.int32()), pa.array([list(r[3]["props"].items()) for r in rows], pa.map_(pa.string(), pa.string())),
                 nested([r[3]["geom"] for r in rows])],
                names=["z", "x", "y", "layer", "version", "extent", "fid", "gtype", "props", "geom"],
            )

        for batch in batches:
            bodies = batch.column("tile")
            for k, (z, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y")), strict=True)):
                try:
                    found = decode_tile(bodies[k].as_py() or b"")
                except ValueError as e:
                    raise ValueError(f"tile {z}/{x}/{y}: {e}") from e
                for f in found:
                    rows.append((z, x, y, f))
                    if len(rows) == ROWS:
                        yield made()
                        rows.clear()
        if rows:
            yield made()

    return tiles.select("z", "x", "y", "tile").mapInArrow(run, FEATURES)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of numbers (unsigned, 64 bits) as varints, and where each begins; one place more than numbers."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        low = (values[own] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[starts[:-1][own] + k] = low | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out, starts


def flat_geometries(gtype: np.ndarray, geom: pa.ListArray) -> list[bytes]:
    """The command streams of a batch of geometries, as flat_streams() makes them."""
    data, bounds, _ = flat_streams(gtype, geom)
    data = data.tobytes()
    return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def flat_streams(gtype: np.ndarray, geom: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The command streams of a batch of geometries, over flat arrays of all their points: the bytes, where each stream
    begins, and how many points a reader gets of each. Parts without points are left out; a point that isn't a number is
    refused."""
    parts = geom.flatten()
    of_part = np.repeat(np.arange(len(geom)), pc.fill_null(pc.list_value_length(geom), 0).to_numpy(zero_copy_only=False))
    lengths = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    points = parts.flatten()
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]) if len(points) else np.zeros((2, 0))
    if not np.isfinite(xy).all():
        raise ValueError("a coordinate is not a number")
    xy = xy.astype(np.int64)
    part = np.repeat(np.arange(len(parts)), lengths)
    feature = of_part[part]
    ends = np.cumsum(lengths)
    # a ring's last point goes where it repeats the first
    rings = np.flatnonzero((gtype[of_part] == 3) & (lengths > 1))
    closed = rings[(xy[:, ends[rings] - lengths[rings]] == xy[:, ends[rings] - 1]).all(axis=0)]
    keep = np.ones(len(part), bool)
    keep[ends[closed] - 1] = False
    xy, part, feature = xy[:, keep], part[keep], feature[keep]
    kind = gtype[feature]
    new = np.ones(len(part), bool)
    new[1:] = feature[1:] != feature[:-1]
    step = np.diff(xy, axis=1, prepend=0)
    step[:, new] = xy[:, new]
    # all points of a multipoint are under one command
    run = new.copy()
    run[1:] |= (part[1:] != part[:-1]) & (kind[1:] != 1)
    first = np.flatnonzero(run)
    held = np.diff(np.append(first, len(part)))
    at = np.arange(len(part)) - np.repeat(first, held)
    held = np.repeat(held, held)
    command = np.where(at == 0, np.where(kind == 1, held, 1) << 3 | 1, np.where((at == 1) & (kind != 1), (held - 1) << 3 | 2, 0))
    shut = (at == held - 1) & (kind == 3)
    count = 2 + (command > 0) + shut
    begin = np.concatenate([[0], np.cumsum(count)])
    stream = np.zeros(begin[-1], np.int64)
    led = command > 0
    stream[begin[:-1][led]] = command[led]
    for k in range(2):
        stream[begin[:-1] + led + k] = step[k] << 1 ^ step[k] >> 63
    stream[begin[1:][shut] - 1] = 1 << 3 | 7
    data, starts = varints(stream.view(np.uint64))
    bounds = starts[begin[np.searchsorted(feature, np.arange(len(geom) + 1))]]
    return data, bounds, np.bincount(feature, weights=1 + shut, minlength=len(geom)).astype(np.int64)


class _Tile:
    """A tile that grows feature by feature, layer by layer."""

    def __init__(self) -> None:
        self.out: list[bytes] = []
        self.head: tuple | None = None

    def start(self, head: tuple) -> None:
        self.end()
        self.head, self.keys, self.values, self.body = head, {}, {}, []

    def add(self, fid: int | None, gtype: int, props: list[tuple], geometry: bytes) -> None:
        keys, values = self.keys, self.values
        tags = b"".join([_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault(v, len(values))) for k, v in props if v is not None])
        own = b"".join((b"" if fid is None else b"\x08" + _varint(fid), _field(2, tags), b"\x18", _varint(gtype), _field(4, geometry)))
        self.body.append(_field(2, own))

    def end(self) -> bytes:
        if self.head:
            name, version, extent = self.head
            layer = _field(1, name.encode()) + b"".join(self.body) + b"".join(_field(3, k.encode()) for k in self.keys) + b"".join(_field(4, _field(1, v.encode())) for v in self.values)
            self.out.append(_field(3, layer + _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(version)))
            self.head = None
        return b"".join(self.out)


def encode_tiles(features: DataFrame) -> DataFrame:
    """(z, x, y, tile) of features; layers and features in order of name and id, those without an id last. A layer has the
    version and extent of its first feature.

    Features are dealt by address and sorted; a task streams them and holds one tile's bytes at a time. Geometries of a
    batch are encoded over flat arrays.
    """
    order = ["z", "x", "y", "layer", F.col("fid").asc_nulls_last()]
    rows = features.repartition(partitions(features.sparkSession, features), "z", "x", "y").sortWithinPartitions(*order)
    names = ["z", "x", "y", "layer", "version", "extent", "fid", "gtype", "props", "geom"]

    def run(batches):
        address, tile = None, _Tile()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in address), pa.array([tile.end()], pa.binary())], names=["z", "x", "y", "tile"])

        for batch in batches:
            gtype = batch.column("gtype").to_numpy(zero_copy_only=False)
            streams = flat_geometries(gtype, batch.column("geom"))
            z, x, y, layer, version, extent, fid, gtypes, props = (batch.column(c).to_pylist() for c in names[:-1])
            for k, stream in enumerate(streams):
                if (z[k], x[k], y[k]) != address:
                    if address is not None:
                        yield made()
                    address, tile = (z[k], x[k], y[k]), _Tile()
                if tile.head is None or tile.head[0] != layer[k]:
                    tile.start((layer[k], version[k], extent[k]))
                tile.add(fid[k], gtypes[k], props[k] or [], stream)
        if address is not None:
            yield made()

    return rows.select(*names).mapInArrow(run, "z int, x int, y int, tile binary")
