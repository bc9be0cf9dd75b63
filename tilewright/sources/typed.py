"""Whole vector-tile payloads with typed properties: bytes in, checked, merged feature by feature, bytes out.

A property is a struct of text, number and flag, of which one is set. Numbers are doubles, which hold whole numbers up to
2 ** 53 exactly; larger ones and those that aren't finite become text, as they would not survive another engine. Ids are
unsigned numbers of 64 bits, kept whole as decimals.

Payloads are decoded where they lie; features, not payloads, move to where their tile meets, and merging is the reduction
of operators.features. A layer whose payloads disagree on its extent stops the job, with the tile's address.

A payload in pieces is written and read by many tasks: each piece is whole features of one layer, or what stands around
them, and columns beside its bytes (INDEX) say where it belongs. Readers hold those columns against the bytes.
"""

from __future__ import annotations

import json
import math
import struct
from array import array
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.features import SHAPE, merge, with_shape
from tilewright.plans.storage import durable, partitions
from tilewright.sources.flat import as_binary, as_bytes, as_decimals, constant, ends_of, features_of, low_bits, ragged, run_starts, woven
from tilewright.sources.mvt import _field, _geometry, _packed, _Reader, _varint, flat_geometries, flat_streams, nested, varints  # noqa: F401

PROPS = "map<string,struct<text:string,number:double,flag:boolean>>"
GEOM = "array<array<struct<x:double,y:double>>>"
FEATURES = f"z int, x int, y int, payload int, layer_at int, layer string, version int, extent int, at long, fid decimal(20,0), gtype int, props {PROPS}, geom {GEOM}"
SAFE = (1 << 53) - 1
# fixed values: the limits of a payload
LIMITS = {"bytes": 24 << 20, "layers": 256, "features": 500_000, "feature_points": 250_000, "points": 4_000_000, "properties": 256, "name": 200, "scale": 128, "least_extent": 256, "most_extent": 16_384}
TOTALS = "bytes long, layers long, features long, points long, broken string"


def number_text(v: float) -> str:
    """A number as browsers write it: the shortest digits, filled up with zeros below 10 ** 21."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    digits, _, power = f"{abs(v):.17g}".partition("e") if v == 0 else repr(abs(v)).partition("e")
    whole, _, rest = digits.partition(".")
    rest = "" if rest == "0" else rest
    point = len(whole) + int(power or 0)
    text = (whole + rest).lstrip("0") or "0"
    point -= len(whole + rest) - len((whole + rest).lstrip("0") or "0")
    sign = "-" if v < 0 else ""
    if 0 < point <= 21:
        return sign + (text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}")
    if -6 < point <= 0:
        return sign + "0" if v == 0 else f"{sign}0.{'0' * -point}{text}"
    shift = point - 1
    return f"{sign}{text[0]}{'.' * (len(text) > 1)}{text[1:]}e{'+' if shift > 0 else '-'}{abs(shift)}"


def normal(value) -> dict:
    """The struct of a value: whole numbers that a double doesn't hold for sure, and numbers that aren't finite, as text."""
    if isinstance(value, bool):
        return {"text": None, "number": None, "flag": value}
    if isinstance(value, int | float):
        number = float(value)
        if not math.isfinite(number) or number.is_integer() and abs(number) > SAFE:
            return {"text": number_text(number), "number": None, "flag": None}
        return {"text": None, "number": number, "flag": None}
    return {"text": value, "number": None, "flag": None}


def _value(data: bytes):
    out = None
    for k, v in _Reader(data).fields():
        if k == 1:
            out = v.decode()
        elif k in (2, 3):
            out = struct.unpack("<f" if k == 2 else "<d", v)[0]
        elif k == 4:
            out = v - (1 << 64) if v >> 63 else v
        elif k == 5:
            out = v
        elif k == 6:
            out = v >> 1 ^ -(v & 1)
        elif k == 7:
            out = bool(v)
    return out


def _encoded(value: tuple) -> bytes:
    """A value (text, number, flag) by its kind: fractions as doubles, whole numbers as unsigned or, below 0, as zigzag ones."""
    text, v, flag = value
    if text is not None:
        return _field(1, text.encode())
    if flag is not None:
        return _varint(7 << 3) + _varint(int(flag))
    if not v.is_integer():
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _varint(5 << 3) + _varint(int(v)) if v >= 0 else _varint(6 << 3) + _varint(-int(v) * 2 - 1)


class Broken(ValueError):
    """A payload beyond a limit, or one that can't be read; kind names what is wrong."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def read_payload(data: bytes, limits: dict[str, int] | None = None, totals: dict[str, int] | None = None) -> Iterator[tuple]:
    """(layer_at, layer, version, extent, at, fid, gtype, props, geom) of a payload, layer by layer; Broken where a limit
    is passed. No bytes are the empty tile. totals gets what was counted up to the end or the breach."""
    most, seen = LIMITS | (limits or {}), totals if totals is not None else {}
    seen.update(bytes=len(data), layers=0, features=0, points=0)
    if len(data) > most["bytes"]:
        raise Broken("bytes", f"{len(data)} bytes")
    try:
        layers = [_layer(data, *span) for number, span in _spans(data, 0, len(data)) if number == 3]
    except (ValueError, UnicodeDecodeError, struct.error) as e:
        raise Broken("malformed", f"it can't be read: {e}") from e
    # of layers of one name the last stands, at the place of the first
    named = {layer["name"]: layer for layer in layers}
    seen["layers"] = len(named)
    if len(named) > most["layers"]:
        raise Broken("layers", f"{len(named)} layers")
    for layer_at, (name, layer) in enumerate(named.items()):
        if not name or len(name) > most["name"]:
            raise Broken("name", "a layer's name is empty or too long")
        if not most["least_extent"] <= layer["extent"] <= most["most_extent"]:
            raise Broken("extent", f"extent {layer['extent']} of {name}")
        seen["features"] += len(layer["raw"]) // 2
        if seen["features"] > most["features"]:
            raise Broken("features", f"{seen['features']} features")
        for at, *feature in _features(data, layer, 0, most, seen):
            yield layer_at, name, layer["version"], layer["extent"], at, *feature


def _features(data: bytes, layer: dict, first: int, most: dict[str, int], seen: dict[str, int]) -> Iterator[tuple]:
    """(at, fid, gtype, props, geom) of a layer's features in data, numbered from first."""
    name, bounds = layer["name"], layer["raw"]
    for at in range(len(bounds) // 2):
        raw, at = data[bounds[2 * at] : bounds[2 * at + 1]], first + at
        try:
            fid, gtype, props, geom = _feature(raw, layer)
        except (ValueError, IndexError) as e:
            raise Broken("malformed", f"feature {name}/{at}: {e}") from e
        if gtype not in (1, 2, 3):
            raise Broken("type", f"type {gtype} in {name}/{at}")
        if len(props) > most["properties"]:
            raise Broken("properties", f"{len(props)} properties in {name}/{at}")
        n, reach = sum(map(len, geom)), layer["extent"] * most["scale"]
        if any(abs(x) > reach or abs(y) > reach for part in geom for x, y in part):
            raise Broken("coordinates", f"coordinates of {name}/{at}")
        seen["points"] += n
        if n > most["feature_points"]:
            raise Broken("feature_points", f"{n} points in {name}/{at}")
        if seen["points"] > most["points"]:
            raise Broken("points", f"{seen['points']} points")
        if not n:
            raise Broken("empty", f"no points in {name}/{at}")
        yield at, fid, gtype, {k: normal(v) for k, v in props.items() if v is not None}, geom


def _spans(data: bytes, at: int, end: int) -> Iterator[tuple]:
    """(number, value) of the fields in at to end; a field of bytes as the places where it begins and ends."""
    r = _Reader(data)
    r.at = at
    while r.at < end:
        tag = r.varint()
        kind = tag & 7
        if kind == 0:
            value = r.varint()
        else:
            size = r.varint() if kind == 2 else {1: 8, 5: 4}.get(kind)
            if size is None or r.at + size > end:
                raise ValueError("a field is cut off")
            value = (r.at, r.at + size)
            r.at += size
        if r.at > end:
            raise ValueError("a number is cut off")
        yield tag >> 3, value


def _layer(data: bytes, start: int, end: int) -> dict:
    """A layer of a payload; raw: where each feature begins and ends, in turns, as numbers and not as objects."""
    out = {"name": "", "version": 1, "extent": 4096, "keys": [], "values": [], "raw": array("Q")}
    for k, v in _spans(data, start, end):
        if k == 2:
            out["raw"].extend(v)
        elif k == 1:
            out["name"] = data[slice(*v)].decode()
        elif k == 3:
            out["keys"].append(data[slice(*v)].decode())
        elif k == 4:
            out["values"].append(_value(data[slice(*v)]))
        elif k == 5:
            out["extent"] = v
        elif k == 15:
            out["version"] = v
    return out


def _feature(raw: bytes, layer: dict) -> tuple:
    fid, gtype, tags, commands = None, 0, [], []
    for k, v in _Reader(raw).fields():
        if k == 1:
            fid = v
        elif k == 2:
            tags = _packed(v)
        elif k == 3:
            gtype = v
        elif k == 4:
            commands = _packed(v)
    if len(tags) % 2:
        raise ValueError("a property has no value")
    return fid, gtype, {layer["keys"][a]: layer["values"][b] for a, b in zip(tags[::2], tags[1::2], strict=True)}, _parts(commands)


def _parts(commands: list[int]) -> list[list[tuple[int, int]]]:
    """The parts that a geometry's commands draw."""
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
    return parts


class _Payload:
    """A payload that grows feature by feature, layer by layer; the bytes of one layer are held."""

    def __init__(self) -> None:
        self.head: tuple | None = None

    def start(self, head: tuple) -> None:
        self.head, self.keys, self.values, self.seen, self.body = head, {}, {}, {}, bytearray()

    def _tags(self, props: list[tuple]) -> bytes:
        keys, values, seen, out = self.keys, self.values, self.seen, b""
        for k, v in props:
            at = seen.get(v)
            if at is None:
                at = seen[v] = values.setdefault(_encoded(v), len(values))
            out += _varint(keys.setdefault(k, len(keys))) + _varint(at)
        return _field(2, out)

    def add(self, fid: int | None, gtype: int, props: list[tuple], geometry: bytes) -> None:
        own = (b"" if fid is None else b"\x08" + _varint(int(fid))) + self._tags(props) + b"\x18" + _varint(gtype) + _field(4, geometry)
        self.body += _field(2, own)

    def end(self) -> bytes:
        """The layer that was begun; nothing if none was."""
        if self.head is None:
            return b""
        first, last = _around(*self.head, self.keys, self.values, len(self.body))
        self.head = None
        return first + self.body + last


def _around(name: str, version: int, extent: int, keys: Iterable[str], values: Iterable[bytes], held: int) -> tuple[bytes, bytes]:
    """A layer's bytes before and after its features, which are held bytes."""
    first, last = _field(1, name.encode()), b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values) + _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(version)
    return _varint(3 << 3 | 2) + _varint(len(first) + held + len(last)) + first, last


def in_order(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Payloads (keys, tile) as they are; those in pieces (keys, piece, tile) with a payload's pieces one after another."""
    if "piece" not in payloads.columns:
        return payloads.select(*keys, "tile")
    return payloads.select(*keys, "piece", "tile").repartition(partitions(payloads.sparkSession, payloads), *keys).sortWithinPartitions(*keys, "piece")


def whole(batches, keys: list[str]) -> Iterator[tuple[tuple, bytes]]:
    """(key, bytes) of the payloads in batches of in_order(), one at a time and never copied: what grew out of pieces is
    handed over as it is."""
    key, held = None, bytearray()
    for batch in batches:
        tiles = batch.column("tile")
        pieces = batch.schema.get_field_index("piece") >= 0
        for k, own in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True)):
            data = tiles[k].as_py() or b""
            if not pieces:
                yield own, data
                continue
            if own != key and key is not None:
                yield key, held
                held = bytearray()
            key = own
            held += data
    if key is not None:
        yield key, held


VALUE = pa.struct([("text", pa.string()), ("number", pa.float64()), ("flag", pa.bool_())])


def decode_payloads(payloads: DataFrame, limits: dict[str, int] | None = None, rows: int = 2000) -> DataFrame:
    """Features of payloads (z, x, y, payload, tile), whole or in pieces, in their order; a null tile is empty. One beyond
    a limit fails its task and names its address. Pieces with their INDEX are decoded side by side."""
    keys = ["z", "x", "y", "payload"]
    payloads = payloads.withColumn("payload", F.col("payload").cast("int"))
    if not indexed(payloads):
        return _decoded(payloads, keys, limits, rows)
    frames, odd = _frames(payloads, keys, limits)
    if odd is None:
        return _decoded_pieces(payloads, frames, limits)
    return _decoded_pieces(_of(payloads, odd, keys, "left_anti"), frames, limits).unionByName(_decoded(_of(payloads, odd, keys), keys, limits, rows))


def _decoded(payloads: DataFrame, keys: list[str], limits: dict[str, int] | None, rows: int) -> DataFrame:
    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32()] * 5 + [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(20, 0), pa.int32(), pa.map_(pa.string(), VALUE)]
        columns = [[r[k] for r in out] for k in range(12)]
        columns[9] = [None if v is None else Decimal(v) for v in columns[9]]
        columns[11] = [list(v.items()) for v in columns[11]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), nested([r[12] for r in out])], names=["z", "x", "y", "payload", "layer_at", "layer", "version", "extent", "at", "fid", "gtype", "props", "geom"])

    def run(batches):
        out: list[tuple] = []
        for (*address, payload), tile in whole(batches, keys):
            try:
                for f in read_payload(tile, limits):
                    out.append((*address, payload, *f))
                    if len(out) == rows:
                        yield batch(out)
                        out = []
            except Broken as e:
                raise ValueError(f"payload {payload} of tile {'/'.join(map(str, address))}: {e}") from e
        if out:
            yield batch(out)

    return in_order(payloads, keys).mapInArrow(run, FEATURES)


#: What stands beside each piece: its layer, that layer's number in the payload, the number of its first feature (null
#: for a piece of what stands around the features), its features, points and bytes, and whether it is cut from one feature.
INDEX = "layer_id long, layer_at int, at long, held int, points long, size long, cut boolean"
_INDEX = [c.split()[0] for c in INDEX.split(", ")]


def indexed(payloads: DataFrame) -> bool:
    return {"piece", *_INDEX} <= set(payloads.columns)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= a[k].eqNullSafe(b[k])
    return on


def _of(pieces: DataFrame, some: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    return pieces.join(some, _same(pieces, some, keys), how)


def _glued(pieces: DataFrame, by: list[str], *sums: Column) -> DataFrame:
    """The bytes of pieces that stand together, as one."""
    tiles = F.sort_array(F.collect_list(F.struct("piece", "tile")))
    return pieces.groupBy(*by).agg(tiles.alias("_t"), *sums).withColumn("tile", F.aggregate("_t", F.lit(b""), lambda have, p: F.concat(have, p["tile"]))).drop("_t")


def _framed(frame: bytes, held: int) -> dict:
    """The layer whose bytes around its features are frame, and whose features have held bytes."""
    r = _Reader(frame)
    tag, size = r.varint(), r.varint()
    if tag != 3 << 3 | 2 or size != len(frame) - r.at + held:
        raise ValueError("a layer's length is wrong")
    layer = _layer(frame, r.at, len(frame))
    if len(layer["raw"]):
        raise ValueError("a feature stands outside of its piece")
    return layer


def _frames(pieces: DataFrame, keys: list[str], limits: dict[str, int] | None) -> tuple[DataFrame, DataFrame | None]:
    """A row for each layer of payloads in indexed pieces: (keys, layer_id, layer_at, frame, layer, version, extent, held,
    points, size); and the payloads that a limit of a whole payload or layer may be about, which are then read from
    their first byte to the last, or None."""
    most = LIMITS | (limits or {})
    around = _glued(pieces.where("at IS NULL"), [*keys, "layer_id", "layer_at"]).withColumnRenamed("tile", "frame")
    within = pieces.where("at IS NOT NULL").groupBy("layer_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("held", "points", "size")))
    rows = around.join(within, "layer_id").select(*keys, "layer_id", "layer_at", "frame", "held", "points", "size")

    def run(batches):
        for batch in batches:
            out = []
            for frame, size in zip(batch.column("frame"), batch.column("size").to_pylist(), strict=True):
                try:
                    layer = _framed(frame.as_py(), size)
                    sound = 0 < len(layer["name"]) <= most["name"] and most["least_extent"] <= layer["extent"] <= most["most_extent"] and max(layer["version"], layer["extent"]) < 1 << 31
                except (ValueError, struct.error):
                    sound = False
                out.append((layer["name"], layer["version"], layer["extent"], True) if sound else (None, None, None, False))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=[*batch.schema.names, "layer", "version", "extent", "sound"])

    frames = durable(rows.mapInArrow(run, ", ".join(f"{k} {kind}" for k, kind in rows.dtypes) + ", layer string, version int, extent int, sound boolean"))
    total = frames.groupBy(*keys).agg(
        F.sum(F.col("size") + F.octet_length("frame")).alias("_bytes"), F.count("*").alias("_layers"), F.count_distinct("layer").alias("_names"), F.sum("held").alias("_held"), F.sum("points").alias("_points"), F.every("sound").alias("_sound")
    )
    beyond = ~F.col("_sound") | (F.col("_layers") > F.col("_names")) | (F.col("_layers") > most["layers"]) | (F.col("_bytes") > most["bytes"]) | (F.col("_held") > most["features"]) | (F.col("_points") > most["points"])
    odd = durable(total.where(beyond).select(*keys))
    return frames, None if odd.isEmpty() else odd


def _bodies(pieces: DataFrame, frames: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The pieces of features, those of one feature as one, each with its layer's frame."""
    rows = pieces.where("at IS NOT NULL")
    own = [*keys, "layer_id", "layer_at", "at"]
    sums = [F.sum(c).cast(kind).alias(c) for c, kind in (("held", "int"), ("points", "long"), ("size", "long"))]
    both = rows.where("NOT cut").select(*own, "held", "points", "size", "tile").unionByName(_glued(rows.where("cut"), own, *sums))
    return both.join(frames.select("layer_id", "frame", F.col("size").alias("whole"), *more), "layer_id")


def _decoded_pieces(pieces: DataFrame, frames: DataFrame, limits: dict[str, int] | None) -> DataFrame:
    keys, most = ["z", "x", "y", "payload"], LIMITS | (limits or {})
    names = ["z", "x", "y", "payload", "layer_at", "layer", "version", "extent", "at", "fid", "gtype", "props", "geom"]

    def run(batches):
        for batch in batches:
            for row, layer, first, data, index in _body_rows(batch):
                try:
                    found, plain = _read_body(layer, first, data, index, most)
                except Broken as e:
                    *address, payload = (batch.column(c)[row].as_py() for c in keys)
                    raise ValueError(f"payload {payload} of tile {'/'.join(map(str, address))}: {e}") from e
                if found:
                    n, columns = len(found[1]), _columns(layer, *found)
                else:
                    n, fid, props = len(plain), [None if f[1] is None else Decimal(f[1]) for f in plain], [list(f[3].items()) for f in plain]
                    columns = [pa.array(fid, pa.decimal128(20, 0)), pa.array([f[2] for f in plain], pa.int32()), pa.array(props, pa.map_(pa.string(), VALUE)), nested([f[4] for f in plain])]
                same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)  # noqa: B023, E731
                heads = [same(batch.column(c)[row].as_py(), pa.int32()) for c in [*keys, "layer_at"]]
                yield pa.RecordBatch.from_arrays([*heads, same(layer["name"], pa.string()), same(layer["version"], pa.int32()), same(layer["extent"], pa.int32()), pa.array(np.arange(first, first + n)), *columns], names=names)

    return _bodies(pieces, frames, keys).mapInArrow(run, FEATURES)


def _columns(layer: dict, ids: np.ndarray, known: np.ndarray, gtype: np.ndarray, counts: np.ndarray, key: np.ndarray, value: np.ndarray, shapes: tuple) -> list[pa.Array]:
    """fid, gtype, props and geom of features_of(). Properties without a value are left out."""
    texts = pa.array(layer["keys"], pa.string())
    values = pa.array([{"text": None, "number": None, "flag": None} if v is None else normal(v) for v in layer["values"]], VALUE)
    counts, key, value = _with_value(layer, counts, key, value)
    ends = pa.array(ends_of(counts).astype(np.int32))
    return [as_decimals(ids, known), pa.array(gtype.astype(np.int32)), pa.MapArray.from_arrays(ends, texts.take(pa.array(key)), values.take(pa.array(value))), _drawn(shapes)]


def _with_value(layer: dict, counts: np.ndarray, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tags whose value is one."""
    if all(v is not None for v in layer["values"]):
        return counts, key, value
    have = np.array([v is not None for v in layer["values"]])[value]
    return np.bincount(np.repeat(np.arange(len(counts)), counts)[have], minlength=len(counts)), key[have], value[have]


def _drawn(shapes: tuple) -> pa.ListArray:
    """What geometries() found, as GEOM."""
    _, parts, part_at, x, y = shapes
    points = pa.StructArray.from_arrays([pa.array(v.astype(np.float64)) for v in (x, y)], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends_of(parts).astype(np.int32)), pa.ListArray.from_arrays(pa.array(part_at.astype(np.int32)), points))


def _body_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(row, layer, number of the first feature, bytes, what the index says of them) of each row of _bodies()."""
    seen = layer = None
    for row, (own, first, held, points, size, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("layer_id", "at", "held", "points", "size", "whole")), strict=True)):
        if own != seen:
            seen, layer = own, _framed(batch.column("frame")[row].as_py(), whole)
            layer["apart"] = len(set(layer["keys"])) == len(layer["keys"])
        yield row, layer, first, batch.column("tile")[row].as_py(), (held, points, size)


def _read_body(layer: dict, first: int, data: bytes, index: tuple, most: dict[str, int]) -> tuple[tuple | None, list | None]:
    """The features in data: as features_of() has them; one by one where a limit may be about one of them or they are
    written in another way. Broken where they break a limit or aren't those that the index says."""
    found = features_of(data, len(layer["keys"]), len(layer["values"])) if data and layer["apart"] else None
    if found:
        n, _, _, x, y = found[-1]
        if max(np.abs(x).max(), np.abs(y).max()) <= layer["extent"] * most["scale"] and found[3].max() <= most["properties"] and n.max() <= most["feature_points"] and (len(n), int(n.sum()), len(data)) == index:
            return found, None
    layer, seen = dict(layer, raw=array("Q")), {"points": 0}
    try:
        for k, v in _spans(data, 0, len(data)):
            if k != 2:
                raise ValueError("a piece holds more than features")
            layer["raw"].extend(v)
    except (ValueError, TypeError) as e:
        raise Broken("malformed", f"it can't be read: {e}") from e
    plain = list(_features(data, layer, first, most, seen))
    if (len(plain), seen["points"], len(data)) != index:
        raise Broken("malformed", "a piece holds other features than its index says")
    return None, plain


#: Bytes of a piece of a payload that goes from task to task in pieces.
PIECE = 4 << 20


def encode_payloads(features: DataFrame, order: list[str], keys: list[str] | None = None, piece: int | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """(z, x, y, tile, and further keys) of features: layers by layer_at and name, features by order. With piece, each
    payload is rows of so many bytes at most: (keys, piece, tile, INDEX), with numbers that ascend in their order.

    Features are dealt by keys and sorted; a task streams them and holds one payload's bytes. With piece they are dealt by
    ranges of keys and order, so that a payload is written by many tasks, and a task holds a batch of features. made are
    columns of features, other than those they are dealt by, that are made of its others once they lie where they are
    written: neither the sample that finds the ranges nor the exchange has them then.
    """
    keys = keys or ["z", "x", "y"]
    if piece:
        return _encoded_pieces(features, order, keys, piece, made or {})
    features = features.withColumns(made) if made else features
    own = ["layer_at", "layer", "version", "extent", "fid", "gtype", "geom"]
    # a map can't be sorted; its entries can
    rows = features.select(*keys, *(F.col(c).alias(f"_{k}") for k, c in enumerate(order)), *own, F.map_entries("props").alias("props"))
    by = [*keys, "layer_at", "layer", *(f"_{k}" for k in range(len(order))), "version", "extent", "fid", "gtype", "geom", "props"]
    rows = rows.repartition(partitions(features.sparkSession, features), *keys).sortWithinPartitions(*by)
    kinds = dict(features.dtypes)
    out = f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, tile binary"

    def run(batches):
        key, made, tile, types = None, bytearray(), _Payload(), None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], kind) for v, kind in zip(key, types, strict=True)), pa.array([bytes(made)], pa.binary())], names=[*keys, "tile"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            streams = flat_geometries(batch.column("gtype").to_numpy(zero_copy_only=False), batch.column("geom"))
            addresses = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            entries = _entries(batch.column("props"))
            place, name, version, extent, fid, gtype = (batch.column(c).to_pylist() for c in own[:-1])
            for k, stream in enumerate(streams):
                if addresses[k] != key:
                    if key is not None:
                        made += tile.end()
                        yield row()
                    key, layer, made = addresses[k], None, bytearray()
                if name[k] != layer:
                    made += tile.end()
                    layer = name[k]
                    tile.start((layer, version[k], extent[k]))
                tile.add(fid[k], gtype[k], entries[k], stream)
        if key is not None:
            made += tile.end()
            yield row()

    return rows.select(*keys, *own, "props").mapInArrow(run, out)


def _encoded_pieces(features: DataFrame, order: list[str], keys: list[str], piece: int, made: dict[str, Column]) -> DataFrame:
    """encode_payloads() in pieces. Tasks write batches of features with keys and values of their own; these are united
    layer by layer, and each batch is finished by itself with its layer's numbers."""
    spark, kinds = features.sparkSession, dict(features.dtypes)
    own = ["layer", "version", "extent", "fid", "gtype", "geom"]
    by = list(dict.fromkeys([*keys, "layer_at", "layer", *order]))
    # a map can't be sorted; its entries can
    rows = features.withColumns({k: F.map_entries(k) for k, kind in kinds.items() if kind.startswith("map<")})
    rows = rows.repartitionByRange(partitions(spark, features), *by).sortWithinPartitions(*by, *(c for c in rows.columns if c not in by))
    # properties go to Python as texts, of which equal ones are read once; nested columns take six times as long
    if "body" in kinds:
        own = [*own[:3], "body"]
    else:
        own.append("props")
        rows = rows.withColumns({k: v for k, v in made.items() if k != "props"} | {"props": F.to_json(F.map_entries(made["props"]) if "props" in made else F.col("props"))})
    address = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def draft(batches):
        number = TaskContext.get().partitionId() << 44
        for batch in batches:
            bounds = [*run_starts(batch, [*keys, "layer"]).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(a, b - a)
                made = _draft(part)
                heads = [part.column(c).slice(0, 1) for c in [*keys, "layer", "version", "extent"]]
                yield pa.RecordBatch.from_arrays([*heads, pa.array([number], pa.int64()), *(pa.array([v], kind) for v, kind in zip(made, _DRAFT, strict=True))], names=[*keys, "layer", "version", "extent", "draft", "count", "names", "values", "sizes", "pairs", "front", "back"])
                number += 1 << 24

    drafts = durable(rows.select(*keys, *own).mapInArrow(draft, f"{address}, layer string, version int, extent int, draft long, count int, names array<string>, values array<binary>, sizes binary, pairs binary, front binary, back binary"))
    met = drafts.select(*keys, "layer", "version", "extent", "draft", "count", "names", "values").repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "draft")
    united = durable(met.mapInArrow(_unite(keys), f"{address}, {_UNITED}"))
    numbers = united.where("name_map IS NOT NULL").select("draft", "layer_id", "layer_at", "at", "name_map", "value_map")
    out = f"{address}, piece long, tile binary, {INDEX}"
    names = [*keys, "piece", "tile", *_INDEX]

    def finish(batches):
        for batch in batches:
            for k, (number, layer_id, layer_at, at, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("draft", "layer_id", "layer_at", "at", "count")), strict=True)):
                data, starts, points = _finished(*(batch.column(c)[k].as_py() for c in ("sizes", "pairs", "front", "back", "name_map", "value_map")))
                found = list(_rows_within(data, starts, points, piece))
                heads = [pa.repeat(batch.column(c)[k], len(found)) for c in keys]
                same = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(found))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [*heads, pa.array([number + (1 << 20) + n for n in range(len(found))], pa.int64()), pa.array([r[0] for r in found], pa.binary()), same(layer_id, pa.int64()), same(layer_at, pa.int32()), pa.array([at + r[1] for r in found], pa.int64()),
                     pa.array([r[2] for r in found], pa.int32()), pa.array([r[3] for r in found], pa.int64()), pa.array([len(r[0]) for r in found], pa.int64()), pa.array([r[4] for r in found], pa.bool_())], names=names,
                )

    bodies = durable(drafts.join(numbers, "draft").select(*keys, "draft", "count", "sizes", "pairs", "front", "back", "layer_id", "layer_at", "at", "name_map", "value_map").mapInArrow(finish, out))

    def around(batches):
        for batch in batches:
            address = [batch.column(c) for c in keys]
            for k, (layer, version, extent, texts, last, layer_id, layer_at, held) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("layer", "version", "extent", "names", "draft", "layer_id", "layer_at", "held")), strict=True)):
                sides = _around(layer, version, extent, texts, batch.column("values")[k].as_py(), held)
                found = [(begin + n, side[a : a + piece]) for begin, side in ((layer_id, sides[0]), (last + (1 << 23), sides[1])) for n, a in enumerate(range(0, len(side), piece))]
                same = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(found))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [*(pa.repeat(c[k], len(found)) for c in address), pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.binary()), same(layer_id, pa.int64()), same(layer_at, pa.int32()), same(None, pa.int64()),
                     same(0, pa.int32()), same(0, pa.int64()), pa.array([len(r[1]) for r in found], pa.int64()), same(False, pa.bool_())], names=names,
                )

    sizes = bodies.groupBy("layer_id").agg(F.sum("size").alias("held"))
    layers = united.where("name_map IS NULL").join(sizes, "layer_id").select(*keys, "layer", "version", "extent", "names", "values", "draft", "layer_id", "layer_at", "held")
    return bodies.unionByName(durable(layers.mapInArrow(around, out)))


_DRAFT = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_UNITED = "draft long, layer_id long, layer_at int, at long, name_map binary, value_map binary, layer string, version int, extent int, names array<string>, values array<binary>"


def _draft(rows: pa.RecordBatch) -> tuple:
    """Features of one layer but for their tags: (how many, keys, values, bytes before and after the tags, tags and points
    of each, key and value of each tag, bytes before the tags, bytes after them)."""
    if "body" in rows.schema.names:
        numbers, known, gtype, points, (stream, bounds), props = _opened(rows.column("body"))
    else:
        if rows.column("gtype").null_count:
            raise ValueError("a feature has no type")
        gtype, props, fid = rows.column("gtype").to_numpy(zero_copy_only=False), rows.column("props"), rows.column("fid")
        stream, bounds, points = flat_streams(gtype, rows.column("geom"))
        numbers, known = low_bits(fid), fid.is_valid().to_numpy(zero_copy_only=False)
    n = len(gtype)
    ids, id_at = varints(numbers[known])
    id_sizes = np.zeros(n, np.int64)
    id_sizes[known] = np.diff(id_at)
    front, front_at = woven([(np.full(int(known.sum()), 8, np.uint8), ends_of(known)), (ids, ends_of(id_sizes))])
    back, back_at = woven([constant(3 << 3, n), varints(gtype.astype(np.int64).view(np.uint64)), constant(4 << 3 | 2, n), varints(np.diff(bounds).view(np.uint64)), (stream, bounds)])
    props = props.dictionary_encode()
    names: dict[str, int] = {}
    values: dict[bytes, int] = {}
    pairs, held = [], []
    for each in props.dictionary.to_pylist():
        entries = _from_text(each) if isinstance(each, str) else _from_bytes(each)
        held.append(len(entries))
        pairs += [(names.setdefault(k, len(names)), values.setdefault(v, len(values))) for k, v in entries]
    # the last stands for no properties
    held, own = np.array([*held, 0], np.int64), props.indices.fill_null(len(held)).to_numpy(zero_copy_only=False)
    sizes = np.stack([np.diff(front_at), np.diff(back_at), held[own], points], axis=1).astype(np.int32)
    pairs = np.array(pairs, np.int32).reshape(-1, 2)[ragged(ends_of(held)[own], held[own])]
    return n, list(names), list(values), sizes.tobytes(), pairs.tobytes(), front.tobytes(), back.tobytes()


def _from_text(props: str) -> list[tuple[str, bytes]]:
    """Keys and encoded values of properties as JSON, in which numbers that aren't finite are texts."""
    out = []
    for e in json.loads(props):
        if not e.get("value"):
            raise ValueError(f"property {e['key']} has no value")
        text, number, flag = (e["value"].get(c) for c in ("text", "number", "flag"))
        out.append((e["key"], _encoded((text, None if number is None else float(number), flag))))
    return out


def _from_bytes(props: bytes) -> list[tuple[str, bytes]]:
    """Keys and encoded values of properties as entry after entry, each part with its length."""
    r, parts = _Reader(props), []
    while r.at < len(props):
        size = r.varint()
        parts.append(props[r.at : r.at + size])
        r.at += size
    return [(k.decode(), v) for k, v in zip(parts[::2], parts[1::2], strict=True)]


def _unite(keys: list[str]):
    """Drafts of payloads, one after another: each with the numbers that its keys and values have in its layer, and each
    layer with all of them. A layer begins where the name changes, with that draft's version and extent."""

    def run(batches):
        key = layer = None
        own: tuple = ()
        last = first = layer_at = at = 0
        names: dict = {}
        values: dict = {}
        out: list[tuple] = []
        types: list = []

        def made() -> pa.RecordBatch:
            kinds = [*types, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[*keys, *(c.split()[0] for c in _UNITED.split(", "))])

        def closed() -> tuple:
            return (*key, last, first, layer_at, None, None, None, *own, list(names), list(values))

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            addresses = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for address, *head, draft, count, texts, encoded in zip(addresses, *(batch.column(c).to_pylist() for c in ("layer", "version", "extent", "draft", "count", "names", "values")), strict=True):
                if address != key or head[0] != layer:
                    if key is not None:
                        out.append(closed())
                    layer_at = 0 if address != key else layer_at + 1
                    key, layer, own, first, at, names, values = address, head[0], tuple(head), draft, 0, {}, {}
                last = draft
                numbers = [np.array([have.setdefault(v, len(have)) for v in new], np.int32).tobytes() for have, new in ((names, texts), (values, encoded))]
                out.append((*key, draft, first, layer_at, at, *numbers, None, None, None, None, None))
                at += count
            if out:
                yield made()
                out = []
        if key is not None:
            out.append(closed())
            yield made()

    return run


def _finished(sizes: bytes, pairs: bytes, front: bytes, back: bytes, name_map: bytes, value_map: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a draft's features, where each begins, and the points of each."""
    table, pair = np.frombuffer(sizes, np.int32).reshape(-1, 4).astype(np.int64), np.frombuffer(pairs, np.int32).reshape(-1, 2)
    known = [np.frombuffer(m, np.int32) for m in (name_map, value_map)]
    numbers = np.stack([m[pair[:, k]] for k, m in enumerate(known)], axis=1).astype(np.uint64).ravel()
    tags, tag_at = varints(numbers)
    tag_at = tag_at[2 * ends_of(table[:, 2])]
    tag_size = varints(np.diff(tag_at).view(np.uint64))
    n, wide = len(table), np.diff(tag_size[1])
    size = varints((table[:, 0] + 1 + wide + np.diff(tag_at) + table[:, 1]).view(np.uint64))
    data, starts = woven([constant(2 << 3 | 2, n), size, (np.frombuffer(front, np.uint8), ends_of(table[:, 0])), constant(2 << 3 | 2, n), tag_size, (tags, tag_at), (np.frombuffer(back, np.uint8), ends_of(table[:, 1]))])
    return data, starts, table[:, 3]


def _rows_within(data: np.ndarray, starts: np.ndarray, points: np.ndarray, piece: int) -> Iterator[tuple]:
    """(bytes, number of the first feature, features, points, cut) of features in pieces; one that is larger is cut."""
    a, n = 0, len(points)
    while a < n:
        b = int(np.searchsorted(starts, starts[a] + piece, "right")) - 1
        if b > a:
            yield data[starts[a] : starts[b]].tobytes(), a, b - a, int(points[a:b].sum()), False
        else:
            b, whole = a + 1, data[starts[a] : starts[a + 1]].tobytes()
            for k in range(0, len(whole), piece):
                yield whole[k : k + piece], a, int(k == 0), int(points[a]) * (k == 0), True
        a = b


def _entries(props: pa.Array) -> list[list[tuple]]:
    """The entries (key, value) of each row's properties."""
    flat = props.flatten()
    value = flat.field("value")
    pairs = list(zip(flat.field("key").to_pylist(), zip(*(value.field(c).to_pylist() for c in ("text", "number", "flag")), strict=True), strict=True))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(props), 0).to_numpy(zero_copy_only=False)).tolist()
    return [pairs[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_payloads(payloads: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, scale: int = 64, limits: dict[str, int] | None = None, piece: int | None = None) -> DataFrame:
    """(z, x, y, tile; with piece in pieces) of payloads (z, x, y, payload, tile), merged in order of payload: a feature of each key, the first
    with its id, properties and, but for lines, its geometry; lines with the parts of all.

    Layers that aren't included, or are excluded, go, as do features beyond the extent times scale. Tiles of which
    nothing is left are no rows. What comes out is checked as what goes in. Layers of one tile that differ in extent fail.
    """
    tile = ["z", "x", "y", "layer"]
    kept = lambda rows: rows.where(F.lit(include is None) | F.col("layer").isin(include or [])).where(~F.col("layer").isin(exclude or []))
    packed = odd = None
    if piece and indexed(payloads):
        payloads = payloads.withColumn("payload", F.col("payload").cast("int"))
        frames, odd = _frames(payloads, ["z", "x", "y", "payload"], limits)
        if odd is None:
            features = kept(frames)
            slots = features.groupBy(*tile).agg(F.min("layer_id").alias("slot"))
            packed = _packed_pieces(payloads, frames.join(slots, tile, "left"), limits, scale)
    if packed is None:
        features = durable(kept(decode_payloads(payloads, limits)))
    # the layer is the first payload's: its version and its place; numbers alone are reduced before they move
    layers = features.groupBy(*tile, "payload", "layer_at", "version").agg(F.min("extent").alias("least"), F.max("extent").alias("most"))
    layers = layers.groupBy(*tile).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.struct("payload", "layer_at", "version")).alias("head"))
    differ = F.concat(F.lit("layer "), "layer", F.lit(" of tile "), F.concat_ws("/", "z", "x", "y"), F.lit(" has extents "), F.col("least").cast("string"), F.lit(" and "), F.col("most").cast("string"))
    layers = durable(layers.select(*tile, F.when(F.col("least") < F.col("most"), F.raise_error(differ).cast("int")).otherwise(F.col("least")).alias("layer_extent"), F.struct(F.col("head.payload").alias("p"), F.col("head.layer_at").alias("a")).alias("layer_place"), F.col("head.version").alias("layer_version")))
    named = {"layer_version": "version", "layer_extent": "extent", "layer_place": "layer_at"}
    if packed is not None:
        placed = durable(_merged_pieces(packed, partitions(payloads.sparkSession, payloads)).join(durable(layers.join(slots, tile)), "slot").drop("slot").withColumnsRenamed(named))
        return checked(encode_payloads(placed, ["payload", "at"], piece=piece), limits)
    far = lambda c: F.exists(F.flatten("geom"), lambda p: F.abs(p[c]) > F.col("extent") * scale)
    # features are dealt by their own key, as a tile may hold very many
    sane = with_shape(features.where(~far("x") & ~far("y"))).repartition(partitions(features.sparkSession, features), *tile, *SHAPE)
    merged = merge(sane, [*tile, *SHAPE], ["payload", "at"])
    placed = merged.join(layers, tile).drop("version", "extent", "layer_at").withColumnsRenamed(named)
    return checked(encode_payloads(durable(placed), ["payload", "at"], piece=piece) if piece else encode_payloads(placed, ["payload", "at"]), limits)


# A feature as it moves while payloads in pieces are merged. key: what it is known by, its type and its id or, of a polygon
# or without an id, its parts, points, and properties in order of key. body: _HEAD, properties, geometry.
_PACKED = "slot long, payload int, at long, key binary, body binary"
_HEAD = np.dtype([("id", "<u8"), ("points", "<i4"), ("props", "<i4"), ("known", "u1"), ("gtype", "u1")])


def _packed_pieces(pieces: DataFrame, frames: DataFrame, limits: dict[str, int] | None, scale: int) -> DataFrame:
    """Features of payloads in indexed pieces as rows of few columns, as each costs time on its way to Python and back.
    slot stands for tile and layer; layers without one are read and checked, and go, as do features that are far out."""
    keys, most = ["z", "x", "y", "payload"], LIMITS | (limits or {})

    def run(batches):
        for batch in batches:
            for row, layer, first, data, index in _body_rows(batch):
                *address, payload, slot = (batch.column(c)[row].as_py() for c in [*keys, "slot"])
                try:
                    found, plain = _read_body(layer, first, data, index, most)
                except Broken as e:
                    raise ValueError(f"payload {payload} of tile {'/'.join(map(str, address))}: {e}") from e
                if slot is None:
                    continue
                if found:
                    ids, known, gtype, counts, key, value, shapes = found
                    counts, key, value = _with_value(layer, counts, key, value)
                    names, values, geom = layer["keys"], [b"" if v is None else _encoded(tuple(normal(v).values())) for v in layer["values"]], _drawn(shapes)
                else:
                    own_names: dict[str, int] = {}
                    own_values: dict[bytes, int] = {}
                    pairs = [(own_names.setdefault(k, len(own_names)), own_values.setdefault(_encoded(tuple(v.values())), len(own_values))) for f in plain for k, v in f[3].items()]
                    key, value = np.array(pairs, np.int64).reshape(-1, 2).T
                    ids, known = np.array([f[1] or 0 for f in plain], np.uint64), np.array([f[1] is not None for f in plain])
                    gtype, counts = np.array([f[2] for f in plain], np.int64), np.array([len(f[3]) for f in plain], np.int64)
                    names, values, geom = list(own_names), list(own_values), nested([f[4] for f in plain])
                known_by, body, far = _packed_rows(names, values, ids, known, gtype, counts, key, value, geom, layer["extent"] * scale)
                n = len(ids)
                out = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(slot, pa.int64()), n), pa.repeat(pa.scalar(payload, pa.int32()), n), pa.array(np.arange(first, first + n)), known_by, body], names=["slot", "payload", "at", "key", "body"])
                yield out.filter(pa.array(~far)) if far.any() else out

    return _bodies(pieces, frames, keys, "slot").mapInArrow(run, _PACKED)


def _packed_rows(names: list[str], values: list[bytes], ids: np.ndarray, known: np.ndarray, gtype: np.ndarray, counts: np.ndarray, key: np.ndarray, value: np.ndarray, geom: pa.ListArray, reach: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """key and body of features that have at least one point each, and which have one beyond reach."""
    stream, bounds, points = flat_streams(gtype, geom)
    tables = []
    for own in ([k.encode() for k in names], values):
        parts = [_varint(len(v)) + v for v in own]
        tables.append((np.frombuffer(b"".join(parts), np.uint8), ends_of(np.array([len(v) for v in parts], np.int64))))

    def entries(*picked):
        rows = [(at[:-1][k], np.diff(at)[k]) for (_, at), k in zip(tables, picked, strict=True)]
        return woven([(data[ragged(*row)], ends_of(row[1])) for (data, _), row in zip(tables, rows, strict=True)])

    raw = lambda v: np.ascontiguousarray(v).view(np.uint8).ravel()
    tags, tag_at = entries(key, value)
    tag_at = tag_at[ends_of(counts)]
    head = np.zeros(len(ids), _HEAD)
    head["id"], head["points"], head["props"], head["known"], head["gtype"] = ids, points, np.diff(tag_at), known, gtype
    body = woven([(raw(head), _HEAD.itemsize * np.arange(len(ids) + 1)), (tags, tag_at), (stream, bounds)])
    own = (gtype == 3) | ~known
    owner = np.repeat(np.arange(len(gtype)), counts)
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    of_own = own[owner]
    order = np.lexsort((rank[key[of_own]], owner[of_own]))
    sorted_tags, sorted_at = entries(key[of_own][order], value[of_own][order])
    parts, lengths = (pc.list_value_length(g).to_numpy().astype(np.int64) for g in (geom, geom.flatten()))
    size, mine = np.diff(bounds), lambda sizes: ends_of(np.where(own, sizes, 0))
    tag_sizes = np.zeros(len(own), np.int64)
    tag_sizes[own] = np.diff(sorted_at[ends_of(counts[own])])
    known_by = woven([(gtype.astype(np.uint8), np.arange(len(own) + 1)), (raw(ids[~own]), ends_of(np.where(own, 0, 8))), (raw(np.stack([parts[own], size[own]], axis=1).astype(np.int32)), mine(8)),
                      (raw(lengths[ragged(ends_of(parts)[:-1][own], parts[own])].astype(np.int32)), mine(4 * parts)), (stream[ragged(bounds[:-1][own], size[own])], mine(size)), (sorted_tags, ends_of(tag_sizes))])
    flat = geom.flatten().flatten()
    far = np.maximum(*(np.abs(flat.field(c).to_numpy()) for c in "xy"))
    held = np.diff(ends_of(lengths)[ends_of(parts)])
    return as_binary(*known_by), as_binary(*body), np.maximum.reduceat(far, ends_of(held)[:-1]) > reach


def _opened(bodies: pa.Array) -> tuple:
    """(ids, whether each has one, types, points, geometries, properties) of bodies."""
    data, at = as_bytes(bodies)
    head = data[at[:-1, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
    props, start = head["props"].astype(np.int64), at[:-1] + _HEAD.itemsize
    size = at[1:] - start - props
    return head["id"], head["known"] > 0, head["gtype"].astype(np.int64), head["points"].astype(np.int64), (data[ragged(start + props, size)], ends_of(size)), as_binary(data[ragged(start, props)], ends_of(props))


def _geometry_at(body: bytes) -> int:
    return _HEAD.itemsize + int.from_bytes(body[12:16], "little")


def _merged_pieces(features: DataFrame, parts: int) -> DataFrame:
    """(slot, payload, at, body) of _packed_pieces(), one for each key, as operators.features.merge() has it: the first by
    payload and place; lines with the parts of all. Features are dealt by a hash of their key and sorted by key and order;
    a task holds one key's lines."""
    dealt = features.withColumn("hash", F.xxhash64("slot", "key")).repartition(parts, "hash").sortWithinPartitions("hash", "slot", "key", "payload", "at")
    names = ["slot", "payload", "at", "body"]

    def reduced(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        begin, end, body = starts.tolist(), [*starts[1:].tolist(), rows.num_rows], rows.column("body").to_pylist()
        out = rows.select(names).take(pa.array(starts))
        more = [k for k, (a, b) in enumerate(zip(begin, end, strict=True)) if b - a > 1 and body[a][_HEAD.itemsize - 1] == 2]
        if more:
            first = [body[a] for a in begin]
            for k in more:
                # a geometry that comes once more adds nothing
                streams = list(dict.fromkeys([b[_geometry_at(b) :] for b in body[begin[k] : end[k]]]))
                if len(streams) > 1:
                    united, own = _united([_parts(_packed(v)) for v in streams]), first[k]
                    first[k] = own[:8] + sum(map(len, united)).to_bytes(4, "little") + own[12 : _geometry_at(own)] + _geometry(2, united)
            out = out.set_column(3, "body", pa.array(first, pa.binary()))
        return out

    def first(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            starts = run_starts(batch, ["hash", "slot", "key"])
            held, last = batch.slice(starts[-1]), int(starts[-1])
            if last:
                yield reduced(batch.slice(0, last), starts[:-1])
            if held.num_rows > 1:
                bodies = held.column("body").to_pylist()
                line = bodies[0][_HEAD.itemsize - 1] == 2
                kept: dict[bytes, int] = {}
                for k, b in enumerate(bodies if line else bodies[:1]):
                    kept.setdefault(b[_geometry_at(b) :], k)
                held = held.take(pa.array(list(kept.values())))
        if held is not None:
            yield reduced(held, np.zeros(1, np.int64))

    return dealt.mapInArrow(first, "slot long, payload int, at long, body binary")


def _united(lines: list[list[list[tuple]]]) -> list[list[tuple]]:
    """operators.features.union_parts(): the parts of the first line as they are, and further ones; one within an earlier
    is skipped, ones within it go."""

    def within(piece: list[tuple], part: list[tuple]) -> bool:
        n, back = len(piece), piece[::-1]
        return any(part[k : k + n] in (piece, back) for k in range(len(part) - n + 1))

    have, *further = lines
    for new in (part for line in further for part in line):
        if not any(within(new, part) for part in have):
            have = [*(part for part in have if not within(part, new)), new]
    return have


def checked(tiles: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """tiles (z, x, y, tile), all within the limits, or an error. Those in pieces are a stored table, which is read once to
    check them, side by side; a tile that breaks a limit is then read as a whole, to say where."""
    keys = ["z", "x", "y"]

    def check(address: tuple, tile: bytes) -> None:
        try:
            for _ in read_payload(tile, limits):
                pass
        except Broken as e:
            raise ValueError(f"merged tile {'/'.join(map(str, address))}: {e}") from e

    def each(batches):
        for batch in batches:
            for address, tile in whole([batch], keys):
                check(address, tile)
            yield batch

    def alone(batches):
        for address, tile in whole(batches, keys):
            check(address, tile)
            yield pa.RecordBatch.from_arrays([pa.array([address[0]], pa.int32())], names=["z"])

    if indexed(tiles):
        beyond = durable(payload_totals(tiles, limits, keys).where("broken IS NOT NULL").select(*keys))
        if not beyond.isEmpty():
            in_order(_of(tiles, beyond, keys), keys).mapInArrow(alone, "z int").write.format("noop").mode("overwrite").save()
        return tiles
    return tiles.select(*keys, "tile").mapInArrow(each, "z int, x int, y int, tile binary")


def payload_totals(payloads: DataFrame, limits: dict[str, int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, bytes, layers, features, points, broken) of each payload: what was counted, and the first limit that it
    breaks or null. Counting ends at the breach. Pieces with their INDEX are counted side by side; payloads that break a
    limit are read once more, from their first byte to the breach."""
    keys = keys or ["z", "x", "y"]
    if not indexed(payloads):
        return _counted(payloads, keys, limits)
    frames, odd = _frames(payloads, keys, limits)
    sound, frames = (payloads, frames) if odd is None else (_of(payloads, odd, keys, "left_anti"), _of(frames, odd, keys, "left_anti"))
    most, kinds = LIMITS | (limits or {}), dict(payloads.dtypes)

    def run(batches):
        for batch in batches:
            out = []
            for _, layer, first, data, index in _body_rows(batch):
                try:
                    _read_body(layer, first, data, index, most)
                    out.append((0, 0, *index[:2], False))
                except Broken:
                    out.append((0, 0, 0, 0, True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array([r[k] for r in out], pa.int64()) for k in range(4)), pa.array([r[4] for r in out], pa.bool_())], names=[*keys, "bytes", "layers", "features", "points", "odd"])

    counted = _bodies(sound, frames, keys).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", bytes long, layers long, features long, points long, odd boolean")
    around = frames.select(*keys, (F.col("size") + F.octet_length("frame")).cast("long").alias("bytes"), F.lit(1).cast("long").alias("layers"), F.lit(0).cast("long").alias("features"), F.lit(0).cast("long").alias("points"), F.lit(False).alias("odd"))
    totals = durable(counted.unionByName(around).groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in ("bytes", "layers", "features", "points")), F.bool_or("odd").alias("odd")))
    out = totals.where("NOT odd").select(*keys, "bytes", "layers", "features", "points", F.lit(None).cast("string").alias("broken"))
    found = totals.where("odd").select(*keys)
    again = found if odd is None else found.unionByName(odd)
    return out if odd is None and found.isEmpty() else out.unionByName(_counted(_of(payloads, again, keys), keys, limits))


def _counted(payloads: DataFrame, keys: list[str], limits: dict[str, int] | None) -> DataFrame:
    names = [*keys, "bytes", "layers", "features", "points", "broken"]

    def run(batches):
        types: list[pa.DataType] = []

        def typed():
            for batch in batches:
                types[:] = [batch.schema.field(k).type for k in keys]
                yield batch

        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [*types, *[pa.int64()] * 4, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

        for key, tile in whole(typed(), keys):
            totals: dict[str, int] = {}
            broken = None
            try:
                for _ in read_payload(tile, limits, totals):
                    pass
            except Broken as e:
                broken = e.kind
            out.append((*key, *(totals[c] for c in names[-5:-1]), broken))
            if len(out) == 1000:
                yield made()
                out.clear()
        if out:
            yield made()

    kinds = dict(payloads.dtypes)
    return in_order(payloads, keys).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {TOTALS}")
