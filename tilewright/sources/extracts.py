"""Map extracts in the public PBF format of OpenStreetMap as a Spark data source, and features put together from them.

A file is a chain of blobs of some thousand elements. Tasks take ranges of bytes: each looks for the first blob that
begins in its range, by the marker that every header has, and reads blobs until its range ends, so that no one walks the
whole chain first. Ids and coordinates are running differences and are summed as arrays.

Ways get their points by an equi-join of references with nodes, and rings of multipolygons are put together from ways by
matching ends, relation by relation.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilewright.plans.storage import durable, partitions
from tilewright.sources.mvt import _field, _Reader, _varint
from tilewright.sources.ranged import MAX_RANGE, Archive, RangeReader, _running

#: fixed values of the format: what a header of data begins with, the most bytes of a header and of a blob
MARK, MOST_HEADER, MOST_BLOB = b"\x0a\x07OSMData", 64 << 10, 32 << 20
PART_BYTES, ELEMENTS = 64 << 20, 8000
#: Tasks that read an extract at most; each takes neighbouring ranges where there are more.
MOST_TASKS = 512
SCHEMA = "path string, kind string, id long, tags map<string,string>, lon double, lat double, refs array<long>, members array<struct<kind:string,ref:long,role:string>>"
KINDS = ("node", "way", "relation")


def packed(data: bytes, signed: bool = True) -> np.ndarray:
    """The numbers of a packed field; signed ones are zigzag."""
    raw = np.frombuffer(data, dtype=np.uint8)
    last = raw < 128
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    parts = (raw & np.uint8(127)).astype(np.uint64) << (7 * place).astype(np.uint64)
    out = np.bitwise_or.reduceat(parts, starts)
    return ((out >> np.uint64(1)).astype(np.int64) ^ -(out & np.uint64(1)).astype(np.int64)) if signed else out.astype(np.int64)


def _pack(numbers, signed: bool = True) -> bytes:
    v = np.array(numbers, dtype=np.int64)
    v = (v << 1 ^ v >> 63).view(np.uint64) if signed else v.view(np.uint64)
    if not len(v):
        return b""
    places = np.arange(10, dtype=np.uint64)
    size = np.maximum(1, np.count_nonzero(v[:, None] >> (places * np.uint64(7)), axis=1))
    out = (v[:, None] >> (places * np.uint64(7)) & np.uint64(127)).astype(np.uint8)
    out |= np.where(places + np.uint64(1) < size[:, None].astype(np.uint64), np.uint8(128), np.uint8(0))
    return out[places < size[:, None].astype(np.uint64)].tobytes()


class _Dense(tuple):
    """(ids, tags, lons, lats) of the dense nodes of a group, as arrays but for the tags."""


def read_block(data: bytes, kinds: Sequence[str] = KINDS) -> Iterator[tuple]:
    """(kind, id, tags, lon, lat, refs, members) of the elements of a block that are of these kinds."""
    for e in _elements(data, kinds):
        if isinstance(e, _Dense):
            for i, tags, lon, lat in zip(e[0].tolist(), e[1], e[2].tolist(), e[3].tolist(), strict=True):
                yield "node", i, tags, lon, lat, None, None
        else:
            yield e


def _elements(data: bytes, wanted: Sequence[str]) -> Iterator[tuple]:
    """The elements of a block, a group of dense nodes as one; what isn't of these kinds isn't decoded."""
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, v in _Reader(data).fields():
        if k == 1:
            strings = [s.decode() for n, s in _Reader(v).fields() if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif k == 20:
            lon0 = v - (1 << 64) if v >> 63 else v
    place = lambda origin, n: (origin + grain * n) / 1e9
    sign = lambda v: v >> 1 ^ -(v & 1)
    tagged = lambda f: {strings[a]: strings[b] for a, b in zip(packed(f.get(2, b""), False).tolist(), packed(f.get(3, b""), False).tolist(), strict=True)}
    for group in groups:
        for kind, body in _Reader(group).fields():
            if kind not in (1, 2, 3, 4) or KINDS[max(0, kind - 2)] not in wanted:
                continue
            f = dict(_Reader(body).fields())
            if kind == 1:
                yield "node", sign(f[1]), tagged(f), place(lon0, sign(f[9])), place(lat0, sign(f[8])), None, None
            elif kind == 2:
                ids, lats, lons = (np.cumsum(packed(f.get(n, b""))) for n in (1, 8, 9))
                if not len(ids) == len(lats) == len(lons):
                    raise ValueError("dense nodes lack places")
                pairs, at, every = packed(f.get(10, b""), False).tolist(), 0, []
                for _ in range(len(ids)):
                    tags = {}
                    while at < len(pairs) and pairs[at]:
                        tags[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    every.append(tags)
                yield _Dense((ids, every, place(lon0, lons), place(lat0, lats)))
            elif kind == 3:
                yield "way", f[1], tagged(f), None, None, np.cumsum(packed(f.get(8, b""))).tolist(), None
            elif kind == 4:
                ids = np.cumsum(packed(f.get(9, b""))).tolist()
                roles, kinds = packed(f.get(8, b""), False).tolist(), packed(f.get(10, b""), False).tolist()
                yield "relation", f[1], tagged(f), None, None, None, [{"kind": KINDS[t], "ref": i, "role": strings[r]} for t, i, r in zip(kinds, ids, roles, strict=True)]


def write_block(elements: list[dict]) -> bytes:
    """A block of elements {kind, id, tags, lon, lat, refs, members}; nodes are dense."""
    nodes = [e for e in elements if e["kind"] == "node"]
    return _block([e["id"] for e in nodes], [e["tags"] for e in nodes], [e["lon"] for e in nodes], [e["lat"] for e in nodes], elements)


def _block(ids, tags: list[dict], lons, lats, elements: list[dict]) -> bytes:
    """A block of nodes by column, and of the ways and relations among elements."""
    strings = {"": 0}
    number = lambda s: strings.setdefault(s, len(strings))
    delta = lambda v: np.diff(np.asarray(v, dtype=np.int64), prepend=0)
    groups = []
    if len(ids):
        pairs = [x for own in tags for x in (*(number(s) for kv in own.items() for s in kv), 0)]
        at = lambda v: delta(np.rint(np.asarray(v, dtype=np.float64) * 1e7).astype(np.int64))
        groups.append(_field(2, _field(1, _pack(delta(ids))) + _field(8, _pack(at(lats))) + _field(9, _pack(at(lons))) + _field(10, _pack(pairs, False))))
    for kind, code in (("way", 3), ("relation", 4)):
        out = b""
        for e in (e for e in elements if e["kind"] == kind):
            body = _varint(1 << 3) + _varint(e["id"]) + _field(2, _pack([number(k) for k in e["tags"]], False)) + _field(3, _pack([number(v) for v in e["tags"].values()], False))
            if kind == "way":
                body += _field(8, _pack(delta(e["refs"] or [])))
            else:
                m = e["members"] or []
                body += _field(8, _pack([number(x["role"]) for x in m], False)) + _field(9, _pack(delta([x["ref"] for x in m]))) + _field(10, _pack([KINDS.index(x["kind"]) for x in m], False))
            out += _field(code, body)
        groups += [out] if out else []
    return _field(1, b"".join(_field(1, s.encode()) for s in strings)) + b"".join(_field(2, g) for g in groups)


def blob(kind: str, data: bytes) -> bytes:
    """A blob of this kind with its header."""
    body = _varint(2 << 3) + _varint(len(data)) + _field(3, zlib.compress(data))
    head = _field(1, kind.encode()) + _varint(3 << 3) + _varint(len(body))
    return struct.pack(">I", len(head)) + head + body


def _header(reader: RangeReader, at: int, size: int) -> tuple[str, int, int] | None:
    """(kind, first byte, bytes) of the blob whose header is at a place; None if there is no header."""
    if at + 4 > size:
        return None
    n = struct.unpack(">I", reader.read(at, 4))[0]
    if n > MOST_HEADER or at + 4 + n > size:
        return None
    try:
        f = dict(_Reader(reader.read(at + 4, n)).fields())
        kind, length = f[1].decode(), f[3]
    except (ValueError, KeyError, AttributeError, UnicodeDecodeError):
        return None
    return (kind, at + 4 + n, length) if length <= MOST_BLOB and at + 4 + n + length <= size else None


def first_blob(reader: RangeReader, start: int, end: int, size: int) -> int | None:
    """Where the first header of data stands that begins in start to end (not included)."""
    at, step = start, 1 << 20
    while at < end:
        window = reader.read(at, min(step + len(MARK) + 4, size - at))
        found = window.find(MARK)
        while found >= 0:
            head = at + found - 4
            if start <= head < end and found >= 4 and _header(reader, head, size):
                return head
            found = window.find(MARK, found + 1)
        at += step
    return None


def blobs_in(reader: RangeReader, start: int, end: int, size: int) -> Iterator[bytes]:
    """The blocks of data whose headers begin in start to end; what breaks the chain is an error."""
    at = first_blob(reader, start, end, size)
    while at is not None and at < end:
        head = _header(reader, at, size)
        if head is None:
            raise ValueError(f"{reader.path}: no blob at {at}")
        kind, first, length = head
        if kind == "OSMData":
            pieces = [reader.read(first + k, min(MAX_RANGE, length - k)) for k in range(0, length, MAX_RANGE)]
            f = dict(_Reader(b"".join(pieces)).fields())
            data = f[1] if 1 in f else zlib.decompress(f[3])
            if 2 in f and len(data) != f[2]:
                raise ValueError(f"{reader.path}: a blob at {at} has {len(data)} bytes instead of {f[2]}")
            yield data
        at = first + length
        if at >= size:
            return


class _Bytes(InputPartition):
    """Neighbouring ranges (start, end) of a file."""

    def __init__(self, path: str, ranges: list[tuple[int, int]], size: int):
        super().__init__(None)
        self.path, self.ranges, self.size = path, ranges, size


class ExtractReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.part = json.loads(options["paths"]), int(options.get("part_bytes", PART_BYTES))
        self.kinds = json.loads(options.get("kinds", json.dumps(KINDS)))

    def partitions(self) -> Sequence[InputPartition]:
        sizes = {path: os.path.getsize(path) for path in self.paths}
        each = max(1, -(-sum(-(-size // self.part) for size in sizes.values()) // MOST_TASKS))
        out = []
        for path, size in sizes.items():
            ranges = [(a, min(size, a + self.part)) for a in range(0, size, self.part)]
            out += [_Bytes(path, ranges[k : k + each], size) for k in range(0, len(ranges), each)]
        return out or [_Bytes("", [], 0)]

    def read(self, partition: _Bytes) -> Iterator[pa.RecordBatch]:
        member = pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
        kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(member)]
        names = ["path", "kind", "id", "tags", "lon", "lat", "refs", "members"]

        def batch(columns: list) -> pa.RecordBatch:
            columns[2] = [list(t.items()) for t in columns[2]]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(made[0]), pa.string()), *made], names=names)

        reader = RangeReader(partition.path)
        for start, end in partition.ranges:
            for data in blobs_in(reader, start, end, partition.size):
                rows = []
                for e in _elements(data, self.kinds):
                    if isinstance(e, _Dense):
                        n = len(e[0])
                        yield batch([["node"] * n, e[0], e[1], e[2], e[3], [None] * n, [None] * n])
                    else:
                        rows.append(e)
                if rows:
                    yield batch([[r[k] for r in rows] for k in range(7)])


class Extract(DataSource):
    """spark.read.format("tilewright_extract"): elements of the extracts in option paths (JSON), files of a shared folder."""

    @classmethod
    def name(cls) -> str:
        return "tilewright_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ExtractReader(self.options)


def read_extract(spark: SparkSession, paths: list[str], part_bytes: int = PART_BYTES, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(path, kind, id, tags, lon, lat, refs, members) of the elements of extracts that are of these kinds."""
    spark.dataSource.register(Extract)
    return spark.read.format("tilewright_extract").option("paths", json.dumps(paths)).option("part_bytes", str(part_bytes)).option("kinds", json.dumps(list(kinds))).load()


def write_extract(elements: DataFrame, path: str, per_block: int = ELEMENTS) -> int:
    """Writes elements (kind, id, tags, lon, lat, refs, members) as an extract, nodes first, then ways and relations, each
    by id; its bytes are returned. Tasks make blocks, whose places are running sums, and write them side by side."""
    spark = elements.sparkSession
    spark.dataSource.register(Archive)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))

    def blocks(batches):
        held: list[pa.RecordBatch] = []

        def made():
            own = pa.Table.from_batches(held)
            place, kind = (own.column(c)[0].as_py() for c in ("id", "rank"))
            if kind == 1:
                data = _block(own.column("id").to_numpy(), [dict(t or ()) for t in own.column("tags").to_pylist()], own.column("lon").to_numpy(), own.column("lat").to_numpy(), [])
            else:
                data = write_block([row | {"tags": dict(row["tags"] or ())} for row in own.to_pylist()])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int64()), pa.array([place], pa.int64()), pa.array([blob("OSMData", data)], pa.binary())], names=["rank", "id", "data"])

        count = last = 0
        for batch in batches:
            ranks, at = batch.column("rank").to_numpy(), 0
            while at < len(ranks):
                if held and (count == per_block or last != ranks[at]):
                    yield made()
                    count = 0
                last = ranks[at]
                # rows are sorted by rank
                end = min(at + per_block - count, int(np.searchsorted(ranks, last, side="right")))
                held.append(batch.slice(at, end - at))
                count, at = count + end - at, end
        if held:
            yield made()

    rows = elements.select(rank.alias("rank"), "kind", "id", "tags", "lon", "lat", "refs", "members")
    ordered = rows.repartitionByRange("rank", "id").sortWithinPartitions("rank", "id")
    bodies = durable(ordered.mapInArrow(blocks, "rank long, id long, data binary").withColumn("place", F.struct("rank", "id")).withColumn("size", F.octet_length("data").cast("long")))
    head = blob("OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes"))
    at = _running(bodies.select("place", "size"), "size", "place")
    total = len(head) + (bodies.agg(F.sum("size")).first()[0] or 0)
    body = bodies.join(at.select("place", "before"), "place").select((F.col("before") + len(head)).alias("at"), "data")
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        spark.createDataFrame([(0, bytearray(head))], "at long, data binary").unionByName(body).write.format("tilewright_archive").mode("append").options(path=part, total=str(total), header=head.hex()).save()
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return total


#: Elements as rows, or a function that opens those of one kind, so that the others aren't decoded.
Elements = DataFrame | Callable[[str], DataFrame]


def _of(elements: Elements, kind: str) -> DataFrame:
    return (elements(kind) if callable(elements) else elements).where(F.col("kind") == kind)


def way_lines(elements: Elements, only: DataFrame | None = None) -> DataFrame:
    """(id, tags, points, missing) of ways: their nodes' places in order, and how many of their nodes aren't there. With
    only, rows of ids, just those ways."""
    nodes = _of(elements, "node").select(F.col("id").alias("ref"), F.struct("lon", "lat").alias("point"))
    ways = _of(elements, "way")
    ways = ways if only is None else ways.join(only, "id", "left_semi")
    ways = ways.select("id", "tags", F.posexplode_outer("refs").alias("at", "ref"))
    # a node that very many ways share is met by their references, which AQE splits
    met = ways.join(nodes, "ref", "left").groupBy("id").agg(F.any_value("tags").alias("tags"), F.sort_array(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("at", "point")))).alias("p"), F.count_if(F.col("ref").isNotNull() & F.col("point").isNull()).alias("missing"))
    return met.select("id", "tags", F.transform("p", lambda x: x["point"]).alias("points"), "missing")


def joined_rings(ways: list[list[tuple]]) -> tuple[list[list[tuple]], int]:
    """(closed rings, ways that are left over) of ways, put together where their ends meet, either way round."""
    rings, open_ = [], []
    for w in ways:
        (rings if len(w) > 3 and w[0] == w[-1] else open_).append(list(w))
    left = 0
    while open_:
        ring = open_.pop(0)
        while ring[0] != ring[-1]:
            k = next((k for k, w in enumerate(open_) if ring[-1] in (w[0], w[-1])), None)
            if k is None:
                break
            w = open_.pop(k)
            ring += (w if w[0] == ring[-1] else w[::-1])[1:]
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(ring)
        else:
            left += 1
    return rings, left


def multipolygons(elements: Elements) -> DataFrame:
    """(id, tags, outer, inner, left) of relations of type multipolygon: closed rings of the ways of each role (no role is
    outer), and how many ways close no ring. A relation has the ways that its editor listed; they meet in one row."""
    relations = _of(elements, "relation").where("tags['type'] = 'multipolygon'").select("id", "tags", F.posexplode("members").alias("at", "m")).where("m.kind = 'way'").select("id", "tags", "at", F.col("m.ref").alias("way"), F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"))
    lines = way_lines(elements, relations.select(F.col("way").alias("id"))).select(F.col("id").alias("way"), "points")
    met = durable(relations.join(lines, "way").groupBy("id").agg(F.any_value("tags").alias("tags"), F.sort_array(F.collect_list(F.struct("at", "role", "points"))).alias("ways")))
    point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])

    def run(batches):
        for batch in batches:
            out = {"outer": [], "inner": [], "left": []}
            for ways in batch.column("ways").to_pylist():
                left = 0
                for role in ("outer", "inner"):
                    rings, n = joined_rings([[(p["lon"], p["lat"]) for p in w["points"]] for w in ways if w["role"] == role and w["points"]])
                    out[role].append([[{"lon": a, "lat": b} for a, b in r] for r in rings])
                    left += n
                out["left"].append(left)
            rings_type = pa.list_(pa.list_(point))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tags"), pa.array(out["outer"], rings_type), pa.array(out["inner"], rings_type), pa.array(out["left"], pa.int32())], names=["id", "tags", "outer", "inner", "left"])

    rings = "array<array<struct<lon:double,lat:double>>>"
    dealt = met.repartition(partitions(met.sparkSession, met), "id")
    return dealt.mapInArrow(run, f"id long, tags map<string,string>, outer {rings}, inner {rings}, left int")
