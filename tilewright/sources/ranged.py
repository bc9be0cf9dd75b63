"""Single-file tile archives as a Spark data source: byte ranges in, byte ranges out.

Reading. The planner takes header and root of each archive by range and makes partitions of runs of tile numbers of about
equal bytes; a task walks the directories of its run alone, joins neighbouring tiles to ranges of at most MAX_RANGE
bytes, and reads those. Filters on z, x and y become runs of Hilbert numbers, so a box of a 5 GB archive costs its own
tiles and the directories above them. Ranges come from files of a shared folder, from HTTP(S), or from any file system
that pyarrow opens; failures that may pass are tried again with growing pauses, short answers are errors.

Writing. Places of tiles are known before any byte is written: equal tiles are found by digest, and offsets are sums over
ranges of numbers. Tasks then write at their own places of one file beside the target; the commit checks what was
written against what was planned, a task takes the digest, and archive and sidecar are renamed into place. A failure
removes the file, and readers never see half an archive.
"""

from __future__ import annotations

import bisect
import functools
import gzip
import hashlib
import json
import os
import random
import struct
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tilewright.plans.storage import durable, partitions
from tilewright.sources.pmtiles import HEADER, HEADER_BYTES, ROOT_BYTES, MAGIC, _directory, _entries, tile_addresses, tile_number, tile_numbers

#: Bytes of one range at most, of a partition's tiles about, and of a tile.
MAX_RANGE, PART_BYTES, MAX_TILE = 16 << 20, 64 << 20, 16 << 20
#: Bytes between two tiles that are read along with them at most, as another request costs more.
GAP = 64 << 10
#: Attempts, seconds of one, first and longest pause; failures in a row that open the circuit, and for how long.
ATTEMPTS, TIMEOUT, PAUSE, LONGEST_PAUSE, FAILURES, COOLDOWN = 4, 10.0, 0.12, 1.5, 6, 15.0
#: Runs of numbers that a box is cut into at most, for each zoom; beyond that squares are taken whole and rows filtered.
RUNS = 256
#: Numbers that a partition addresses, about: a tile of few bytes may stand at very many.
PART_TILES = 200_000
#: Entries of a leaf at least, and leaves of an archive at most.
LEAF, LEAVES = 4096, 2000
SCHEMA = "path string, z int, x int, y int, tile binary"


class RangeError(OSError):
    """A range that can't be had; status is an HTTP status or None."""

    def __init__(self, text: str, status: int | None = None):
        super().__init__(text)
        self.status = status


def may_pass(error: BaseException) -> bool:
    """Whether another attempt may help: no status, a few statuses of 4xx, and all from 500."""
    status = error.code if isinstance(error, urllib.error.HTTPError) else getattr(error, "status", None)
    return not isinstance(error, FileNotFoundError) and (status is None or status in (408, 409, 425, 429) or status >= 500)


def _fetch(path: str, offset: int, length: int) -> bytes:
    if path.startswith(("http://", "https://")):
        asked = urllib.request.Request(path, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
        with urllib.request.urlopen(asked, timeout=TIMEOUT) as answer:
            if answer.status != 206:
                raise RangeError(f"{path} doesn't answer ranges", 400)
            return answer.read(length)
    if "://" in path and not path.startswith("file://"):
        from pyarrow.fs import FileSystem

        system, name = FileSystem.from_uri(path)
        with system.open_input_file(name) as f:
            return f.read_at(length, offset)
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        return os.pread(f.fileno(), length, offset)


@dataclass
class RangeReader:
    """Reads ranges of one file and counts what it did."""

    path: str
    fetch: Callable[[str, int, int], bytes] = _fetch
    attempts: int = ATTEMPTS
    pause: float = PAUSE
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], float] = time.monotonic
    requests: int = field(default=0, init=False)
    retries: int = field(default=0, init=False)
    bytes: int = field(default=0, init=False)
    failures: int = field(default=0, init=False)
    open_until: float = field(default=0.0, init=False)

    def read(self, offset: int, length: int) -> bytes:
        """Exactly these bytes, or an error."""
        if offset < 0 or length < 0 or length > MAX_RANGE:
            raise ValueError(f"not a range: {offset}, {length}")
        if not length:
            return b""
        if self.now() < self.open_until:
            raise RangeError(f"{self.path}: failed {self.failures} times in a row, not asked again yet")
        self.requests += 1
        for attempt in range(1, self.attempts + 1):
            try:
                data = self.fetch(self.path, offset, length)
                if len(data) != length:
                    raise RangeError(f"{self.path}: {len(data)} bytes at {offset} instead of {length}")
                self.bytes += length
                self.failures = 0
                return data
            except OSError as e:
                if not may_pass(e) or attempt == self.attempts:
                    self.failures += 1
                    if self.failures >= FAILURES:
                        self.open_until = self.now() + COOLDOWN
                    raise
                self.retries += 1
                self.sleep(min(LONGEST_PAUSE, self.pause * 2 ** (attempt - 1)) * random.uniform(0.75, 1.25))
        raise AssertionError


def header_of(reader: RangeReader) -> dict[str, int]:
    """The header's numbers; ValueError for another kind of file."""
    data = reader.read(0, HEADER_BYTES)
    if data[:7] != MAGIC or data[7] != 3:
        raise ValueError(f"{reader.path} is not an archive of version 3")
    v = struct.unpack(HEADER, data)
    names = ("root", "root_bytes", "metadata", "metadata_bytes", "leaves", "leaves_bytes", "tiles", "tiles_bytes", "addressed", "entries", "contents", "clustered", "internal", "tile_compression", "tile_type", "min_zoom", "max_zoom")
    return dict(zip(names, v[2:19], strict=True))


def metadata_of(reader: RangeReader) -> dict:
    h = header_of(reader)
    return json.loads(gzip.decompress(reader.read(h["metadata"], h["metadata_bytes"])) or b"{}")


def runs_of(z: int, west: int, north: int, east: int, south: int, most: int = RUNS) -> list[tuple[int, int]]:
    """Runs [first, end) of tile numbers that cover columns west to east and rows north to south of a zoom.

    Squares of the quadtree are runs of the curve. The finest square is chosen so that there are no more than most runs
    (but for the four that any corner can have); runs may then hold other tiles of the zoom too.
    """
    side = 1 << z
    west, north, east, south = max(0, west), max(0, north), min(side - 1, east), min(side - 1, south)
    if west > east or north > south:
        return []
    finest = z
    while finest > 0 and 2 * (((east - west) >> (z - finest)) + ((south - north) >> (z - finest)) + 2) > most:
        finest -= 1
    base, out, todo = (4**z - 1) // 3, [], [(0, 0, 0)]
    while todo:
        level, x, y = todo.pop()
        shift = z - level
        x0, y0, x1, y1 = x << shift, y << shift, ((x + 1) << shift) - 1, ((y + 1) << shift) - 1
        if x1 < west or x0 > east or y1 < north or y0 > south:
            continue
        if level == finest or (west <= x0 and x1 <= east and north <= y0 and y1 <= south):
            at = base + ((tile_number(level, x, y) - (4**level - 1) // 3) << 2 * shift)
            out.append((at, at + (1 << 2 * shift)))
        else:
            todo += [(level + 1, 2 * x + a, 2 * y + b) for a in (0, 1) for b in (0, 1)]
    return joined(out)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _meet(wanted: list[tuple[int, int]], first: int, end: int) -> bool:
    k = bisect.bisect_left(wanted, (first, 1 << 63))
    return k > 0 and wanted[k - 1][1] > first or k < len(wanted) and wanted[k][0] < end


def entries_in(reader: RangeReader, header: dict[str, int], wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Entries (number, run, offset, length) of tiles that meet runs wanted, in order; other leaves aren't read."""
    top = _entries(reader.read(header["root"], header["root_bytes"]))
    todo = list(zip(top, [*(e[0] for e in top[1:]), 1 << 62], strict=False))[::-1]
    while todo:
        (number, run, offset, length), end = todo.pop()
        if run:
            if _meet(wanted, number, number + run):
                yield number, run, offset, length
        elif _meet(wanted, number, end):
            below = _entries(reader.read(header["leaves"] + offset, length))
            ends = [e[0] for e in below[1:]] + [end]
            todo += list(zip(below, ends, strict=True))[::-1]


def tiles_in(reader: RangeReader, wanted: list[tuple[int, int]], most: int = MAX_TILE, box: dict[str, list[int]] | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(z, x, y, tile) of the numbers in runs wanted. Neighbouring tiles are read as one range; a tile that several
    numbers share is read once a range. With box, bounds (first, last) of z, x and y, tiles beyond it are left out, and no
    range is read for them."""
    header, held, low, high = header_of(reader), [], 0, 0
    starts, ends = (np.array([r[k] for r in wanted], dtype=np.int64) for k in (0, 1))

    def placed():
        """Entries that hold numbers wanted, with the addresses of those, some thousand entries at a time."""
        some: list[tuple] = []

        def found():
            runs = np.array([e[:2] for e in some], dtype=np.int64).reshape(-1, 2)
            entry = np.repeat(np.arange(len(some)), runs[:, 1])
            numbers = np.arange(len(entry)) - np.repeat(np.cumsum(runs[:, 1]) - runs[:, 1], runs[:, 1]) + runs[entry, 0]
            at = np.searchsorted(starts, numbers, side="right") - 1
            keep = (at >= 0) & (numbers < ends[at])
            entry, numbers = entry[keep], numbers[keep]
            address = tile_addresses(numbers)
            if box:
                inside = np.logical_and.reduce([(v >= box[c][0]) & (v <= box[c][1]) for c, v in zip("zxy", address, strict=True)])
                entry, address = entry[inside], [v[inside] for v in address]
            firsts = np.flatnonzero(np.diff(entry, prepend=-1)).tolist()
            z, x, y = (v.tolist() for v in address)
            for a, b in zip(firsts, [*firsts[1:], len(z)], strict=False):
                yield some[entry[a]], z[a:b], x[a:b], y[a:b]
            some.clear()

        count = 0
        # a run is cut where it is very long
        for number, run, offset, length in entries_in(reader, header, wanted):
            if length > most:
                raise ValueError(f"{reader.path}: a tile of {length} bytes is beyond {most}")
            if offset + length > header["tiles_bytes"]:
                raise ValueError(f"{reader.path}: an entry points beyond the tiles")
            for k in range(number, number + run, 1 << 16):
                some.append((k, min(1 << 16, number + run - k), offset, length))
                count += some[-1][1]
                if count >= 1 << 16:
                    yield from found()
                    count = 0
        yield from found()

    def flush():
        if held:
            data = reader.read(header["tiles"] + low, high - low)
            for (_, _, offset, length), z, x, y in held:
                tile = data[offset - low : offset - low + length]
                yield from zip(z, x, y, [tile] * len(z), strict=True)
            held.clear()

    for e in placed():
        offset, end = e[0][2], e[0][2] + e[0][3]
        apart = held and (offset > high + GAP or offset + GAP < low or max(high, end) - min(low, offset) > MAX_RANGE)
        if apart or len(held) >= 1 << 16:
            yield from flush()
        low, high = (min(low, offset), max(high, end)) if held else (offset, end)
        held.append(e)
    yield from flush()


@dataclass
class _Run(InputPartition):
    path: str
    runs: list[tuple[int, int]]

    def __init__(self, path: str, runs: list[tuple[int, int]]):
        super().__init__(None)
        self.path, self.runs = path, runs


class ArchiveReader(DataSourceReader):
    """Partitions of archives by runs of numbers; bounds of z, x and y come from options."""

    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else options["path"].split(",")
        self.bounds = {c: [int(options.get(f"min_{c}", 0)), int(options.get(f"max_{c}", (1 << 31) - 1))] for c in "zxy"}
        self.part_bytes, self.most = int(options.get("part_bytes", PART_BYTES)), int(options.get("max_tile", MAX_TILE))

    def wanted(self, header: dict[str, int]) -> list[tuple[int, int]]:
        (z0, z1), (x0, x1), (y0, y1) = (self.bounds[c] for c in "zxy")
        out = []
        for z in range(max(z0, header["min_zoom"]), min(z1, header["max_zoom"], 30) + 1):
            out += runs_of(z, x0, y0, x1, y1)
        return joined(out)

    def partitions(self) -> Sequence[InputPartition]:
        def plan(path: str) -> list[InputPartition]:
            reader = RangeReader(path)
            header = header_of(reader)
            wanted = self.wanted(header)
            # the root alone: its entries, or leaves of about equal numbers of entries, share the bytes of the tiles
            root = _entries(reader.read(header["root"], header["root_bytes"]))
            entries = [e for e, end in zip(root, [*(e[0] for e in root[1:]), 1 << 62], strict=False) if _meet(wanted, e[0], e[0] + e[1] if e[1] else end)]
            below = max(1, sum(e[3] for e in root if not e[1]))
            leaf_bytes, leaf_tiles = header["tiles_bytes"] / below, header["addressed"] / below
            cuts, held, stood = [], 0.0, 0.0
            for e in entries:
                if held >= self.part_bytes or stood >= PART_TILES:
                    cuts.append(e[0])
                    held = stood = 0.0
                held += e[3] if e[1] else e[3] * leaf_bytes
                stood += e[1] or e[3] * leaf_tiles
            bounds = [0, *cuts, 1 << 62]
            out = []
            for a, b in zip(bounds, bounds[1:], strict=False) if entries else ():
                own = [(max(a, c), min(b, d)) for c, d in wanted if c < b and d > a]
                if own:
                    out.append(_Run(path, own))
            return out

        with ThreadPoolExecutor(16) as pool:
            return [p for own in pool.map(plan, self.paths) for p in own] or [_Run("", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([partition.path] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(3)), pa.array([r[3] for r in rows], pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["path", "z", "x", "y", "tile"])

        for row in tiles_in(RangeReader(partition.path), partition.runs, self.most, self.bounds):
            rows.append(row)
            size += len(row[3])
            if len(rows) == 1000 or size > MAX_RANGE:
                yield batch()
                size = 0
        if rows:
            yield batch()


class FilteredReader(ArchiveReader):
    """The same with bounds from filters too, for sessions with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):
        """Narrows the bounds; every filter stays with Spark too, as runs may hold more than the box."""
        for f in filters:
            column = getattr(f, "attribute", ())
            own = self.bounds.get(column[0]) if len(column) == 1 else None
            if own is not None:
                value = getattr(f, "value", None)
                if isinstance(f, EqualTo):
                    own[:] = max(own[0], value), min(own[1], value)
                elif isinstance(f, In):
                    own[:] = max(own[0], min(value)), min(own[1], max(value))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    own[0] = max(own[0], value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    own[1] = min(own[1], value - isinstance(f, LessThan))
            yield f


@dataclass
class _Written(WriterCommitMessage):
    bytes: int


class PlacedWriter(DataSourceArrowWriter):
    """Writes rows (at, data) at their places of one file in a folder that all tasks share. The commit holds what was
    written against options total and header (hexadecimal); the abort removes the file."""

    def __init__(self, options: dict[str, str]):
        self.path, self.total, self.header = options["path"], int(options["total"]), bytes.fromhex(options["header"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        written, handle = 0, os.open(self.path, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    view = memoryview(data)
                    while view:
                        n = os.pwrite(handle, view, at)
                        view, at, written = view[n:], at + n, written + n
            os.fsync(handle)
        finally:
            os.close(handle)
        return _Written(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        written = sum(m.bytes for m in messages if m is not None)
        if written != self.total or os.path.getsize(self.path) != self.total or RangeReader(self.path).read(0, len(self.header)) != self.header:
            self.abort(messages)
            raise ValueError(f"{written} bytes were written instead of {self.total}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


class Archive(DataSource):
    """spark.read.format("tilewright_archive"): rows (path, z, x, y, tile) of the archives in option path or paths (JSON).
    Options min_z to max_y bound the box; with option push, which needs spark.sql.python.filterPushdown.enabled, filters
    do as well."""

    @classmethod
    def name(cls) -> str:
        return "tilewright_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilteredReader(self.options) if self.options.get("push") == "true" else ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PlacedWriter(self.options)


def read_tiles(spark: SparkSession, paths: list[str], **bounds: int) -> DataFrame:
    """(path, z, x, y, tile) of archives; bounds, as min_z=3, max_x=10, narrow what is read and what is returned. Where the
    session lets Python sources have filters, those on z, x and y narrow it too."""
    spark.dataSource.register(Archive)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rows = spark.read.format("tilewright_archive").option("paths", json.dumps(paths)).option("push", push).options(**{k: str(v) for k, v in bounds.items()}).load()
    for name, value in bounds.items():
        kind, _, column = name.partition("_")
        if kind in ("min", "max") and column in "zxy":
            rows = rows.where(F.col(column) >= value if kind == "min" else F.col(column) <= value)
    return rows


def read_tile(spark: SparkSession, path: str, z: int, x: int, y: int, most: int = MAX_TILE) -> DataFrame:
    """The tile at an address, if there is one; a tile of more bytes than most is an error."""
    return read_tiles(spark, [path], min_z=z, max_z=z, min_x=x, max_x=x, min_y=y, max_y=y, max_tile=most)


def _numbers(batches):
    for batch in batches:
        if any(batch.column(c).null_count for c in ("z", "x", "y")):
            raise ValueError("a tile has no address")
        z, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("z", "x", "y"))
        yield pa.RecordBatch.from_arrays([pa.array(tile_numbers(z, x, y), pa.int64()), batch.column("z"), batch.column("tile")], names=["number", "z", "tile"])


def _running(rows: DataFrame, sizes: str, order: str) -> DataFrame:
    """rows of a stored table with before, the sum of sizes of all rows ahead in order: tasks add up ranges of their own,
    and one sum a task goes through a window."""
    from pyspark import TaskContext

    ordered = rows.repartitionByRange(order).sortWithinPartitions(order)
    names = [*rows.columns, "part", "own"]

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for n in batch.column(sizes).to_pylist():
                out.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(out), pa.int32()), pa.array(out, pa.int64())], names=names)

    numbered = durable(ordered.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", part int, own long"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy("part").agg(F.sum(sizes).alias("held")).select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"))
    return numbered.join(parts, "part").select(*rows.columns, (F.col("ahead") + F.col("own")).alias("before"))


def write_tiles(tiles: DataFrame, path: str, metadata: dict) -> dict[str, int]:
    """Writes tiles (z, x, y, tile) as one archive at path, a file of a folder that all tasks share, with a sidecar
    path.sha256; the numbers of the header are returned.

    Empty tiles are left out; of rows of one address the one of the least digest stays. Equal tiles are stored once.
    What goes through the driver are leaves' first numbers and places: LEAVES of them at most.
    """
    spark = tiles.sparkSession
    spark.dataSource.register(Archive)
    kept = tiles.where(F.octet_length("tile") > 0).select(F.col("z").cast("int").alias("z"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("tile").cast("binary").alias("tile"))
    numbered = durable(kept.mapInArrow(_numbers, "number long, z int, tile binary").withColumn("digest", F.sha2("tile", 256)))
    places = numbered.groupBy("number").agg(F.min(F.struct("digest", F.octet_length("tile").cast("long").alias("length"), "z")).alias("t")).select("number", "t.*")
    firsts = durable(places.groupBy("digest", "length").agg(F.min("number").alias("number")))
    placed = durable(_running(firsts, "length", "number").withColumnRenamed("before", "offset"))
    entries = durable(places.join(placed.select("digest", "offset"), "digest").select("number", "z", "offset", "length"))
    n, low, high = entries.agg(F.count("*"), F.coalesce(F.min("z"), F.lit(0)), F.coalesce(F.max("z"), F.lit(0))).first()
    contents, size = placed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    step = max(LEAF, -(-n // LEAVES))

    def leaves(batches):
        """Leaves (number, entries, data) of up to step entries; runs of one tile are one entry."""
        held: list[list[int]] = []

        def leaf():
            out = pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([_directory([tuple(e) for e in held])], pa.binary())], names=["number", "entries", "data"])
            held.clear()
            return out

        for batch in batches:
            for number, offset, length in zip(*(batch.column(c).to_pylist() for c in ("number", "offset", "length")), strict=True):
                if held and held[-1][2] == offset and held[-1][0] + held[-1][1] == number:
                    held[-1][1] += 1
                    continue
                if len(held) == step:
                    yield leaf()
                held.append([number, 1, offset, length])
        if held:
            yield leaf()

    # a task makes several leaves, as one is little work beside its start
    parts = max(1, min(LEAVES, n // (16 * step)))
    made = durable(entries.repartitionByRange(parts, "number").sortWithinPartitions("number").mapInArrow(leaves, "number long, entries long, data binary"))
    tops, ahead, counted = [], 0, 0
    for r in made.select("number", "entries", F.octet_length("data").alias("length")).orderBy("number").toLocalIterator():
        tops.append((r["number"], 0, ahead, r["length"]))
        ahead += r["length"]
        counted += r["entries"]
    if len(tops) <= 1:  # the root holds all entries itself
        root = bytes(made.first()["data"]) if tops else _directory([])
        if len(root) <= ROOT_BYTES:
            tops, ahead = [], 0
        else:
            root = _directory(tops)
    else:
        root = _directory(tops)
    about = gzip.compress(json.dumps(metadata, sort_keys=True).encode(), mtime=0)
    first = HEADER_BYTES + len(root)
    start = first + len(about) + ahead
    header = struct.pack(HEADER, MAGIC, 3, HEADER_BYTES, len(root), first, len(about), first + len(about), ahead, start, size, n, counted, contents, 1, 2, 1, 1, low, high, -1_800_000_000, -850_511_287, 1_800_000_000, 850_511_287, low, 0, 0)
    head = spark.createDataFrame([(0, bytearray(header + root + about))], "at long, data binary")
    # a tile is written from the first number that it stands at, so copies of one tile don't meet; rows of one address may
    # hold one tile twice
    own = placed.select("number", F.col("digest").alias("own"), (F.col("offset") + start).alias("at"))
    bodies = numbered.repartition(partitions(spark, numbered), "number").join(own, "number").where("digest = own")
    rows = bodies.groupBy("number", "at").agg(F.any_value("tile").alias("data")).select("at", "data")
    if tops:
        offsets = spark.createDataFrame([(t[0], t[2] + first + len(about)) for t in tops], "number long, at long")
        head = head.unionByName(made.join(offsets, "number").select("at", "data"))
    temporary, sidecar = f"{path}.{uuid.uuid4().hex}.part", f"{path}.sha256"
    try:
        head.unionByName(rows).write.format("tilewright_archive").mode("append").options(path=temporary, total=str(start + size), header=header.hex()).save()
        with open(f"{temporary}.sha256", "w") as f:
            f.write(f"{file_digest(spark, temporary)}  {os.path.basename(path)}\n")
        os.replace(f"{temporary}.sha256", sidecar)
        os.replace(temporary, path)
    finally:
        for left in (temporary, f"{temporary}.sha256"):
            if os.path.exists(left):
                os.remove(left)
    return {"addressed": n, "entries": counted, "contents": contents, "bytes": start + size, "leaves": len(tops)}


def file_digest(spark: SparkSession, path: str) -> str:
    """sha256 of a file, read in pieces by a task."""

    def run(batches):
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                total = hashlib.sha256()
                with open(name, "rb") as f:
                    for piece in iter(functools.partial(f.read, 1 << 20), b""):
                        total.update(piece)
                out.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["digest"])

    return spark.createDataFrame([(path,)], "path string").mapInArrow(run, "digest string").first()[0]


def verified(spark: SparkSession, path: str, least: int = HEADER_BYTES, most: int = 1 << 40) -> bool:
    """Whether a file has the magic, a size within bounds, and the digest that its sidecar names."""
    size = os.path.getsize(path)
    if not least <= size <= most or RangeReader(path).read(0, len(MAGIC)) != MAGIC:
        return False
    with open(f"{path}.sha256") as f:
        return f.read().split()[0] == file_digest(spark, path)
