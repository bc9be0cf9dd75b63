"""Single-file tile archives by the public PMTiles specification, version 3: reader and writer in Arrow batches.

Addresses become numbers along a Hilbert curve, zoom by zoom; a directory lists runs of numbers with offsets and lengths,
compressed; a large directory has leaves below a root. An archive is read by parts: header, root, leaves, then tiles.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

MAGIC = b"PMTiles"
#: header: offsets and lengths of root, metadata, leaves and tiles, counts, flags, zooms and bounds
HEADER = "<7sB11Q6B4iB2i"
HEADER_BYTES = 127
ROOT_BYTES = 16_384 - HEADER_BYTES


def tile_number(z: int, x: int, y: int) -> int:
    """Number of a tile: those of all smaller zooms, then its place on the Hilbert curve of its own."""
    base, side, d = (4**z - 1) // 3, 1 << z, 0
    s = side >> 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        s >>= 1
    return base + d


def tile_address(number: int) -> tuple[int, int, int]:
    """The inverse of tile_number."""
    z = 0
    while number >= (4 ** (z + 1) - 1) // 3:
        z += 1
    d = number - (4**z - 1) // 3
    x = y = 0
    s = 1
    while s < 1 << z:
        rx = 1 & d >> 1
        ry = 1 & (d ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        d >>= 2
        s <<= 1
    return z, x, y


def tile_numbers(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """tile_number of many tiles at once, of zooms up to 30."""
    z, x, y = (np.asarray(v).astype(np.int64) for v in (z, x, y))
    out = (np.left_shift(np.int64(1), 2 * z) - 1) // 3
    for k in range(int(z.max(initial=0)) - 1, -1, -1):
        s, own = np.int64(1 << k), z > k
        rx, ry = (x & s) > 0, (y & s) > 0
        out += np.where(own, s * s * (3 * rx.astype(np.int64) ^ ry), 0)
        # only bits below s matter from here on; a mirror turns them all over
        turn = own & ~ry
        mirror = turn & rx
        x, y = np.where(mirror, ~x, x), np.where(mirror, ~y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return out


#: The first number of each zoom.
_BASES = np.array([(4**z - 1) // 3 for z in range(32)], dtype=np.int64)


def tile_addresses(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tile_address of many numbers at once."""
    numbers = np.asarray(numbers).astype(np.int64)
    z = np.searchsorted(_BASES, numbers, side="right") - 1
    d = numbers - _BASES[z]
    x, y = np.zeros_like(d), np.zeros_like(d)
    for k in range(int(z.max(initial=0))):
        s, own = np.int64(1 << k), z > k
        rx = 1 & d >> 1
        ry = 1 & (d ^ rx)
        turn = own & (ry == 0)
        mirror = turn & (rx == 1)
        x, y = np.where(mirror, s - 1 - x, x), np.where(mirror, s - 1 - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        x, y = np.where(own, x + s * rx, x), np.where(own, y + s * ry, y)
        d >>= 2
    return z, x, y


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries (number, run, offset, length), column by column: deltas of numbers; an offset of 0 follows the one before."""
    out, last, end = [_varint(len(entries))], 0, None
    for number, *_ in entries:
        out.append(_varint(number - last))
        last = number
    out += [_varint(run) for _, run, _, _ in entries]
    out += [_varint(length) for *_, length in entries]
    for _, _, offset, length in entries:
        out.append(_varint(0 if offset == end else offset + 1))
        end = offset + length
    return gzip.compress(b"".join(out), mtime=0)


def _entries(data: bytes) -> list[tuple[int, int, int, int]]:
    raw, at = gzip.decompress(data), 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    count, last, numbers = number(), 0, []
    for _ in range(count):
        last += number()
        numbers.append(last)
    runs, lengths, offsets = [number() for _ in range(count)], [number() for _ in range(count)], []
    for k in range(count):
        v = number()
        offsets.append(offsets[-1] + lengths[k - 1] if not v else v - 1)
    return list(zip(numbers, runs, offsets, lengths, strict=True))


def write_archive(tiles: list[tuple[int, int, int, bytes]], metadata: dict) -> bytes:
    """Bytes of an archive; equal tiles are stored once, and runs of them are one entry."""
    placed, body, entries, seen = 0, [], [], {}
    ordered = sorted((tile_number(z, x, y), tile) for z, x, y, tile in tiles)
    for number, tile in ordered:
        key = hashlib.sha1(tile).digest()
        if key not in seen:
            seen[key] = (placed, len(tile))
            body.append(tile)
            placed += len(tile)
        offset, length = seen[key]
        if entries and entries[-1][2:] == [offset, length] and entries[-1][0] + entries[-1][1] == number:
            entries[-1][1] += 1
        else:
            entries.append([number, 1, offset, length])
    step, leaves = 4096, b""
    root = _directory([tuple(e) for e in entries])
    while len(root) > ROOT_BYTES:
        leaves, tops = b"", []
        for k in range(0, len(entries), step):
            leaf = _directory([tuple(e) for e in entries[k : k + step]])
            tops.append((entries[k][0], 0, len(leaves), len(leaf)))
            leaves += leaf
        root, step = _directory(tops), step * 2
    about = gzip.compress(json.dumps(metadata, sort_keys=True).encode(), mtime=0)
    zooms = [z for z, *_ in tiles] or [0]
    first = HEADER_BYTES + len(root)
    header = struct.pack(HEADER, MAGIC, 3, HEADER_BYTES, len(root), first, len(about), first + len(about), len(leaves), first + len(about) + len(leaves), placed,
                         len(ordered), len(entries), len(seen), 1, 2, 1, 1, min(zooms), max(zooms), -1_800_000_000, -850_511_287, 1_800_000_000, 850_511_287, min(zooms), 0, 0)
    return header + root + about + leaves + b"".join(body)


def read_header(data: bytes) -> dict:
    """Header and metadata; ValueError for anything else."""
    if len(data) < HEADER_BYTES or data[:7] != MAGIC or data[7] != 3:
        raise ValueError("not an archive of version 3")
    v = struct.unpack_from(HEADER, data)
    names = ("root", "root_bytes", "metadata", "metadata_bytes", "leaves", "leaves_bytes", "tiles", "tiles_bytes", "addressed", "entries", "contents", "clustered", "internal", "tile_compression", "tile_type", "min_zoom", "max_zoom")
    out = dict(zip(names, v[2:19], strict=True))
    if out["tiles"] + out["tiles_bytes"] > len(data):
        raise ValueError("an archive is cut off")
    return out | {"about": json.loads(gzip.decompress(data[out["metadata"] : out["metadata"] + out["metadata_bytes"]]) or b"{}")}


def read_archive(data: bytes):
    """(z, x, y, tile) in order of numbers, leaf by leaf."""
    h = read_header(data)
    todo = _entries(data[h["root"] : h["root"] + h["root_bytes"]])[::-1]
    while todo:
        number, run, offset, length = todo.pop()
        if run == 0:
            todo += _entries(data[h["leaves"] + offset : h["leaves"] + offset + length])[::-1]
            continue
        tile = data[h["tiles"] + offset : h["tiles"] + offset + length]
        for k in range(run):
            yield *tile_address(number + k), tile


def read_archives(files: DataFrame, column: str = "content") -> DataFrame:
    """(path, z, x, y, tile) of binaryFile rows; each archive is one row and one task reads it in parts of a thousand."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist(), strict=True):
                rows = []

                def flush(rows=rows, path=path):
                    out = pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(3)), pa.array([r[3] for r in rows], pa.binary())], names=["path", "z", "x", "y", "tile"])
                    rows.clear()
                    return out

                for row in read_archive(data):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield flush()
                if rows:
                    yield flush()

    return files.select("path", files[column].alias("data")).mapInArrow(run, "path string, z int, x int, y int, tile binary")


def pack_archives(tiles: DataFrame, name: str = "asset") -> DataFrame:
    """(asset, archive) of tiles (asset, z, x, y, tile): an archive for each region, made where its tiles meet.

    Regions are split before they are packed (see operators.planning.grid_split), which bounds an archive.
    """
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["z", "x", "y"]).drop_duplicates(["z", "x", "y"])
        data = write_archive([(int(z), int(x), int(y), bytes(t)) for z, x, y, t in zip(rows["z"], rows["x"], rows["y"], rows["tile"], strict=True)], {"name": str(key[0])})
        return pd.DataFrame({name: [key[0]], "archive": [data]})

    return tiles.groupBy(name).applyInPandas(run, f"{name} string, archive binary")
