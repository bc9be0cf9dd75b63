"""Features on the wire over flat arrays: a batch is written, or read, with as many steps as a feature has fields and
commands, not as there are features.

What is read here is what sources.typed writes: fields in order, each once. Readers return None for anything else, and for
whatever a limit may be about; the plain reader then says what it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Commands of one feature that are read over flat arrays; each takes a step over the batch.
COMMANDS = 256


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin; one place more than runs."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def ragged(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run after another."""
    return np.repeat(begin - ends_of(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def woven(columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of columns (bytes, where each row begins), row by row: a row's first column, its second, and so on."""
    sizes = [np.diff(starts) for _, starts in columns]
    out_at = ends_of(np.sum(sizes, axis=0))
    out, at = np.zeros(out_at[-1], np.uint8), out_at[:-1].copy()
    for (data, _), size in zip(columns, sizes, strict=True):
        out[ragged(at, size)] = data
        at += size
    return out, out_at


def constant(byte: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, byte, np.uint8), np.arange(n + 1)


def as_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of binary values and where each begins."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).astype(np.int64)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def as_binary(data: np.ndarray, at: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """An array of the binary values that begin at these places of data; null where they aren't known."""
    mask = None if known is None else pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [mask, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def run_starts(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Where the runs of rows begin that are equal in these columns; nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def low_bits(numbers: pa.Array) -> np.ndarray:
    """Whole numbers as 64 bits, those below 0 by their two's complement; any for a null."""
    if not pa.types.is_decimal128(numbers.type) or numbers.type.scale:
        return numbers.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    data = numbers.buffers()[1]
    return np.frombuffer(data, np.uint64, 2 * len(numbers), 16 * numbers.offset)[::2].copy() if len(numbers) else np.zeros(0, np.uint64)


def as_decimals(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """Unsigned numbers as decimals of 20 digits; null where they aren't known."""
    wide = np.zeros((len(values), 2), np.uint64)
    wide[:, 0] = values
    mask = pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(values), [mask, pa.py_buffer(wide.tobytes())])


def numbers_at(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The varints that begin at these places of data, which ten bytes of 0 follow, and where they end."""
    byte = data[at]
    out, at = (byte & 127).astype(np.uint64), at + 1
    more, shift = np.flatnonzero(byte > 127), 7
    while len(more):
        if shift > 56:  # nine bytes are 63 bits
            return None
        byte = data[at[more]]
        out[more] |= (byte & 127).astype(np.uint64) << np.uint64(shift)
        at[more] += 1
        more, shift = more[byte > 127], shift + 7
    return out, at


def packed(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The varints in these runs of data, and where those of each run begin."""
    own = data[ragged(begin, sizes)]
    last = own < 128
    bounds = ends_of(sizes)
    some = sizes > 0
    if not last[bounds[1:][some] - 1].all():
        return None
    starts = ends_of(last)[bounds]
    if last.all():
        return own.astype(np.uint64), starts
    ends = np.flatnonzero(last) + 1
    found = numbers_at(np.concatenate([own, np.zeros(10, np.uint8)]), np.concatenate([[0], ends[:-1]]))
    return None if found is None else (found[0], starts)


def field_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Where the features begin and end in bytes that hold nothing else."""
    at, end, begin, stop = 0, len(data), [], []
    try:
        while at < end:
            if data[at] != 18:
                return None
            size = data[at + 1]
            at += 2
            if size > 127:
                size, shift = size & 127, 7
                while True:
                    byte = data[at]
                    at += 1
                    size |= (byte & 127) << shift
                    if byte < 128:
                        break
                    shift += 7
            begin.append(at)
            at += size
            stop.append(at)
    except IndexError:
        return None
    return (np.array(begin, np.int64), np.array(stop, np.int64)) if at == end else None


def geometries(stream: np.ndarray, bounds: np.ndarray) -> tuple | None:
    """Command streams, a feature's from bounds to bounds, as (points of each feature, parts of each feature, where each
    part begins and the last ends, x, y)."""
    n = len(bounds) - 1
    at, stop = bounds[:-1].copy(), bounds[1:]
    if (at >= stop).any() or (stream >> np.uint64(40)).any():
        return None
    stream = stream.view(np.int64)
    if (stream[at] & 7 != 1).any() or (stream[at] < 8).any():
        return None
    active, steps = np.arange(n), []
    while len(active):
        if len(steps) == COMMANDS:
            return None
        own = at[active]
        command = stream[own]
        op, count = command & 7, command >> 3
        shut = op == 7
        after = own + 1 + np.where(shut, 0, 2 * count)
        if not (shut | (op == 1) | (op == 2)).all() or (after > stop[active]).any():
            return None
        steps.append((active, op, np.where(shut, 1, count), own + 1))
        at[active] = after
        active = active[after < stop[active]]
    feature, op, count, place = (np.concatenate([s[k] for s in steps]) for k in range(4))
    order = np.argsort(feature, kind="stable")
    feature, op, count, place = feature[order], op[order], count[order], place[order]
    total = int(count.sum())
    kind, owner = np.repeat(op, count), np.repeat(feature, count)
    shut = kind == 7
    read = np.repeat(place, count) + 2 * (np.arange(total) - np.repeat(ends_of(count)[:-1], count))
    read[shut] = 0
    first = ends_of(np.bincount(owner, minlength=n))
    new = np.flatnonzero(kind == 1)
    part = np.cumsum(kind == 1) - 1
    xy = []
    for k in range(2):
        step = stream[np.minimum(read + k, len(stream) - 1)]
        step = step >> 1 ^ -(step & 1)
        step[shut] = 0
        sums = ends_of(step)
        v = sums[1:] - np.repeat(sums[first[:-1]], np.diff(first))
        v[shut] = v[new[part[shut]]]
        xy.append(v)
    return np.diff(first), np.bincount(owner[new], minlength=n), np.append(new, total), *xy


def features_of(data: bytes, n_keys: int, n_values: int) -> tuple | None:
    """(ids, whether each has one, types, tags of each, key and value of each tag, what geometries() gives) of bytes that
    are features and nothing else."""
    bounds = field_bounds(data)
    if bounds is None:
        return None
    at, stop = bounds
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(16, np.uint8)])
    ids = np.zeros(len(at), np.uint64)
    known = (raw[at] == 8) & (at < stop)
    own = np.flatnonzero(known)
    if len(own):
        # ids may take ten bytes: the tenth is the highest bit
        long = own[(raw[np.minimum(at[own][:, None] + np.arange(1, 10), len(raw) - 1)] > 127).all(axis=1)]
        short = np.setdiff1d(own, long, assume_unique=True)
        found = numbers_at(raw, at[short] + 1)
        if found is None or (raw[np.minimum(at[long] + 10, len(raw) - 1)] > 1).any():
            return None
        ids[short] = found[0]
        at = at.copy()
        low = raw[at[long][:, None] + np.arange(1, 10)].astype(np.uint64) & np.uint64(127)
        ids[long] = (low << (np.arange(9, dtype=np.uint64) * np.uint64(7))).sum(axis=1, dtype=np.uint64) | raw[at[long] + 10].astype(np.uint64) << np.uint64(63)
        at[short], at[long] = found[1], at[long] + 11
    spans, gtype = [], None
    for tag in (18, 24, 34):
        if (at >= stop).any() or (raw[at] != tag).any():
            return None
        found = numbers_at(raw, at + 1)
        if found is None:
            return None
        value, at = found[0].view(np.int64), found[1]
        if tag == 24:
            gtype = value
        else:
            if (value > stop - at).any():
                return None
            spans.append((at, value))
            at = at + value
    if (at != stop).any() or ((gtype < 1) | (gtype > 3)).any():
        return None
    tags, commands = packed(raw, *spans[0]), packed(raw, *spans[1])
    if tags is None or commands is None:
        return None
    counts = np.diff(tags[1])
    if (counts % 2).any():
        return None
    counts, key, value = counts // 2, tags[0][::2], tags[0][1::2]
    if (key >= n_keys).any() or (value >= n_values).any():
        return None
    key, value = key.astype(np.int64), value.astype(np.int64)
    twice = np.sort(np.repeat(np.arange(len(counts)), counts) * n_keys + key)
    if (twice[1:] == twice[:-1]).any():
        return None
    shapes = geometries(*commands)
    return None if shapes is None else (ids, known, gtype, counts, key, value, shapes)
