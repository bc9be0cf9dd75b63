"""Vectorised word shingles: whole batches of texts are hashed with numpy, no Python work per word."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the multiplier and of its inverse, kept as far as some text has needed them."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = _powers(_P, size), _powers(_P_INV, size)
        return cls.up, cls.down


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); A-Z count as a-z, words end at ASCII white space."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[space[edge - 1]] if len(edge) else edge
    if len(joined) and not space[0]:
        starts = np.concatenate([[0], starts])
    ends = edge[~space[edge - 1]] if len(edge) else edge
    up, down = _Powers.get(len(joined) + 1)
    total = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, limits), prepend=0)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than width make one; no word, none."""
    hashes, counts = words(texts)
    acc = hashes.copy()
    for k in range(1, width):
        acc[: len(acc) - k] = mix(acc[: len(acc) - k] * _U(0x2545F4914F6CDD1D) + hashes[k:]) if len(acc) > k else acc[: len(acc) - k]
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            x = acc[at : at + n - width + 1]
            x = np.sort(x)
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif n:
            h = _U(n)
            for w in hashes[at : at + n]:
                h = mix(np.array([h], dtype=np.uint64) * _U(0x2545F4914F6CDD1D) + w)[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(hashes[:0])
        at += n
    return out


def slices(sizes: list[int], limit: int = 1 << 19):
    """Ranges of consecutive items of about limit bytes; a larger item stands alone."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
