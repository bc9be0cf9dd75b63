"""Byte-level BPE on a contiguous array of boundaries and adjacent ranks.

A word (a piece of the splitting pattern) is held as its part boundaries with, beside each, the rank of merging the
part with the next. The loop scans for the least rank, deletes the boundary between the two parts and refreshes the
ranks of the two neighbours. That is quadratic in the length of a word and fastest for short ones; words of more than
LONG bytes keep the same parts in a linked list under a heap, which gives the same merges in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.common import keyed_texts, small_batches, table, tidy, worker_cache
from tilewright.llm.shingles import slices

VOCABULARY = "byte_bpe_50k.json"
LONG = 128
#: Words whose ids are kept by a worker.
KEPT = 250_000
#: Size of the table of merges: two to this power.
TABLE_BITS = 19
_NONE = 1 << 60
# fixed values: the splitting pattern of the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the same for texts of Latin letters only, where the standard library's faster engine needs no properties
_LETTER, _DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones themselves, the rest from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    letters.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))})
    return letters


# fixed values: letters and numbers newer than the Unicode version of the vocabulary's pattern (16), which takes them for other signs
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f
12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_NEWER = "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (x.split("-") for x in NEWER.split()))


class Words(dict):
    """Ids of words as little-endian 32-bit bytes; a missing word is encoded and kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        out = array("I", self.codec.word(word.encode())).tobytes()
        if len(word) <= LONG:
            self[word] = out
        return out


class Codec:
    """Encodes and decodes with one vocabulary file; special tokens in a text are recognised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, letters = data["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        #: by pair of ids: rank << 20 | merged id
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]):
            self.merges[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.first_ids = np.array(self.first, dtype=np.int64)
        self.keys, self.values = np.full(1 << TABLE_BITS, -1, dtype=np.int64), np.zeros(1 << TABLE_BITS, dtype=np.int64)
        for key, value in self.merges.items():
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - TABLE_BITS)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << TABLE_BITS) - 1)
            self.keys[slot], self.values[slot] = key, value
        self.any, self.latin, self.newer = regex.compile(PATTERN).findall, re.compile(LATIN).findall, re.compile(f"[{_NEWER}]").search
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self)

    def split(self, text: str) -> list[str]:
        """The words of a text; their concatenation is the text."""
        if not _OTHER.search(text):
            return self.latin(text)
        if not self.newer(text):
            return self.any(text)
        return regex.findall(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{_NEWER}])").replace(r"\p{L}+", rf"(?:(?![{_NEWER}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{_NEWER}])\p{{N}})+"), text)

    def word(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        if len(parts) > LONG:
            return self._long(parts)
        get = self.merges.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != _NONE:
            i = ranks.index(low)
            parts[i] = merged = low & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | merged, _NONE)
            if i < len(ranks):
                ranks[i] = get(merged << 20 | parts[i + 1], _NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        get, n = self.merges.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m >> 20, i, parts[i], parts[i + 1], m & 0xFFFFF) for i in range(n - 1) if (m := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := get(merged << 20 | parts[after[i]])) is not None:
                    heapq.heappush(heap, (m >> 20, i, merged, parts[after[i]], m & 0xFFFFF))
            if (h := before[i]) >= 0 and (m := get(parts[h] << 20 | merged)) is not None:
                heapq.heappush(heap, (m >> 20, h, parts[h], merged, m & 0xFFFFF))
        return [p for p in parts if p >= 0]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of pairs of ids, from an open-addressed table; a negative id merges with nothing."""
        key = left.astype(np.int64) << 20 | right
        slot = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)
        slot = slot.astype(np.int64)
        out = np.full(key.shape, _NONE, dtype=np.int64)
        left_over = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        key, slot, flat = key.ravel(), slot.ravel(), out.ravel()
        while len(left_over):
            there = self.keys[slot[left_over]]
            hit = there == key[left_over]
            flat[left_over[hit]] = self.values[slot[left_over[hit]]]
            left_over = left_over[~hit & (there >= 0)]
            slot[left_over] = (slot[left_over] + 1) & ((1 << TABLE_BITS) - 1)
        return flat.reshape(out.shape)

    def many(self, words: list[str]) -> None:
        """Encodes words side by side, one row of boundaries and ranks each, and keeps their ids."""
        if len(self.words) + len(words) > KEPT:
            self.words.clear()
        lengths = {}
        for w in words:
            b = w.encode()
            lengths.setdefault(4 if len(b) <= 4 else 8 * (-(-len(b) // 8)), []).append((w, b))
        for width, group in lengths.items():
            if width > 48:
                for w, b in group:
                    if len(w) <= LONG:
                        self.words[w] = array("I", self.word(b)).tobytes()
                continue
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                raw = np.frombuffer(b"".join(b.ljust(width, b"\0") for _, b in part), dtype=np.uint8).reshape(-1, width)
                size = np.array([len(b) for _, b in part])
                col = np.arange(width)
                parts = np.where(col < size[:, None], self.first_ids[raw], -1)
                done = np.full((len(part), width), -1, dtype=np.int64)
                rows = np.arange(len(part))
                ranks = self.find(parts[:, :-1], parts[:, 1:])
                while len(rows):
                    at_min = ranks.argmin(axis=1)
                    low = ranks[np.arange(len(rows)), at_min]
                    on = low != _NONE
                    if not on.all():
                        done[rows[~on], : parts.shape[1]] = parts[~on]
                        rows, parts, ranks, at_min, low = rows[on], parts[on], ranks[on], at_min[on], low[on]
                        if not len(rows):
                            break
                    n = np.arange(len(rows))
                    parts[n, at_min] = low & 0xFFFFF
                    col = np.arange(parts.shape[1])
                    keep = col != (at_min + 1)[:, None]
                    parts = parts[keep].reshape(len(rows), -1)
                    keep = col[:-1] != at_min[:, None]
                    ranks = ranks[keep].reshape(len(rows), -1)
                    if not ranks.shape[1]:
                        done[rows, :1] = parts
                        break
                    left = np.maximum(at_min - 1, 0)
                    fresh = self.find(parts[n, left], parts[n, left + 1])
                    ranks[n[at_min > 0], left[at_min > 0]] = fresh[at_min > 0]
                    right = np.minimum(at_min, parts.shape[1] - 2)
                    fresh = self.find(parts[n, right], parts[n, right + 1])
                    inside = at_min <= parts.shape[1] - 2
                    ranks[n[inside], right[inside]] = fresh[inside]
                sizes = (done >= 0).sum(axis=1).tolist()
                flat = done.astype("<u4").tobytes()
                step = width * 4
                for k, (w, _) in enumerate(part):
                    self.words[w] = flat[k * step : k * step + 4 * sizes[k]]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, one after the other."""
        pieces = [self.at_special.split(t) if self.at_special and any(s in t for s in self.special) else [t] for t in texts]
        split = [[self.split(p) for p in ps[::2]] for ps in pieces]
        new = set().union(*(w for ps in split for w in ps)) - self.words.keys()
        self.many(list(new))
        get, out = self.words.__getitem__, []
        for ps, words in zip(pieces, split, strict=True):
            ids = [b"".join(map(get, w)) for w in words]
            for k, token in enumerate(ps[1::2]):
                ids[k] += array("I", [self.special[token]]).tobytes()
            out.append(b"".join(ids))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encoded(documents: DataFrame, name: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, and with keep_ids the column ids (binary).

    A null text is empty; an empty text has no tokens and the digests of nothing. Other columns are ignored; repeated
    and null doc_ids keep their rows. One pass without an exchange; memory is bounded by one batch.
    name: a vocabulary file of the public tokenizers, found on each executor.
    """
    small_batches(documents.sparkSession)

    def run(batches):
        codec = worker_cache().get(name) or worker_cache().setdefault(name, Codec(vocabulary_path(name)))
        for batch in batches:
            n, sha, back, kept = [], [], [], []
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in texts]):
                for ids in codec.encode_many(texts[a:b]):
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        kept.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), *([pa.array(kept, pa.binary())] if keep_ids else [])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    return keyed_texts(documents).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
