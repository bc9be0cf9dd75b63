"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles. Two documents link when 100 * |A & B| >= 75 * |A | B|.

1. Extended prefixes. Tokens (shingles) are ordered by hash. The prefix of a set x has |x| - o + |x| / 4 tokens, with
   o = ceil(0.75 |x|) the least overlap of any link of x. Of two linked sets take the one
   whose prefix ends first: at most |x| - o of its tokens are missing in the partner, so both prefixes hold
   k common tokens at least (see prefix_of).
2. Token frequencies. Occurrences in prefixes are counted exactly over all documents (each task sends a token once,
   with its count), and the counts of tokens with more than one go back to the documents, whose tokens meet the counts
   bucket by bucket as a stream. A document with fewer than k such tokens has no link and ends here.
3. Token combinations. The h tokens left are ordered by frequency. Of k common ones, one at least is among the first
   h - k + 1. Rare tokens are indexed alone. Frequent ones form classes 2 and 3, whose tokens are indexed in
   combinations of 2 and 3; each class is dealt by hash into groups, and the first tokens are extended until

       (rare tokens) + sum over groups of max(0, tokens of the group - (class - 1))  >=  h - k + 1

   so that a linked pair shares a rare token, or as many tokens of some group as its class combines. Groups are in
   proportion to a document's size, which keeps combinations in proportion to it too; linked sizes differ by 4/3 at
   most, so each document emits combinations for two overlapping ranges of sizes, and groups belong to the range.
4. Verification. Documents that share a key form a star around the smallest, never pairs; stars are first drawn within
   a task and one document a key goes on. Connected components of stars hold every link; exact copies (equal sets) are
   one node. Components are verified with whole sets, large ones in blocks that meet two by two, and verified links
   give the final components.

Nothing but a fixed-size filter is broadcast; it only spares documents without candidates the way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import batches_by_key, components, keyed_texts, partitions, small_batches, stored, table, tidy, utf8
from tilewright.llm.shingles import mix, shingle_sets, slices

WIDTH = 5
#: Occurrences from which a token is of class 2 and of class 3.
FREQUENT, VERY = 64, 4096
#: Parts of the filter on the way to the driver; salts that spread a frequent token's documents.
PARTS, SALTS = 16, 4
#: Documents of a block of the verification, and their tokens.
BLOCK, BLOCK_TOKENS = 1024, 1 << 20
#: Bits of the filter that keeps documents without a candidate from moving; it never decides a link.
FILTER_BITS = 1 << 26

_U = np.uint64


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    ids, texts = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
    for a, b in slices([len(x) for x in texts]):
        yield from zip(ids[a:b], shingle_sets(texts[a:b], width), strict=True)


def set_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, d1, d2): equal sets have equal digests of 128 bits."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, x in _sets(batch, width):
                a, b = np.add.reduce(mix(x), dtype=_U), np.add.reduce(mix(x ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U)
                rows.append((i, len(x), int(a.view(np.int64)), int(b.view(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["doc_id", "n_shingles", "d1", "d2"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, d1 long, d2 long")


def ranges_of(n: int) -> list[int]:
    """The two ranges of sizes that a set of n tokens belongs to; sets whose sizes differ by 4/3 at most share one."""
    at = int(np.floor(np.log(n) / np.log(4 / 3) + 1e-9))
    return [at - 1, at]


def prefix_of(n: int) -> tuple[int, int]:
    """(length of the extended prefix, common tokens k that links have in it) of a set of n tokens.

    A set's own prefix has a quarter of its tokens more than links can miss. k must hold for both of two linked sets, so
    it is a quarter of the least partner's size, less one in case two tokens of a set fall together in 48 bits.
    """
    o = -(-75 * n // 100)
    return min(n, n - o + -(-n // 4)), max(1, (3 * n // 4) // 4 - 1)


def keys_of(n: int, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys that index a set of n tokens, from those of its prefix that others have too."""
    k = prefix_of(n)[1]
    need = len(tokens) - k + 1
    if need < 1:
        return tokens[:0]
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    rare = tokens[counts < FREQUENT]
    if len(rare) >= need:
        return rare[:need]
    often = [(2 + (c >= VERY), h) for h, c in zip(tokens[len(rare) :].tolist(), counts[len(rare) :].tolist(), strict=True)]
    out = set()
    for r in ranges_of(n):
        least = (4 / 3) ** r
        groups = max(1, int(least / 32))
        most = min(3, prefix_of(int(np.ceil(least - 1e-6)))[1])  # the smallest set of the range must afford its classes
        have, dealt = len(rare), {}
        for c, h in often:
            c = min(c, most if least >= 64 else min(2, most))
            own = dealt.setdefault((c, (h >> 8) % groups), [])
            if len(own) >= c - 1:
                have += 1
                for others in combinations(own, c - 1):
                    out.add(hash((r + 1000, c, *others, h)))
            own.append(h)
            if have >= need:
                break
        if have < need:
            raise AssertionError("a prefix of combinations must reach every link")
    return np.concatenate([rare, mix(np.array([h & 0xFFFFFFFFFFFFFFFF for h in out], dtype=_U))])


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length in one value; sorted ones lose most of their bytes."""
    return len(columns[0]).to_bytes(4, "little") + zlib.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns), 1)


def _unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, raw, out = int.from_bytes(value[:4], "little"), 0, zlib.decompress(value[4:]), []
    if not n:
        return [np.zeros(0, dtype=kind) for kind in kinds]
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, positions of its keys, sorted by key)."""
    bucket = keys & _U(buckets - 1)
    order = np.lexsort((keys, bucket))
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=_U))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, order[cut[b] : cut[b + 1]]


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def shared_tokens(docs: DataFrame, buckets: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, hits): for each document and bucket the tokens of its prefix that others have too, with counts."""
    spark = docs.sparkSession
    parts = partitions(spark, docs)
    names, kinds, schema = ["bucket", "salt", "kind", "value"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()], "bucket int, salt int, kind int, value binary"

    def held(batches):
        """Prefixes by about two million tokens, 48 bits each: (id, size, tokens)."""
        own, weight = [], 0
        for batch in batches:
            for i, x in _sets(batch, width):
                if len(x) > 1:
                    short = x >> _U(16)
                    short = short[np.concatenate([[True], short[1:] != short[:-1]])]
                    own.append((i, len(x), short[: prefix_of(len(x))[0]]))
                    weight += len(own[-1][2])
                if weight > 2_000_000:
                    yield own
                    own, weight = [], 0
        if own:
            yield own

    def count(batches):
        for own in held(batches):
            tokens, counts = np.unique(np.concatenate([x for _, _, x in own]), return_counts=True)
            yield _batch([(b, 0, 0, _pack(np.diff(tokens[at], prepend=_U(0)), counts[at].astype(np.uint32))) for b, at in _by_bucket(tokens, buckets)], names, kinds)

    def total(batches):
        for group in batches_by_key(batches, "bucket"):
            got = [_unpack(v, "<u8", "<u4") for v in group.column("value").to_pylist()]
            tokens, counts = np.concatenate([np.cumsum(t, dtype=_U) for t, _ in got]), np.concatenate([c for _, c in got])
            order = np.argsort(tokens, kind="stable")
            tokens, counts = tokens[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else order
            sums = np.add.reduceat(counts, first)
            tokens, sums = tokens[first][sums > 1], np.minimum(sums[sums > 1], VERY)
            b = group.column("bucket")[0].as_py()
            yield _batch([(b, k, 0, _pack(np.diff(tokens, prepend=_U(0)), sums.astype(np.uint16))) for k in range(SALTS)], names, kinds)

    def entries(batches):
        for turn, own in enumerate(held(batches)):
            tokens = np.concatenate([x for _, _, x in own])
            which = np.repeat(np.arange(len(own), dtype=np.uint32), [len(x) for _, _, x in own])
            ids, sizes = np.array([i for i, _, _ in own], dtype=np.int64), np.array([n for _, n, _ in own], dtype=np.uint32)
            rows = []
            for b, at in _by_bucket(tokens, buckets):
                docs_at = np.unique(which[at])
                value = _pack(np.diff(tokens[at], prepend=_U(0)), np.searchsorted(docs_at, which[at]).astype(np.uint32))
                rows.append((b, int(ids[0] + turn) % SALTS, 1, len(value).to_bytes(4, "little") + value + _pack(ids[docs_at], sizes[docs_at])))
            yield _batch(rows, names, kinds)

    def hits(batches):
        known, tokens, counts = None, None, None
        for batch in batches:
            rows = []
            for b, salt, kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    known, (tokens, counts) = (b, salt), _unpack(value, "<u8", "<u2")
                    tokens = np.cumsum(tokens, dtype=_U)
                elif known == (b, salt) and len(tokens):
                    size = int.from_bytes(value[:4], "little")
                    own, which = _unpack(value[4 : 4 + size], "<u8", "<u4")
                    ids, sizes = _unpack(value[4 + size :], "<i8", "<u4")
                    own = np.cumsum(own, dtype=_U)
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    there = np.flatnonzero(tokens[at] == own)
                    there = there[np.argsort(which[there], kind="stable")]
                    doc = which[there]
                    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
                    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True) if len(doc) else ():
                        own_at = there[s:e]
                        rows.append((int(ids[doc[s]]), int(sizes[doc[s]]), own[own_at].tobytes() + counts[at[own_at]].tobytes()))
            yield _batch(rows, ["doc_id", "n", "hits"], [pa.int64(), pa.int64(), pa.binary()])

    totals = docs.mapInArrow(tidy(count), schema).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(total), schema)
    return docs.mapInArrow(tidy(entries), schema).unionByName(totals).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind").mapInArrow(tidy(hits), "doc_id long, n long, hits binary")


def forest(pairs: np.ndarray) -> np.ndarray:
    """Edges (root, node) of the connected components of pairs; a root is its component's smallest node."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:
        a, b = root[at[:, 0]], root[at[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[root[off]], nodes[off]], axis=1)


def candidate_edges(docs: DataFrame, tokens: int, copies: DataFrame, width: int = WIDTH) -> DataFrame:
    """Edges (a, b) of stars of documents that share a key; documents of copies (doc_id) have none, their like stands for
    them. tokens: the sum of all set sizes, for the number of buckets."""
    spark = docs.sparkSession
    parts = partitions(spark, docs)
    buckets = 1 << max(6, int(np.ceil(np.log2(max(1, tokens / 2 / 2_000_000)))))

    def star(keys, ids):
        """(edges that connect what the stars of all keys connect, first document of each key)."""
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        low = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        off = ids != low
        return forest(np.stack([low[off], ids[off]], axis=1)), keys[new], ids[new]

    def keyed(batches):
        keys, ids, weight = [], [], 0

        def flush():
            edges, k, i = star(np.concatenate(keys), np.concatenate(ids))
            rows = [(-1, *e, None) for e in edges.tolist()]
            rows += [(b, None, None, _pack(np.diff(k[at], prepend=_U(0)), i[at])) for b, at in _by_bucket(k, buckets)]
            keys.clear(), ids.clear()
            return _batch(rows, ["bucket", "a", "b", "value"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()])

        def close(doc, n, got):
            x = np.concatenate([np.frombuffer(v, dtype="<u8", count=len(v) // 10) for v in got])
            c = np.concatenate([np.frombuffer(v, dtype="<u2", offset=len(v) // 10 * 8) for v in got])
            x, at = np.unique(x, return_index=True)  # a repeated row has its tokens twice
            k = keys_of(n, x, c[at].astype(np.int64))
            if len(k):
                keys.append(k)
                ids.append(np.full(len(k), doc, dtype=np.int64))
            return len(k)

        last, got = None, []
        for batch in batches:
            for doc, n, hit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and last != (doc, n):
                    weight += close(*last, got)
                    got = []
                    if weight > 1_000_000:
                        yield flush()
                        weight = 0
                last = (doc, n)
                got.append(hit)
        if last:
            close(*last, got)
        if keys:
            yield flush()

    def lists(batches):
        keys, ids, at, weight = [], [], None, 0

        def flush():
            edges, _, _ = star(np.concatenate(keys), np.concatenate(ids))
            keys.clear(), ids.clear()
            return _batch(edges.tolist(), ["a", "b"], [pa.int64(), pa.int64()])

        for batch in batches:
            ready = []
            for b, x, y, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b < 0:
                    ready.append((x, y))
                    continue
                if b != at and weight > 4_000_000:
                    yield flush()
                    weight = 0
                at = b
                k, i = _unpack(value, "<u8", "<i8")
                weight += len(k)
                keys.append(np.cumsum(k, dtype=_U))
                ids.append(i)
            if ready:
                yield _batch(ready, ["a", "b"], [pa.int64(), pa.int64()])
        if keys:
            yield flush()

    found = shared_tokens(docs, buckets, width).join(copies, "doc_id", "left_anti").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "n").mapInArrow(tidy(keyed), "bucket int, a long, b long, value binary")
    spread = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("a", "b"))
    # keys are about a sixth of what moved before
    return found.repartition(max(6, parts // 6), spread).sortWithinPartitions("bucket").mapInArrow(tidy(lists), "a long, b long").distinct()


class _Unit:
    """Sets in order of size, indexed by token. sides: only sets of different sides are compared (two blocks that meet)."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], sides: list[int] | None = None):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        self.side = np.array([sides[i] for i in order]) if sides else None
        self.sizes = np.array([len(x) for x in sets])[order]
        flat = np.concatenate(self.sets)
        by = np.argsort(flat, kind="stable")
        token, self.who = flat[by], np.repeat(np.arange(len(sets)), self.sizes)[by]
        self.first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        self.count = np.diff(np.append(self.first, len(token)))
        self.place = np.empty(len(flat), dtype=np.int64)
        self.place[by] = np.repeat(np.arange(len(self.first)), self.count)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])

    def holders(self, tokens: np.ndarray) -> np.ndarray:
        """The sets of each token, one after another."""
        return np.concatenate([self.who[self.first[t] : self.first[t] + self.count[t]] for t in tokens.tolist()])

    def near(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of set j, the smaller sets that share one of its rarest tokens: every link of j to them is there)."""
        none, n = np.zeros(0, dtype=np.int64), int(self.sizes[j])
        i0 = int(np.searchsorted(self.sizes, -(-3 * n // 4), side="left"))
        if i0 >= j:
            return none, none
        own = self.place[self.start[j] : self.start[j + 1]]
        own = own[np.argsort(self.count[own], kind="stable")]
        # a set of a link misses at most a quarter of these tokens: the rarest of them reach every link
        rare = own[: n - (-(-75 * n // 100)) + 1]
        rare = rare[self.count[rare] > 1]
        if not len(rare):
            return own, none
        near = np.unique(self.holders(rare))
        near = near[(near >= i0) & (near < j)]
        return own, near if self.side is None else near[self.side[near] != self.side[j]]

    def linked(self, j: int, near: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return near[100 * hits >= 75 * (self.sizes[near] + self.sizes[j] - hits)]


def links_within(ids: list[int], sets: list[np.ndarray], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links of these sets connect: pairs already connected aren't compared again."""
    u = _Unit(ids, sets, sides)
    root = np.arange(len(sets))
    found = []
    for j in range(1, len(sets)):
        own, near = u.near(j)
        near = near[root[near] != root[j]]
        while len(near):
            if len(near) > 24 and int(u.count[own].sum()) < 200 * len(near) * 8:
                for i in u.linked(j, near, np.bincount(u.holders(own), minlength=len(sets))[near]).tolist():
                    if root[i] != root[j]:
                        found.append((u.ids[i], u.ids[j]))
                        root[root == root[j]] = root[i]
                break
            if len(u.linked(j, near[-1:], np.array([len(np.intersect1d(u.sets[near[-1]], u.sets[j], assume_unique=True))]))):
                found.append((u.ids[near[-1]], u.ids[j]))
                root[root == root[j]] = root[near[-1]]
            near = near[:-1]
            near = near[root[near] != root[j]]
    return found


def all_links_within(ids: list[int], sets: list[np.ndarray], sides: list[int] | None = None) -> np.ndarray:
    """All links (a, b) of these sets; each candidate pair is compared once. Repeated ids count once."""
    u = _Unit(ids, sets, sides)
    seen = np.zeros(len(u.first), dtype=bool)
    names, found = np.array(u.ids, dtype=np.int64), [np.zeros((0, 2), dtype=np.int64)]
    for j in range(1, len(sets)):
        own, near = u.near(j)
        if not len(near):
            continue
        if int(u.count[own].sum()) < int(u.sizes[near].sum()):
            hits = np.bincount(u.holders(own), minlength=len(sets))[near]
        else:
            seen[own] = True
            hits = np.array([np.count_nonzero(seen[u.place[u.start[i] : u.start[i + 1]]]) for i in near.tolist()])
            seen[own] = False
        linked = names[u.linked(j, near, hits)]
        found.append(np.stack([np.minimum(linked, names[j]), np.maximum(linked, names[j])], axis=1))
    pairs = np.concatenate(found)
    return pairs if len(set(ids)) == len(ids) else np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def verified_edges(docs: DataFrame, members: DataFrame, width: int = WIDTH, block: int = BLOCK, copies: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect what the links of each candidate component connect. members: (doc_id, root).

    copies: (doc_id, copies) of those that stand for more than themselves. With it every candidate pair is compared, and
    rows (a, null, n) tell with how many documents a links in a unit; else n is null.

    members also have n_shingles, the size of the set. A component of more than block documents or BLOCK_TOKENS tokens is
    dealt by ranges of sizes, and each range by hash into blocks of at most about that much. Sizes of linked sets differ by
    4/3 at most, which is a range's width, so a block meets the blocks of its own and of the two neighbouring ranges:
    pairs beyond that ratio never move, and no task holds more than two blocks.
    """
    spark = docs.sparkSession
    members = members.withColumn("copies", F.lit(1).cast("long")) if copies is None else members.join(copies, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    whole = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("tokens")).where("size > 1")
    klass = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(4 / 3)) + 1e-9).cast("int")
    large = (F.col("size") > block) | (F.col("tokens") > BLOCK_TOKENS)
    ranged = members.join(whole, "root").select("doc_id", "root", "copies", "n_shingles", large.alias("large"), F.when(large, klass).otherwise(0).alias("klass"))
    of_range = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_TOKENS)).cast("int")
    ranges = stored(ranged.groupBy("root", "klass", "large").agg(F.when(F.col("large"), of_range).otherwise(1).alias("blocks")))
    at = lambda k: ranges.select("root", (F.col("klass") + k).alias("klass"), F.col("blocks").alias(f"blocks{k}"))
    three = ranges.select("root", "klass", "blocks").join(at(1), ["root", "klass"], "left").join(at(-1), ["root", "klass"], "left").select("root", "klass", "blocks", F.coalesce("blocks1", F.lit(0)).alias("below"), F.coalesce("blocks-1", F.lit(0)).alias("above"))
    dealt = stored(ranged.join(three, ["root", "klass"]).select("doc_id", "root", "copies", "klass", "blocks", "below", "above", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("own")))

    def bits(batches):
        m = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            h = mix(batch.column("doc_id").to_numpy().view(_U)) & _U(FILTER_BITS - 1)
            np.bitwise_or.at(m, (h >> _U(3)).astype(np.int64), np.left_shift(1, (h & _U(7)).astype(np.uint8)).astype(np.uint8))
        for k, part in enumerate(np.split(m, PARTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "bits"])

    def either(batches):
        for group in batches_by_key(batches, "part"):
            m = np.zeros(FILTER_BITS // 8 // PARTS, dtype=np.uint8)
            for x in group.column("bits").to_pylist():
                m |= np.frombuffer(zlib.decompress(x), dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([group.column("part").combine_chunks().slice(0, 1), pa.array([zlib.compress(m.tobytes(), 1)], pa.binary())], names=["part", "bits"])

    wanted = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for k, x in dealt.select("doc_id").mapInArrow(tidy(bits), "part int, bits binary").repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(tidy(either), "part int, bits binary").collect():
        wanted[k * len(wanted) // PARTS : (k + 1) * len(wanted) // PARTS] = np.frombuffer(zlib.decompress(x), dtype=np.uint8)
    mask = spark.sparkContext.broadcast(zlib.compress(wanted.tobytes(), 1))

    def likely(batches):
        m = np.frombuffer(zlib.decompress(mask.value), dtype=np.uint8)
        for batch in batches:
            h = mix(batch.column("doc_id").to_numpy().view(_U)) & _U(FILTER_BITS - 1)
            keep = (m[(h >> _U(3)).astype(np.int64)] >> (h & _U(7)).astype(np.uint8)) & 1
            yield batch.filter(pa.array(keep.astype(bool)))

    texts = docs.mapInArrow(tidy(likely), "doc_id long, text string").join(dealt, "doc_id")
    # a unit is a pair of blocks: of one range, of it and the next, or of it and the one before
    own, up = F.expr("transform(sequence(0, blocks - 1), b -> struct(klass AS k, least(own, b) AS a, 0 AS up, greatest(own, b) AS b, own AS side))"), lambda n, expr: f"transform(IF({n} > 0, sequence(0, {n} - 1), CAST(array() AS array<int>)), b -> {expr})"
    after = F.expr(up("above", "struct(klass AS k, own AS a, 1 AS up, b AS b, 0 AS side)"))
    before = F.expr(up("below", "struct(klass - 1 AS k, b AS a, 1 AS up, own AS b, 1 AS side)"))
    meets = texts.select("doc_id", "text", "root", "copies", F.explode(F.concat(own, before, after)).alias("u"))
    units = meets.select("doc_id", "text", F.col("u.side").alias("own"), "copies", F.xxhash64("root", "u.k", "u.a", "u.up", "u.b").alias("unit"), ((F.col("u.up") == 0) & (F.col("u.a") == F.col("u.b"))).alias("inner"))

    counted = copies is not None

    def verify(batches):
        for group in batches_by_key(batches, "unit"):
            ids, own, inner = (group.column(c).to_pylist() for c in ("doc_id", "own", "inner"))
            sets = []
            texts = utf8(group.column("text"))
            for a, b in slices([len(x) for x in texts]):
                sets += shingle_sets(texts[a:b], width)
            del texts
            sides = None if inner[0] else own
            if not counted:
                rows = [(*x, None) for x in links_within(ids, sets, sides)]
            elif len(pairs := all_links_within(ids, sets, sides)):
                nodes, at = np.unique(pairs, return_inverse=True)
                a, b = at.reshape(-1, 2).T
                weight = dict(zip(ids, group.column("copies").to_pylist(), strict=True))
                weight = np.array([weight[i] for i in nodes.tolist()], dtype=np.int64)
                n = np.zeros(len(nodes), dtype=np.int64)
                np.add.at(n, a, weight[b])
                np.add.at(n, b, weight[a])
                rows = [(*x, None) for x in forest(pairs).tolist()] + [(i, None, k) for i, k in zip(nodes.tolist(), n.tolist(), strict=True)]
            else:
                rows = []
            if rows:
                yield _batch(rows, ["a", "b", "n"], [pa.int64()] * 3)

    # sets of the largest units first would need a sort by size; a unit is bounded by two blocks instead
    return units.select("unit", "doc_id", "own", "inner", "copies", "text").repartition(partitions(spark, docs), "unit").sortWithinPartitions("unit").mapInArrow(tidy(verify), "a long, b long, n long")


def jaccard_components(documents: DataFrame, width: int = WIDTH, links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row, and n_links if links are asked for.

    n_links: the other documents that it links to, copies included. Every candidate pair is verified then; pairs are
    added up in their unit, as a group's pairs grow with the square of its size. An id must have one text for that.

    class_id: the smallest doc_id with an equal set. component_id: the smallest doc_id that links reach, itself
    included. A null or empty text, or one without words, has no shingles, links with nothing and is its own component;
    so is a row without links. Rows with equal ids are one document as far as their texts are equal. A null doc_id
    keeps its row, with null ids. An empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = keyed_texts(documents)
    known = docs.where("doc_id IS NOT NULL")
    digests = stored(set_digests(docs, width))
    full = digests.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # sets with copies alone meet their documents; kept apart, so that a group of very many copies can be split there
    least = [F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last"), *([F.count_distinct("doc_id").alias("copies")] if links else [])]
    low = stored(full.groupBy("d1", "d2", "n_shingles").agg(*least).where("class_id < last").drop("last"))
    classed = stored(full.join(low, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")))
    tokens = digests.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    copies = classed.where("doc_id <> class_id").select("doc_id")
    candidates = components(candidate_edges(known, tokens, copies, width))
    members = candidates.select(F.col("node").alias("doc_id"), "root").join(full.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    rest = digests.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    if not links:
        met = components(verified_edges(known, members, width))
        found = classed.join(met.select(F.col("node").alias("class_id"), "root"), "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"))
        return found.unionByName(rest)
    sizes = low.select("class_id", "copies")
    checked = stored(verified_edges(known, members, width, copies=sizes.withColumnRenamed("class_id", "doc_id")))
    met = components(checked.where("b IS NOT NULL").select("a", "b"))
    none = F.lit(None).cast("long")
    facts = met.select(F.col("node").alias("class_id"), "root", none.alias("n")).unionByName(checked.where("b IS NULL").select(F.col("a").alias("class_id"), none.alias("root"), "n"))
    facts = facts.unionByName(sizes.select("class_id", none.alias("root"), (F.col("copies") - 1).alias("n"))).groupBy("class_id").agg(F.min("root").alias("root"), F.sum("n").alias("n"))
    found = classed.join(facts, "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"))
    return found.unionByName(rest.withColumn("n_links", F.lit(0).cast("long")))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_jaccard with the number of links of each document."""
    return jaccard_components(table(spark, sf_dir, "documents"), links=True)
