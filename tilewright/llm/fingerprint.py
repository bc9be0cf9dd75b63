"""Document fingerprints from improbable features.

Every window of WINDOW bytes has an entropy. Entropies are ranked by how rare they are over all windows of all
documents, rarest first; flat windows (few distinct bytes) have no rank. In every run of RUN windows the leftmost of the
best rank scores a point, and windows of MIN_POINTS points are the features. Each sets HASHES bits of a Bloom filter of
BITS bits; after PER_FILTER features the next filter of the chain begins. Two chains are compared by the overlap of
bits, less what chance gives, as a share of the most that is possible.

Whole batches are handled as one array of bytes: window entropies are running sums of what the entering and the leaving
byte change, in whole numbers, so equal windows have equal entropies wherever they stand.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import keyed_texts, partitions, small_batches, stored, table, tidy, utf8
from tilewright.llm.shingles import mix, slices

#: RUN is WINDOW at most.
WINDOW, RUN, MIN_POINTS = 32, 32, 8
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Classes of entropy; windows below FLAT of them have no rank.
CLASSES, FLAT = 1024, 128
_SCALE = 1 << 16
_N = np.arange(WINDOW + 1)
#: count -> c log2 c, scaled to whole numbers
_TERM = np.rint(np.concatenate([[0.0], _N[1:] * np.log2(_N[1:])]) * _SCALE).astype(np.int64)
_STEP = np.append(np.diff(_TERM), 0)
_MOST = _TERM[WINDOW]
_U = np.uint64
_NO_RANK = np.int64(1) << 40


def window_classes(data: np.ndarray) -> np.ndarray:
    """Entropy class (0 to CLASSES - 1) of each window of an array of bytes."""
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    before, after = np.zeros(len(data), dtype=np.uint8), np.zeros(len(data), dtype=np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    first = _TERM[np.bincount(data[:WINDOW], minlength=256)].sum()
    # window i + 1 is window i without byte i and with byte i + WINDOW
    sums = np.empty(n, dtype=np.int64)
    sums[0] = first
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[after[: n - 1]], out=sums[1:])
    sums[1:] += first
    return ((_MOST - sums) * (CLASSES - 1)) // _MOST


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, window classes, mask of the windows that lie within one text)."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    classes = window_classes(data)
    inside = np.ones(len(classes), dtype=bool)
    edges = np.cumsum([len(t) for t in texts])[:-1]
    for k in range(1, WINDOW):
        at = edges - k
        inside[at[(at >= 0) & (at < len(inside))]] = False
    return data, classes, inside


def class_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each class of entropy."""

    def run(batches):
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in slices([len(t) for t in texts]):
                _, classes, inside = _joined(texts[a:b])
                total += np.bincount(classes[inside], minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["class", "n"])

    out = np.zeros(CLASSES, dtype=np.int64)
    for k, n in docs.mapInArrow(tidy(run), "class long, n long").groupBy("class").agg(F.sum("n")).collect():
        out[k] = n
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each class, rarest first; classes of one count in order; flat and unseen ones have none."""
    ranks = np.full(CLASSES, _NO_RANK, dtype=np.int64)
    order = np.lexsort((np.arange(CLASSES), counts))
    order = order[(counts[order] > 0) & (order >= FLAT)]
    ranks[order] = np.arange(len(order))
    return ranks


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """For each text the hashes of its features in order, each once; a flat text has
    its whole as the only one, a text of less than WINDOW bytes its runs of four bytes."""
    data, classes, inside = _joined(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    chosen = np.zeros(0, dtype=np.int64)
    if len(classes):
        keys = np.where(inside, ranks[classes], 2 * _NO_RANK)
        keys = np.where(keys >= _NO_RANK, np.int64(1) << 62, keys << 32 | np.arange(len(keys)))
        # the least of each run, by doubling; WINDOW - 1 windows across an edge keep runs of neighbours apart, and runs
        # at the ends of a text have fewer windows
        low = np.pad(keys, RUN - 1, constant_values=np.int64(1) << 62)
        run = 1
        while run < RUN:
            step = min(run, RUN - run)
            low = np.minimum(low[: len(low) - step], low[step:])
            run += step
        low = low[low < np.int64(1) << 62]
        points = np.bincount(low & np.int64(0xFFFFFFFF), minlength=1)
        chosen = np.flatnonzero(points >= MIN_POINTS)
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[chosen].view(_U) if len(chosen) else np.zeros((0, WINDOW // 8), dtype=_U)
    hashes = np.full(len(chosen), _U(0x243F6A8885A308D3))
    for k in range(WINDOW // 8):
        hashes = mix(hashes * _U(0x2545F4914F6CDD1D) + words[:, k])
    cut = np.searchsorted(chosen, np.append(starts, ends[-1] if len(ends) else 0))
    out = []
    for i, text in enumerate(texts):
        own = hashes[cut[i] : np.searchsorted(chosen, ends[i])]
        if len(own):
            _, first = np.unique(own, return_index=True)
            out.append(own[np.sort(first)])
        else:
            pieces = [text] if len(text) < 4 or len(text) >= WINDOW else dict.fromkeys(text[i : i + 4] for i in range(len(text) - 3))
            out.append(np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8).digest() for p in pieces), dtype=_U))
    return out


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, one row of BITS / 8 bytes for each PER_FILTER features."""
    rows = max(1, -(-len(hashes) // PER_FILTER))
    bits = np.zeros((rows, BITS), dtype=bool)
    row = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[row, ((hashes >> _U(11 * k)) & _U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best of the other, weighed by its bits. Symmetric."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a

    def one_way(x, y):
        nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
        got, weight = 0.0, 0
        for i in range(len(x)):
            both = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
            chance = nx[i] * ny / BITS
            most = np.minimum(nx[i], ny)
            share = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0)
            # a filter that is larger can hold a smaller one by chance of size alone: weigh by the sizes' ratio
            got += nx[i] * float((share * np.sqrt(most / np.maximum(nx[i], ny))).max())
            weight += int(nx[i])
        return got / max(1, weight)

    return one_way(a, b) if len(a) < len(b) else (one_way(a, b) + one_way(b, a)) / 2


def _text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def corpus_ranks(documents: DataFrame) -> np.ndarray:
    """The table of ranks that fingerprints of this corpus share."""
    small_batches(documents.sparkSession)
    return ranks_of(class_counts(keyed_texts(documents)))


def fingerprints(documents: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) of every row, of whole texts; null counts as empty."""
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            out = [_text_of(filters(h)) for a, b in slices([len(t) for t in texts]) for h in features(texts[a:b], ranks)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return keyed_texts(documents).mapInArrow(tidy(run), "doc_id long, fingerprint string")


def compare(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return likeness(*(np.frombuffer(base64.b64decode(x), dtype=np.uint8).reshape(-1, BITS // 8) for x in (a, b)))


def _cuts(ids: DataFrame, parts: int, fine: int = 8) -> list[tuple[int, int]]:
    """Bounds (k, h) that cut rows (k, h, n) into ranges of about equal sums of n, fewer than parts; a row is in the range
    after the bounds that are below it.

    Quantiles of k cut the rows fine times as often; a k that spans several of those is cut by h, which is uniform. Their
    sums come to the driver, and neighbours are joined.
    """
    wanted = parts * fine
    marks = ids.agg(F.percentile_approx("k", [i / wanted for i in range(1, wanted)], 100 * wanted)).first()[0] or []
    heavy = {k for k, j in zip(marks, marks[1:], strict=False) if k == j}
    bounds = []
    for k in sorted(set(marks)):
        step = (1 << 64) // max(1, marks.count(k))
        bounds += [(k - 1, (1 << 63) - 1), *((k, -(1 << 63) + i * step) for i in range(1, marks.count(k)))] if k in heavy and k > -(1 << 63) else []
        bounds.append((k, (1 << 63) - 1))
    sums = dict(ids.groupBy(_lot_of(bounds).alias("lot")).agg(F.sum("n")).collect())
    target, held, cuts = max(1, sum(sums.values())) / parts, 0, []
    for at, bound in enumerate(bounds):
        held += sums.get(at, 0)
        if held >= target and len(cuts) < parts - 1:
            cuts.append(bound)
            held = 0
    return cuts


def _lot_of(cuts: list[tuple[int, int]]):
    """How many cuts are below (k, h), by two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [[{"k": k, "h": h} for k, h in cuts[i : i + step]] for i in range(0, len(cuts), step)]
    here = F.struct(F.col("k"), F.col("h"))
    below = lambda bounds: F.size(F.filter(bounds, lambda c: c < here))
    coarse = below(_constant([g[-1] for g in groups], _PLACES))
    fine = below(F.get(_constant(groups, f"array<{_PLACES}>"), coarse))
    return F.least(coarse * step + F.when(coarse < len(groups), fine).otherwise(0), F.lit(len(cuts))).cast("int")


_PLACES = "array<struct<k:bigint,h:bigint>>"


def _constant(value: list, kind: str):
    """A list as one constant of the plan: the plan has as many nodes for ten thousand bounds as for ten."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _tasks(spark: SparkSession, parts: int, lots: int) -> list[int]:
    """For each lot a number that hash partitioning deals to a partition of its own."""
    found: dict[int, int] = {}
    for i, at in spark.range(parts * 24).select(F.col("id").cast("int"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))).collect():
        found.setdefault(at, i)
    free = list(found.values())
    return [free[k % len(free)] for k in range(lots)]


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text: the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's, by descending doc_id; after the last comes the first. Rows of one doc_id follow each other by a hash of
    the text; a null id comes last; a table of one row is its own next. A null text is empty. Other columns are ignored.

    Texts move once: rows are dealt into ranges of (doc_id, hash) of about equal bytes, each a task's own, and the first
    row of each range goes to the range before it as well. Many rows of one id, or without id, are several ranges. Only
    the cuts, and each range's first id, come to the driver: as many as partitions, of which there are MAX_PARTS at most.
    They go into the plan as constants of a few bytes a range, as the bounds of any range partitioning do.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = keyed_texts(documents)
    ranks = ranks_of(class_counts(docs))
    parts = partitions(spark, documents)
    # lowest ids last: order by the complement of the id, so that ranges ascend; the sign of h puts null after the lowest
    top, hashed = (1 << 63) - 1, F.xxhash64("text")
    own = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(hashed, 1)).when(F.col("doc_id") == -top - 1, hashed.bitwiseOR(F.lit(-top - 1))).otherwise(hashed)
    place = {"k": F.coalesce(F.bitwise_not("doc_id"), F.lit(top)), "h": own}
    ids = stored(docs.select(*(v.alias(c) for c, v in place.items()), F.octet_length("text").cast("long").alias("n")))
    cuts = _cuts(ids, parts)
    lot = _lot_of(cuts)
    firsts = {r["lot"]: (r["f"]["k"], r["f"]["h"]) for r in ids.groupBy(lot.alias("lot")).agg(F.min(F.struct("k", "h")).alias("f")).collect()}
    used = sorted(firsts)
    # the lot that each lot's first row also goes to: the one before, from the first lot to the last
    before = {at: used[i - 1] for i, at in enumerate(used)}
    first = _constant([dict(zip("kh", firsts.get(at, (None, None)), strict=True)) for at in range(len(cuts) + 1)], _PLACES)
    goes = _constant([before.get(at, at) for at in range(len(cuts) + 1)], "array<int>")
    rows = docs.withColumns(place).withColumn("lot", lot)
    copy = F.struct(F.get(goes, F.col("lot")).alias("lot"), F.lit(1).alias("extra"))
    own = F.struct(F.col("lot"), F.lit(0).alias("extra"))
    to = F.when(F.get(first, F.col("lot")) == F.struct("k", "h"), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.withColumn("to", F.explode(to)).select(F.col("to.lot").alias("lot"), F.col("to.extra").alias("extra"), "k", "h", "doc_id", "text")
    dealt = dealt.withColumn("task", F.get(_constant(_tasks(spark, parts, len(cuts) + 1), "array<int>"), F.col("lot"))).repartition(parts, "task").drop("task").sortWithinPartitions("lot", "extra", "k", "h", "text")

    def pairs(batches) -> Iterator[list[tuple[int | None, str, str]]]:
        """(doc_id, text, next text), a few megabytes at a time."""
        last, ended, out, size = None, None, [], 0
        for batch in batches:
            for at, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("lot", "extra", "doc_id", "text")), strict=True):
                if last is not None and last[0] == at and ended != at:
                    out.append((last[1], last[2], text))
                    size += len(last[2])
                    ended = at if extra else ended
                if not extra:
                    last = (at, doc_id, text)
                if size > 1 << 20:
                    yield out
                    out, size = [], 0
        if out:
            yield out

    def run(batches):
        for group in pairs(batches):
            whole = [t for _, t, _ in group]
            edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for _, t, n in group]
            raw = [t.encode() for t in edited]
            out = []
            own = [filters(h) for h in features([t.encode() for t in whole], ranks)]
            changed = [filters(h) for h in features(raw, ranks)]
            last = filters(features([group[-1][2].encode()], ranks)[0])
            for i, (doc_id, text, _) in enumerate(group):
                follows = own[i + 1] if i + 1 < len(group) and group[i][2] == whole[i + 1] else last if i + 1 == len(group) else filters(features([group[i][2].encode()], ranks)[0])
                out.append((doc_id, len(text), hashlib.sha256(raw[i]).hexdigest(), _text_of(own[i]), _text_of(changed[i]), likeness(own[i], changed[i]), likeness(own[i], follows)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_fingerprint that SQL can make too."""
    return op2_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


FINGERPRINT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(nxt, 1, length(t) // 3)) AS edited_sha256 FROM n
"""
