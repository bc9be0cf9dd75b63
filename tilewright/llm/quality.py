"""Quality by importance resampling with hashed n-gram models.

Tokens are runs of letters and digits, or of other signs, lower-cased. Single tokens and pairs are hashed into BUCKETS
buckets. The target model is fitted on documents labelled good, the raw model counts every document. A document's
importance weight is the ratio of the two generative models: its log is the sum of log ratios over the n-grams. So a
short text stays near 0, and a long one weighs as much as its wording says.

Resampling without replacement is a Gumbel top-k: a standard Gumbel variable, a function of the document's id and a
seed, is added to log weight / TEMPERATURE, and the k largest keys are kept. k is a parameter; without it, k is the number
of documents whose log weight reaches what all but MISSED of the good training documents reach under a model that they
weren't in. The k-th key is found by histograms that close in on it, not by a global sort.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import batches_by_key, beside, held_out, keyed_texts, small_batches, stored, table, tidy, trim, utf8
from tilewright.llm.shingles import _BYTE, _Powers, mix, slices

BUCKETS, PARTS = 1 << 16, 16
#: Bounds of the training sample: good documents, poor ones, and characters of a document.
SAMPLE, SAMPLE_CHARS = 4000, 20_000
#: Share of good training documents that may fall below the cut, what log weights are divided by, counts added to each bucket.
MISSED, TEMPERATURE, ADDED = 0.001, 1.0, 1.0
#: Parts of the training sample, each scored under the model of the others.
FOLDS = 8
_U = np.uint64
#: The bucket of a token that follows itself. Repetition is the commonest sign of degenerate text; single pairs of equal
#: tokens are too rare to be learned, their class isn't.
REPEAT = _U(0x5851F42D4C957F2D)
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[95] = _CLASS[128:] = 1


def ngram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of n-grams of each text): each text's tokens, then its pairs of neighbours."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    kind = _CLASS[joined]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], edge])
    ends = np.concatenate([edge, [len(joined)]])
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    up, down = _Powers.get(len(joined) + 1)
    total = np.zeros(len(joined) + 1, dtype=_U)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    pairs = mix(hashes[:-1] * _U(0x2545F4914F6CDD1D) + hashes[1:]) if len(hashes) else hashes
    pairs[hashes[:-1] == hashes[1:]] = REPEAT  # a token twice in a row is one kind of pair, whatever the token
    owner = np.repeat(np.arange(len(texts)), counts)
    within = owner[1:] == owner[:-1]
    n_pairs = np.maximum(counts - 1, 0)
    order = np.argsort(np.concatenate([owner, owner[1:][within]]), kind="stable")
    return (np.concatenate([hashes, pairs[within]])[order] & _U(BUCKETS - 1)).astype(np.int64), counts + n_pairs


def raw_counts(docs: DataFrame) -> np.ndarray:
    """N-grams of all documents in each bucket; BUCKETS numbers come to the driver."""

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in slices([len(t) for t in texts]):
                total += np.bincount(ngram_buckets(texts[a:b])[0], minlength=BUCKETS)
        for k, part in enumerate(np.split(total, PARTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    def add(batches):
        for group in batches_by_key(batches, "part"):
            total = sum(np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in group.column("counts").to_pylist())
            yield pa.RecordBatch.from_arrays([group.column("part").combine_chunks().slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for k, x in docs.mapInArrow(tidy(count), "part int, counts binary").repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(tidy(add), "part int, counts binary").collect():
        out[k * (BUCKETS // PARTS) : (k + 1) * (BUCKETS // PARTS)] = np.frombuffer(x, dtype=np.int64)
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket. The raw model is drawn to the target's size before counts are
    added, so that buckets of few target n-grams tend to 0."""
    t = target + ADDED
    r = raw * (max(1, target.sum()) / max(1, raw.sum())) + ADDED
    return np.log(t / t.sum()) - np.log(r / r.sum())


def log_weights(texts: list[bytes], ratios: np.ndarray) -> np.ndarray:
    """Sum of the log ratios of each text's n-grams; 0 without n-grams. Each text is summed by itself, so that its weight
    is the same whatever else is in its batch."""
    out = []
    for a, b in slices([len(t) for t in texts]):
        buckets, counts = ngram_buckets(texts[a:b])
        sums, own = np.zeros(len(counts)), counts > 0
        if own.any():
            sums[own] = np.add.reduceat(ratios[buckets], (np.cumsum(counts) - counts)[own])
        out.append(sums)
    return np.concatenate(out) if out else np.zeros(0)


def fitted(sample: list[bytes], raw: np.ndarray) -> tuple[np.ndarray, float]:
    """(log ratios, cut): the cut is what all but MISSED of the sample reach when the target model is fitted on the other
    folds, as new documents would."""
    if not sample:
        return np.zeros(BUCKETS), -1.0
    folds = []
    for k in range(FOLDS):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for a, b in slices([len(t) for t in sample[k::FOLDS]]):
            counts += np.bincount(ngram_buckets(sample[k::FOLDS][a:b])[0], minlength=BUCKETS)
        folds.append(counts)
    whole = np.sum(folds, axis=0)
    crossed = np.concatenate([log_weights(sample[k::FOLDS], log_ratios(whole - f, raw)) for k, f in enumerate(folds)])
    return log_ratios(whole, raw), float(np.quantile(crossed, MISSED))


def good_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[bytes]:
    """Texts of labelled good documents that aren't held out: at most sample, the first by a hash of the id, of at most
    SAMPLE_CHARS characters each."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality = 1").where(~held_out())
    picked = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = keyed_texts(documents).where((F.length("text") <= SAMPLE_CHARS) & (F.length("text") > 0)).join(F.broadcast(picked), "doc_id")
    return sorted(r["text"].encode() for r in texts.select("text").collect())


def kth_key(scored: DataFrame, k: int, bins: int = 4096, few: int = 4096) -> tuple[float, int]:
    """(the k-th largest key, the least tie that is kept): rows above, and rows at it from that tie on, are k.

    Each round counts keys in bins between two bounds and closes in on the bin that holds the k-th; when it has few rows
    or one value, these are sorted. Rows with equal keys and ties count alike.
    """
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            break
        at = F.least(F.greatest(F.floor((F.col("key") - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
        counts = dict(scored.where(F.col("key").between(low, high)).groupBy(at.alias("b")).agg(F.count("*")).collect())
        total, chosen = above, None
        for b in sorted(counts, reverse=True):
            if total + counts[b] >= k:
                chosen = b
                break
            total += counts[b]
        inside = scored.where(F.col("key").between(low, high) & (at == chosen))
        n = counts[chosen]
        above = total
        if n <= few:
            rows = inside.select("key", "tie").orderBy(F.desc("key"), F.desc("tie")).limit(few).collect()
            return rows[k - above - 1]["key"], rows[k - above - 1]["tie"]
        low, high = inside.agg(F.min("key"), F.max("key")).first()
    # one value is left: ties decide, bin by bin in the same way
    at_value = scored.where(F.col("key") == low)
    need, t_low, t_high = k - above, -(1 << 63), (1 << 63) - 1
    while t_low < t_high:
        middle = (t_low + t_high) // 2
        n = at_value.where((F.col("tie") > middle) & (F.col("tie") <= t_high)).count()
        if n >= need:
            t_low = middle + 1
        else:
            need -= n
            t_high = middle
    return low, t_low


def _key(doc_id: Column, temperature: float, seed: int) -> tuple[Column, Column]:
    """(key, tie) of a row: its log weight by temperature, and a standard Gumbel variable from 53 bits of a hash of the
    id and seed, never 0 or 1."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed), F.lit("noise")), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col("log_weight") / F.lit(float(temperature)) - F.log(-F.log(uniform)), F.xxhash64(doc_id, F.lit(seed), F.lit("tie"))


def top_k(scored: DataFrame, k: int) -> Column:
    """Whether a row of (key, tie) is among the k of the largest keys; rows of one key and tie stay together."""
    if k < 1:
        return F.lit(False)
    last, least = kth_key(scored, k)
    return (F.col("key") > last) | ((F.col("key") == last) & (F.col("tie") >= least))


def weighed(documents: DataFrame, labels: DataFrame, keep: bool = False, k: int | None = None, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """(doc_id, log_weight, key, kept) of every row, and with keep row, the whole row as a struct.

    k: rows to keep (all if there are fewer); None: as many as reach the cut. A null or empty text has log weight 0.
    Noise depends on doc_id and seed alone, so reruns agree; rows with equal keys are told apart by a hash of the id.
    Without labelled good documents every log weight is 0 and, without k, all are kept. Null ids count as one id. An
    empty table gives an empty result; other columns are ignored.
    """
    small_batches(documents.sparkSession)
    docs = keyed_texts(documents)
    sample = good_sample(documents, labels)
    ratios, cut = fitted(sample, raw_counts(docs) if sample else np.zeros(BUCKETS))
    trim()
    weights = lambda texts: [log_weights([t.encode() for t in texts], ratios).tolist()]
    doc_id = F.col("row")[documents.select(documents["doc_id"]).columns[0]].cast("long")
    rows = beside(documents, "log_weight double", weights)
    key, tie = _key(F.col("doc_id"), temperature, seed)
    scored = stored(rows.select(doc_id.alias("doc_id"), "log_weight").select("doc_id", "log_weight", key.alias("key"), tie.alias("tie")))
    n, reached = scored.agg(F.count("*"), F.count_if(F.col("log_weight") >= cut)).first()
    kept = top_k(scored, min(n, reached if k is None else k))
    if keep:  # weights are made again beside the rows: cheaper than moving texts to meet them
        scored = rows.withColumn("doc_id", doc_id).withColumns({"key": key, "tie": tie})
    return scored.select("doc_id", "log_weight", "key", kept.alias("kept"), *["row"] * keep)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighed(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
