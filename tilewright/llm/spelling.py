"""Spelling variants by a bit-sliced position index over the vocabulary.

1. Words are counted over all texts by built-in functions; a task sends each word once, with its count.
2. Dealing. Words of at least 6 code points that differ by one edit share their first three or their last three code
   points, so each word goes to the group of its prefix and to that of its suffix (a pair of equal prefixes counts in the
   first alone). Groups are kept apart by classes of length; a group of more than LETTERS letters is cut by hash into
   parts that meet two by two, so a prefix of a third of all words spreads over units of bounded size.
3. Index of a unit: for every position and letter the bitset of the words that have the letter there, and for every
   length that of its words. A query walks its letters once and holds four sets of words, 64 to an operation: those
   without an error yet (Z), and those with one replaced (S), one letter of the query too many (D) or one of the word too
   many (I), whose positions are shifted by one from then on:

       S = S & at[i] | Z & ~at[i]     D = D & at[i - 1] | Z     I = (I | Z) & at[i + 1]     Z = Z & at[i]

   with at[i] the words that have the query's i-th letter at position i. At its end, S of the query's length, D of one
   less, and I or Z of one more are the near words. All queries of a length walk together.
4. A unit sends for each query the number of near words and the best of them, never pairs. Chains of forms rise by a
   factor of RISE in count, so their ends are found in a few joins by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import partitions, stored, table, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences that a word has at least; how much more frequent a form is.
LEAST, OFTEN, RISE = 6, 5, 5
#: One of so many occurrences has lost a code point.
NOISE = 199
#: Letters of a part of a group.
LETTERS = 1 << 16
#: Queries that walk together.
TOGETHER = 1024
_ONE = np.uint64(1)


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): maximal runs of letters in all texts, A-Z in lower case, after the noise; see spelling_variants."""
    text = F.translate(F.coalesce(documents["text"].cast("string"), F.lit("")), UPPER, LOWER)
    # a run of fewer code points can't become a word
    runs = documents.select(F.coalesce(documents["doc_id"].cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{LEAST},}}"), F.lit(0))).alias("run"))
    coded = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("CAST(h % char_length(run) AS INT)")
    word = F.when(F.col("h") % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return coded.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


class PositionIndex:
    """Bitsets over words: at[i + 1, letter] of those with the letter at position i, of_length[n] of those of n letters."""

    def __init__(self, words: list[str], longest: int):
        arrays = [np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32) for w in words]
        sizes = np.array([len(a) for a in arrays])
        letters = np.concatenate(arrays)
        self.words, self.letters = words, np.unique(letters)
        width = (len(words) + 63) // 64
        which = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        longest = max(longest, int(sizes.max())) + 1
        # the letter after the last stands for those that no word has
        self.at = np.zeros((longest + 2, len(self.letters) + 1, width), dtype=np.uint64)
        np.bitwise_or.at(self.at, (place + 1, np.searchsorted(self.letters, letters), which >> 6), _ONE << (which & 63).astype(np.uint64))
        self.of_length = np.zeros((longest + 1, width), dtype=np.uint64)
        own = np.arange(len(words))
        np.bitwise_or.at(self.of_length, (sizes, own >> 6), _ONE << (own & 63).astype(np.uint64))

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) positions of the pairs that are one edit apart; the queries have one length."""
        n = len(queries[0])
        codes = np.frombuffer("".join(queries).encode("utf-32-le"), dtype=np.uint32).reshape(len(queries), n)
        letter = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letter = np.where(self.letters[letter] == codes, letter, len(self.letters))
        shape = (len(queries), self.at.shape[2])
        zero = np.full(shape, ~np.uint64(0))
        replaced, deleted, inserted = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        for i in range(n):
            before, here, after = (self.at[i + k, letter[:, i]] for k in range(3))
            replaced = replaced & here | zero & ~here
            deleted = deleted & before | zero
            inserted = (inserted | zero) & after
            zero = zero & here
        found = replaced & self.of_length[n] | deleted & self.of_length[n - 1] | (inserted | zero) & self.of_length[n + 1]
        q, block = np.nonzero(found)
        bits = (found[q, block][:, None] >> np.arange(64, dtype=np.uint64)) & _ONE
        row, bit = np.nonzero(bits)
        return q[row], block[row] * 64 + bit


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict[int, list]]]:
    """(kind, {role: [(word, n)]}) of each unit of rows sorted by unit."""
    last, held = None, {}
    for batch in batches:
        for kind, key, klass, index_part, query_part, role, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            unit = (kind, key, klass, index_part, query_part)
            if unit != last:
                if last:
                    yield last[0], held
                last, held = unit, {0: [], 1: []}
            held[role].append((word, n))
    if last:
        yield last[0], held


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): the number of words one edit away and the best of them, by count, then by code
    point; words of a stored table (word, n) without near ones have no row."""
    spark = words.sparkSession
    length = F.length("word")
    classed = lambda n: F.greatest(F.lit(0), F.floor(F.log2(n)) - 5).cast("int")
    sides = F.array(F.struct(F.lit("prefix").alias("kind"), F.substring("word", 1, 3).alias("key")), F.struct(F.lit("suffix").alias("kind"), F.substring("word", -3, 3).alias("key")))
    own = words.select("word", "n", F.explode(sides).alias("side"), classed(length).alias("klass")).select("word", "n", "side.*", "klass")
    asked = words.select("word", "n", F.explode(sides).alias("side"), F.explode(F.array_distinct(F.array(*(classed(length + k) for k in (-1, 0, 1))))).alias("klass")).select("word", "n", "side.*", "klass")
    group = ["kind", "key", "klass"]
    # letters on the larger side decide how many parts both sides are cut into
    size = stored(own.select(*group, length.alias("own"), F.lit(0).alias("asked")).unionByName(asked.select(*group, F.lit(0).alias("own"), length.alias("asked"))).groupBy(group).agg(F.greatest(F.ceil(F.sum("own") / LETTERS), F.ceil(F.sum("asked") / LETTERS)).cast("int").alias("parts"), F.sum("own").alias("letters")).where("letters > 0").drop("letters"))
    part, every = F.expr("CAST(pmod(xxhash64(word), parts) AS INT)"), F.expr("sequence(0, parts - 1)")
    index = own.join(size, group).select(*group, part.alias("index_part"), F.explode(every).alias("query_part"), F.lit(0).alias("role"), "word", "n")
    query = asked.join(size, group).select(*group, F.explode(every).alias("index_part"), part.alias("query_part"), F.lit(1).alias("role"), "word", "n")
    unit = [*group, "index_part", "query_part"]
    dealt = index.unionByName(query).repartition(partitions(spark, words), *unit).sortWithinPartitions(*unit, "role", "word")

    def run(batches):
        for kind, held in _units(batches):
            if not held[0] or not held[1]:
                continue
            names = [w for w, _ in held[0]]  # in order of code points, as UTF-8 sorts
            counts = np.array([n for _, n in held[0]])
            by_length: dict[int, list[str]] = {}
            for w, _ in held[1]:
                by_length.setdefault(len(w), []).append(w)
            index, out = PositionIndex(names, max(by_length)), []
            for same in by_length.values():
                for k in range(0, len(same), TOGETHER):
                    queries = same[k : k + TOGETHER]
                    q, w = index.near(queries)
                    if kind == "suffix" and len(q):
                        other = np.array([queries[a][:3] != names[b][:3] for a, b in zip(q.tolist(), w.tolist(), strict=True)])
                        q, w = q[other], w[other]
                    if len(q):
                        order = np.lexsort((w, -counts[w], q))
                        q, w = q[order], w[order]
                        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                        for f, m in zip(first.tolist(), np.diff(first, append=len(q)).tolist(), strict=True):
                            out.append((queries[q[f]], m, int(counts[w[f]]), names[w[f]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near"])

    found = dealt.mapInArrow(tidy(run), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("low"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.low")).alias("near_n"), F.col("best.near").alias("near"))


def ends(links: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, root) whose roots may be words themselves: the last of each chain. Chains
    must not circle; each round doubles the steps that are covered and is written to the shared folder."""
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = stored(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = met.select("word", "root")
        if not met.where("moved").limit(1).count():
            return links


def spelling_variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of documents.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z in lower case; where NOISE divides the crc32 of
    `<doc_id>:<run>`, the run loses the code point crc32 % length. Words are results of at least LEAST code points that
    occur OFTEN times. A form is the near word of the largest n, the smallest of equals, if its n is RISE times the
    word's; root is the last of the chain of forms. Null and empty texts have no runs; a null doc_id counts as empty text;
    repeated rows count as often as they stand. An empty table gives no words. Other columns are never read.
    """
    words = stored(vocabulary(documents))
    met = stored(words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("near_n") >= RISE * F.col("n"), F.col(c)).alias(to) for c, to in (("near", "form"), ("near_n", "form_n")))))
    roots = ends(stored(met.where("form IS NOT NULL").select("word", F.col("form").alias("root"))))
    return met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def _sql() -> str:
    from tilewright.llm.merkle import CRC_SQL, crc_sql

    return rf"""
WITH RECURSIVE {CRC_SQL},
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc, run, count(*) AS m FROM o WHERE length(run) >= {LEAST} GROUP BY doc, run),
h AS (SELECT run, m, {crc_sql("doc || ':' || run")} AS h FROM c, crc_table),
w AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, m FROM h),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(m) >= {OFTEN}),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM g),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM less a JOIN v ON v.word = a.rest
  UNION SELECT v.word, a.word, a.n FROM less a JOIN v ON v.word = a.rest),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
pick AS (SELECT near.word, min(other) AS near, any_value(most) AS most, any_value(n_near) AS n_near FROM near JOIN best ON best.word = near.word AND near.n = best.most GROUP BY near.word),
r AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RISE} * v.n THEN near END AS form, CASE WHEN most >= {RISE} * v.n THEN most END AS form_n FROM v LEFT JOIN pick ON pick.word = v.word),
chain AS (SELECT word, word AS root FROM r UNION ALL SELECT chain.word, r.form FROM chain JOIN r ON r.word = chain.root WHERE r.form IS NOT NULL),
top AS (SELECT chain.word, chain.root FROM chain JOIN r ON r.word = chain.root WHERE r.form IS NULL)
SELECT r.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM r JOIN top ON top.word = r.word
"""


#: The same in SQL, with near words by the texts that are left when each code point is taken away.
OP13_SQL = _sql()
