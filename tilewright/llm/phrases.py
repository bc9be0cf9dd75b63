"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions alone.

1. Index. Every place of a term of the test set in the training texts is a posting (term, doc, digest, pos). Each task
   writes the postings of its own texts, sorted by term: the index is dealt by document, so nothing moves to build it,
   and a list is as long as the term's count. Terms that no test text has are never asked for and aren't stored.
2. Plan. A window is 10 consecutive words of a test text (a shorter text is one window). List lengths order the terms of
   each window; the three rarest distinct ones are its plan. Windows that slide over one text share most plans.
3. Intersection. Postings of the rarest term p1 meet postings of the second and the third in the same document within
   SPAN words: the lists meet on (doc, term, bin of the position), and what is left of a pair of lists is one mask of
   offsets for each p1. A plan whose terms all have a mask is a proximity match; one whose masks hold the offsets that the
   terms have in the test text puts the text's first word at p1 - offset, its diagonal.
4. Phrases. On each diagonal all words of the test text meet the index at (doc, pos, term). A run of as many consecutive
   words as a window has is an exact occurrence; runs become intervals of words, intervals the words that are hit.

A document is (doc_id, 64-bit hash of id and text), so different texts of one id stay apart; rows that repeat whole
are indexed once and each gets the result. Terms are broadcast up to BROADCAST_ROWS rows, likewise documents with a
diagonal; beyond that both sides are shuffled. Test texts that are equal word for word are one passage with many item_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import stored, table

#: Words of a window; words between the rarest term and the next ones in a proximity match.
WINDOW, SPAN = 10, 15
#: Positions of a bin when lists meet; a span reaches the neighbouring bins and no further.
BIN = 16
#: Rows of a side up to which it is broadcast: at most some 100 MB of keys.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that isn't in lower case yet.
WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOC = ["doc", "digest"]


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none of null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def bounded(side: DataFrame) -> DataFrame:
    """side, a stored table, with a broadcast hint if its rows are few enough."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, digest, text): what tells documents apart; a null doc_id differs from 0 by its digest."""
    doc_id, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("doc"), F.xxhash64(doc_id, text).alias("digest"), text.alias("text"))


def once(docs: DataFrame) -> DataFrame:
    """Each document of keyed() once. Texts of rows that repeat whole move, after a reduction within tasks; others don't."""
    repeated = stored(docs.groupBy(DOC).count().where("count > 1").select(DOC))
    n = repeated.count()
    if not n:
        return docs
    side = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    return docs.join(side, DOC, "left_anti").unionByName(docs.join(side, DOC, "left_semi").groupBy(DOC).agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text")).select(docs.columns))


def passages_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages (passage, words, n), items (item_id, passage)) of a test set; texts without words have none."""
    read = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"), F.array_join(words_of(benchmark["text"]), " ").alias("phrase")).where("phrase <> ''").distinct()
    passages = stored(read.select("phrase").distinct().withColumn("passage", F.monotonically_increasing_id()))
    items = stored(read.join(passages, "phrase").select("item_id", "passage"))
    return passages.select("passage", F.split("phrase", " ").alias("words")).withColumn("n", F.size("words")), items


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings (term, doc, digest, pos) of terms (word, term) in docs of keyed(), by document, sorted by term."""
    places = docs.select(*DOC, F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return stored(places.join(bounded(terms), "word").select("term", *DOC, "pos").sortWithinPartitions("term", *DOC, "pos"))


def plans(tokens: DataFrame, lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """(passage, at1, term1, at2, term2, at3, term3) of the windows of tokens (passage, n, at, word, term): the rarest
    distinct terms by lengths (term, count), ties by word; a window of fewer terms has nulls. Windows with a term that
    the index lacks match nothing and have no plan."""
    counted = tokens.join(lengths, "term", "left")
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - window + 1), F.greatest(F.least(F.col("at"), F.col("n") - window), F.lit(0)))
    spread = counted.select("passage", "at", "word", "term", "count", F.explode(starts).alias("start"))
    each = spread.groupBy("passage", "start", "term", "word", "count").agg(F.min("at").alias("at"))
    ranked = each.groupBy("passage", "start").agg(F.sort_array(F.collect_list(F.struct("count", "word", "term", "at"))).alias("by_count"), F.count_if(F.col("count").isNull()).alias("absent")).where("absent = 0")
    kth = [F.get("by_count", F.lit(k)) for k in range(3)]
    return ranked.select("passage", *(c for k in range(3) for c in (kth[k]["at"].alias(f"at{k + 1}"), kth[k]["term"].alias(f"term{k + 1}")))).distinct()


def offsets(index: DataFrame, pairs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc, digest, pos, term1, term2, mask) of pairs (term1, term2): bit p2 - pos + span of the mask is set if term2
    stands at p2 and term1 at pos, no more than span words apart."""
    if span >= BIN or span > 31:
        raise ValueError("a span must reach no further than the neighbouring bins")
    some = lambda terms: index.join(bounded(stored(terms.distinct())), "term")
    left = some(pairs.select(F.col("term1").alias("term"), "term2")).select(*DOC, F.col("pos").alias("p1"), F.col("term").alias("term1"), "term2", F.explode(F.array(*(F.floor(F.col("pos") / BIN).cast("int") + k for k in (-1, 0, 1)))).alias("bin"))
    right = some(pairs.select(F.col("term2").alias("term"))).select(*DOC, "pos", F.col("term").alias("term2"), F.floor(F.col("pos") / BIN).cast("int").alias("bin"))
    met = left.join(right, [*DOC, "term2", "bin"]).where(F.abs(F.col("pos") - F.col("p1")) <= span)
    bit = F.expr(f"shiftleft(1L, pos - p1 + {span})")
    return met.groupBy(*DOC, "p1", "term1", "term2").agg(F.bit_or(bit).alias("mask")).withColumnRenamed("p1", "pos")


def matches(index: DataFrame, plan: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc, digest, passage, diagonal) of the proximity matches of plans; diagonal, the place of the passage's first
    word, is null unless the terms stand as far from each other as in the passage."""
    plan = stored(plan)
    pairs = plan.select("term1", F.explode(F.array("term2", "term3")).alias("term2")).where("term2 IS NOT NULL").distinct()
    masks = offsets(index, pairs, span).groupBy(*DOC, "pos", "term1").agg(F.map_from_entries(F.collect_list(F.struct("term2", "mask"))).alias("masks"))
    lone = index.join(bounded(stored(plan.where("term2 IS NULL").select(F.col("term1").alias("term")).distinct())), "term").select(*DOC, "pos", F.col("term").alias("term1"), F.lit(None).cast("map<bigint,bigint>").alias("masks"))
    side = bounded(plan)
    met = masks.join(side.where("term2 IS NOT NULL"), "term1").unionByName(lone.join(side.where("term2 IS NULL"), "term1"))
    near = [F.col(f"term{k}").isNull() | F.expr(f"masks[term{k}] IS NOT NULL") for k in (2, 3)]
    here = [F.col(f"term{k}").isNull() | F.expr(f"shiftright(masks[term{k}], at{k} - at1 + {span}) & 1 = 1") for k in (2, 3)]
    return met.where(near[0] & near[1]).select(*DOC, "passage", F.when(here[0] & here[1], F.col("pos") - F.col("at1")).alias("diagonal")).distinct()


def occurrences(index: DataFrame, tokens: DataFrame, diagonals: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, digest, passage, first, last): the runs of words on diagonals (doc, digest, passage, diagonal) that hold a
    window of tokens (passage, n, at, word, term), from word first to word last of the document."""
    there = index.join(bounded(stored(diagonals.select(DOC).distinct())), DOC)
    asked = diagonals.join(bounded(tokens), "passage").select(*DOC, "passage", "n", "at", "term", (F.col("diagonal") + F.col("at")).alias("pos")).where("pos >= 0")
    found = asked.join(there, [*DOC, "pos", "term"]).select(*DOC, "passage", "n", "at", "pos").withColumn("diagonal", F.col("pos") - F.col("at"))
    along = Window.partitionBy(*DOC, "passage", "n", "diagonal").orderBy("at")
    runs = found.withColumn("run", F.col("at") - F.row_number().over(along)).groupBy(*DOC, "passage", "n", "diagonal", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(window))).select(*DOC, "passage", "first", "last")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every row of documents.

    n_hit: words inside any occurrence of a window; n_items: items with an occurring window, items_sha256 of their ids
    as strings, sorted and joined by commas; n_near: items with a proximity match. A null or empty text has no words and
    no hit; a null item_id counts as an empty one; items that share an id are one item; an empty benchmark hits nothing,
    an empty table of documents gives no row. Rows that repeat whole, and rows of one id with different texts, each get
    their own result; the former count once in the lengths of lists. Other columns of the tables are never read.
    """
    docs = keyed(documents)
    passages, items = passages_of(benchmark)
    each = stored(passages.select("passage", "n", F.posexplode("words").alias("at", "word")))
    terms = stored(each.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    tokens = stored(each.join(terms, "word"))
    index = build_index(once(docs), terms)
    lengths = stored(index.groupBy("term").count())
    met = stored(matches(index, plans(tokens, lengths, window), span))
    runs = stored(occurrences(index, tokens, met.where("diagonal IS NOT NULL"), window))
    before = Window.partitionBy(DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.select(*DOC, "first", "last").distinct().withColumn("from", F.greatest(F.col("first"), F.coalesce(F.max("last").over(before) + 1, F.col("first"))))
    hit = spans.groupBy(DOC).agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.col("from") + 1)).alias("n_hit"))
    named = lambda rows: rows.select(*DOC, "passage").distinct().join(items, "passage").select(*DOC, "item_id").distinct()
    listed = named(runs).groupBy(DOC).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    close = named(met).groupBy(DOC).agg(F.count("*").alias("n_near"))
    found = close.join(listed, DOC, "left").join(hit, DOC, "left")
    light = docs.select("doc_id", *DOC, F.regexp_count("text", F.lit(WORD_RAW)).cast("long").alias("n_words"))
    whole = light.join(found, DOC, "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.select("doc_id", "n_words", number("n_hit"), number("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), number("n_near"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same in SQL, by equality of joined words for the windows and by places for proximity.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, row_number() OVER () AS b, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT b, item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT b, item_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM s),
lens AS (SELECT DISTINCT k FROM g), wanted AS (SELECT DISTINCT item_id, k, words FROM g),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, lens WHERE len(w) >= k),
hits AS (SELECT r, p, places.k, item_id FROM places JOIN wanted ON wanted.k = places.k AND words = array_to_string(w[p:p + places.k - 1], ' ')),
n_hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r),
t AS (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS p FROM d), f AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM (SELECT DISTINCT doc_id, w FROM d)) GROUP BY t),
own AS (SELECT DISTINCT b, item_id, i, unnest(w[i:i + k - 1]) AS t FROM s),
ranked AS (SELECT own.*, f.n, row_number() OVER (PARTITION BY b, i ORDER BY f.n, own.t) AS place, count(*) FILTER (f.n IS NULL) OVER (PARTITION BY b, i) AS absent FROM own LEFT JOIN f USING (t)),
plan AS (SELECT DISTINCT item_id, max(CASE WHEN place = 1 THEN t END) AS t1, max(CASE WHEN place = 2 THEN t END) AS t2, max(CASE WHEN place = 3 THEN t END) AS t3 FROM ranked WHERE absent = 0 GROUP BY item_id, b, i),
pairs AS (SELECT DISTINCT t1, t2 FROM (SELECT t1, t2 FROM plan UNION ALL SELECT t1, t3 FROM plan) WHERE t2 IS NOT NULL),
one AS (SELECT t.*, pairs.t2 FROM t JOIN pairs ON t = t1),
close AS (SELECT DISTINCT one.r, one.p, one.t AS t1, one.t2 FROM one JOIN t AS o ON o.r = one.r AND o.t = one.t2 AND abs(o.p - one.p) <= 15),
near AS (SELECT DISTINCT c.r, item_id FROM close c JOIN plan ON plan.t1 = c.t1 AND plan.t2 = c.t2 LEFT JOIN close e ON e.r = c.r AND e.p = c.p AND e.t1 = c.t1 AND e.t2 = plan.t3 WHERE plan.t3 IS NULL OR e.r IS NOT NULL
  UNION SELECT DISTINCT t.r, item_id FROM t JOIN plan ON plan.t1 = t.t AND plan.t2 IS NULL),
n_near AS (SELECT r, count(*) AS n_near FROM near GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN listed USING (r) LEFT JOIN n_near USING (r)
"""
