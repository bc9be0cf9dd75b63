"""The pipeline's stages, each against its operator's brute force on a small folder of tables."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(240):
        w = r.choices(words, k=60)
        good, toxic = k % 6 > 0, k % 8 == 1
        if toxic:
            w[3:5] = ["vile", "nasty"]
        text = " ".join(w if good else [x + "!!" for x in w])
        docs.append((k, text, "en", f"s{k % 2}", len(text)))
        labels.append((k, int(good), int(toxic)))
    docs += [(1000 + k, docs[k][1] + " tail", "en", "s0", 1) for k in range(2, 60, 6)]
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, {d[0]: d for d in docs}


def test_stages(spark, folder):
    top, by_id = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality"](spark, docs, top)
    assert one.columns == columns and ids(one) >= {k for k in range(240) if k % 6} and not ids(one) & {k for k in range(240) if k % 6 == 0}
    one.write.parquet(f"{top}/1")
    two = stages["toxicity"](spark, spark.read.parquet(f"{top}/1"), top)
    assert two.columns == columns and ids(two) == {k for k in ids(one) if "vile" not in by_id[k][1]}
    two.write.parquet(f"{top}/2")
    three = stages["near_duplicates"](spark, spark.read.parquet(f"{top}/2"), top)
    assert three.columns == columns and ids(three) == {k for k in ids(two) if k < 1000 or k - 1000 not in ids(two)}
    three.write.parquet(f"{top}/3")
    four = stages["mixture"](spark, spark.read.parquet(f"{top}/3"), top)
    assert four.columns == columns and ids(four) <= ids(three)
    last = stages["bpe"](spark, four, top)
    assert last.count() == four.count()


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_with_nulls_repeats_and_clashing_names(spark, folder, tmp_path):
    """Nulls in any column, empty and repeated rows, ids at both ends of 64 bits, and columns named as the stages' own."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    low, high = -(1 << 63), (1 << 63) - 1
    long = folder[1][7][1]
    odd = [(None, long + " x", "en", "s0", 1), (2000, None, None, None, None), (2001, "", "en", "s0", 0), (low, long, "en", None, 1), (high, long, "en", "s1", 1), (2003, " \n ", "en", "s1", 3)]
    odd += [odd[3]] * 2 + [(2002, "one two", "en", "s1", 7)] * 2
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for n, c in enumerate(("copy", "score", "kept", "size", "row", "key")):
        from pyspark.sql import functions as F

        more = more.withColumn(c, F.lit(n))
    top = str(tmp_path)
    more.write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    rows, ids = more, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, rows, top)
        if name != "bpe":
            assert rows.columns == more.columns
            rows.write.parquet(f"{top}/{k}")
            rows = spark.read.parquet(f"{top}/{k}")
            ids.append({r["doc_id"] for r in rows.select("doc_id").collect()})
    assert {None, low, high} <= ids[1] and {None, low} <= ids[2] and not {high, 7} & ids[2] and {2000, 2001, 2002, 2003} <= ids[2]
    assert rows.count() == spark.read.parquet(f"{top}/3").count()


def test_run_of_an_empty_table(spark, folder, tmp_path):
    top = str(tmp_path)
    spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    assert corpus_pipeline.run(spark, top).count() == 0


def test_entry_has_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k[: k.index("_") + 1] for k in names if k.startswith("op") and k[2].isdigit()} and "pipeline" in names
    assert os.path.exists(corpus_pipeline.__file__)
