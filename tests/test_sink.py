"""The upsert sink, trees as rows, and collations."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import text as X
from tilewright.operators import trees
from tilewright.streaming.sink import UpsertTable

SCHEMA = "k string, seq long, bytes long, v string"


def batches(seed, n=5, rows=60):
    r = random.Random(seed)
    return [[(f"k{r.randrange(40)}", 100 * b + i, r.randint(1, 9), f"{b}/{i}") for i in range(rows)] for b in range(n)]


def last(parts):
    out = {}
    for part in parts:
        for row in part:
            if row[0] not in out or row[1] >= out[row[0]][1]:
                out[row[0]] = row
    return sorted(out.values())


def rows(spark, table):
    return sorted(tuple(r[c] for c in ("k", "seq", "bytes", "v")) for r in table.read(spark).collect())


def test_batches_are_taken_once(spark, tmp_path):
    parts = batches(1)
    table = UpsertTable(str(tmp_path / "t"), ["k"], ["seq"], shards=8)
    assert table.read(spark) is None
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, SCHEMA)
        assert table.write(df, n) and not table.write(df, n) and (n == 0 or not table.write(spark.createDataFrame(parts[0], SCHEMA), 0))
        assert rows(spark, table) == last(parts[: n + 1])
    report = table.manifest()["report"]
    assert [x["batch"] for x in report] == [0, 1, 2, 3, 4]
    late = spark.createDataFrame([("k1", -5, 1, "late"), ("new", -5, 1, "new")], SCHEMA)
    table.write(late, 9)
    assert ("new", -5, 1, "new") in rows(spark, table) and not [x for x in rows(spark, table) if x[3] == "late"]
    assert table.manifest()["report"][-1]["touched"] <= 2


def test_a_restarted_stream_gives_the_same_table(spark, tmp_path, monkeypatch):
    parts = batches(2, n=3)
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = UpsertTable(f"{tmp_path}/t", ["k"], ["seq"], shards=4)

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = table.stream(source, f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q

    commit, calls = table._commit, []

    def fails(manifest):
        calls.append(manifest["batch"])
        if len(calls) == 2:
            raise OSError("the driver is lost before the pointer moves")
        commit(manifest)

    monkeypatch.setattr(table, "_commit", fails)
    with pytest.raises(Exception, match="before the pointer moves"):
        run()
    assert table.manifest()["batch"] == 0
    run()
    assert rows(spark, table) == last(parts) and calls == [0, 1, 1, 2]
    assert run().exception() is None and rows(spark, table) == last(parts)


def test_prunes(spark, tmp_path):
    parts = batches(3, n=4)
    table = UpsertTable(str(tmp_path / "t"), ["k"], ["seq"], shards=2, every=2, size="bytes", budget=40)
    for n, part in enumerate(parts):
        table.write(spark.createDataFrame(part, SCHEMA), n)
    shard = {r["k"]: r["s"] for r in spark.createDataFrame([(f"k{i}",) for i in range(40)], "k string").select("k", F.pmod(F.xxhash64("k"), F.lit(2)).alias("s")).collect()}
    held = {}
    for n, part in enumerate(parts):
        held = {x[0]: x for x in last([list(held.values()), part])}
        if n % 2:
            for s in (0, 1):
                total = 0
                for row in sorted((x for x in held.values() if shard[x[0]] == s), key=lambda x: -x[1]):
                    total += row[2]
                    if total > 40:
                        del held[row[0]]
    assert rows(spark, table) == sorted(held.values()) and len(held) < 40
    assert os.path.exists(f"{table.path}/CURRENT")


def test_leaves(spark):
    def walk(v, path="$", at=None):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{path}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{path}[{i}]", i)
        elif v is not None:
            kind = "flag" if isinstance(v, bool) else "text" if isinstance(v, str) else "number"
            yield path, at, kind, str(v).lower() if isinstance(v, bool) else str(v)

    deep = "x"
    for k in range(25):
        deep = ["op", k, deep]
    docs = [{"a": [1, "two", [True, None, {"b": 2.5}]], "c": {}, "d": [], "e": ""}, ["==", ["get", "class"], "x"], "alone", 7, None, deep]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(90, None), (91, "{broken")], "id long, tree string")
    got = sorted((r["id"], r["path"], r["at"], r["kind"], r["value"]) for r in trees.leaves(df, ["id"], "tree").collect())
    assert got == sorted((k, *x) for k, d in enumerate(docs) for x in walk(d))
    kept = trees.expression_literals(trees.leaves(df.where("id = 1"), ["id"], "tree")).collect()
    assert sorted(r["value"] for r in kept) == ["class", "x"]


def test_locale(spark):
    names = ["b", "a", "á", "A", "Z", "ä", "z", "B", "é", "e 1", "e-1", "e1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(X.by_locale(F.col("n"))).collect()] == ["a", "A", "á", "ä", "b", "B", "é", "e 1", "e-1", "e1", "z", "Z"]
    assert sorted(r["count"] for r in df.groupBy(X.alike(F.col("n"))).count().collect()) == [1, 1, 1, 1, 2, 2, 4]


def test_hex_colours_of_other_lengths_stay(spark):
    given = ["#abc", "#abcd", "#abcde", "#abcdef", "#abcdefa", "#abcdefab", "red"]
    df = spark.createDataFrame([(c,) for c in given], "c string")
    assert [r[0] for r in df.select(X.normalize_hex(F.col("c"))).collect()] == ["#AABBCC", "#AABBCCDD", "#abcde", "#ABCDEF", "#abcdefa", "#ABCDEFAB", "red"]


def test_style_documents(spark):
    from tilewright.functions import style as S

    layer = {"id": "a", "type": "symbol", "source": "old", "source-layer": "road", "minzoom": 3, "layout": {"text-font": ["case", ["has", "x"], ["literal", ["DIN Pro Bold"]], ["literal", ["Mine"]]], "text-field": "DIN Pro Bold"}}
    rows = [("s", 1, "b", "background", None, None, None, None, None, None, '{"background-color": "red"}'), ("s", 0, layer["id"], layer["type"], layer["source"], layer["source-layer"], 3.0, None, '["==", ["get", "class"], "x"]', json.dumps(layer["layout"]), None), ("s", 2, "gone", "line", "old", "hillshade", None, None, None, None, None)]
    df = spark.createDataFrame(rows, f"style string, place int, {S.LAYERS}")
    got = S.style_documents(S.convert(df), "open", {"version": 8}, "made", {"DIN Pro Bold": "Other Bold"}).collect()
    doc = json.loads(got[0]["document"])
    assert len(got) == 1 and doc["version"] == 8 and [x["id"] for x in doc["layers"]] == ["a", "b"]
    a, b = doc["layers"]
    assert a["source"] == "open" and a["source-layer"] == "transportation_name" and a["minzoom"] == 3 and a["metadata"] == {"made:original-source-layer": "road", "made:open-source-layer": "transportation_name"}
    assert a["layout"]["text-font"] == ["case", ["has", "x"], ["literal", ["Other Bold"]], ["literal", ["Mine"]]] and a["layout"]["text-field"] == "DIN Pro Bold" and a["filter"][0] == "case"
    assert b == {"id": "b", "type": "background", "paint": {"background-color": "red"}}


def test_stored_tables_can_be_cleared(spark):
    from tilewright.plans import storage

    df = storage.durable(spark.range(5))
    path = storage._made[-1]
    assert df.count() == 5 and os.path.isdir(path) and storage.clear(spark) >= 1 and not os.path.exists(path) and storage.clear(spark) == 0
