"""What the operators of this subpackage share: reading tables, shared storage, Arrow batches and connected components."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.plans.storage import PART_BYTES, durable, partitions, shared_dir

__all__ = ["PART_BYTES", "batches_by_key", "beside", "components", "held_out", "keyed_texts", "partitions", "shared_dir", "small_batches", "stored", "table", "tidy", "trim", "utf8", "worker_cache"]

#: Rows that one Arrow batch holds at most; long texts make batches large before rows make them many.
BATCH_ROWS = 1000
#: Bytes after which a batch is sent; a longer text is a batch of its own.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, opened by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rows written to the shared folder and read again: cuts lineage, survives the loss of executors.
stored = durable


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small enough for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int("".join(c for c in spark.conf.get(key) if c in "0123456789-")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table, whatever else it has; a null text counts as empty, a null key is dropped nowhere."""
    return docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def held_out(key: str = "doc_id") -> Column:
    """Whether the label of a document may not be learned from: crc32 of its id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, without decoding; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def batches_by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups from batches that are sorted by key; one group is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch)
        keys = t.column(key).to_pylist()
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                if held and keys[at] != last:
                    yield pa.concat_tables(held)
                    held = []
                held.append(t.slice(at, i - at))
                last, at = keys[at], i
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node that links reach.

    Alternates the large-star and small-star steps of public map-reduce literature. Each step is one exchange of
    pairs; a node's neighbours are reduced by min() before they move. Rows of a hub meet its minimum in a join, whose
    partitions AQE splits where they are skewed. Every round is written to the shared folder; rounds go on until nothing
    changes, and grow with the logarithm of the longest path.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour goes to the smallest one
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each smaller neighbour, and the node itself, goes to the smallest one
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = stored(small)
        # rows are distinct; ids may be of any size, so they are told by exclusive or, which can't overflow
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks after the first reuse what was loaded."""
    import sys
    import types

    return sys.modules.setdefault("_tilewright_worker_cache", types.ModuleType("_tilewright_worker_cache")).__dict__


def beside(documents: DataFrame, fields: str, make) -> DataFrame:
    """(row, fields): each row whole, as a struct that keeps its names apart, beside what make(texts) returns for it.

    make takes the texts of a batch (str, null as empty) and returns one list for each field. One pass, no exchange.
    """
    from pyspark.sql.types import StructField, StructType

    text = next(i for i, f in enumerate(documents.schema.fields) if f.name.lower() == "text")
    made = StructType.fromDDL(fields)
    schema = StructType([StructField("row", documents.schema), *made.fields])
    small_batches(documents.sparkSession)
    names = schema.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            row = batch.column("row")
            texts = [x or "" for x in row.field(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([row, *(pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(make(texts), made.fields, strict=True))], names=names)

    return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")).mapInArrow(tidy(run), schema)


def tidy(run):
    """run, a function over Arrow batches, that gives freed memory back when it ends: idle workers stay small."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def trim() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
