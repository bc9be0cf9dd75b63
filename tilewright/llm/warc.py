"""WARC archives with a two-level capture index.

Archives are gzip members, one a record, gathered into blocks that start and end with a record. Executors share no
files but through Spark, so an archive is rows (archive, block, data) of a table; the concatenation of its blocks in
order is a valid .warc.gz file (export_archive writes it).

The index sorts captures by reversed-host key, range-partitioned; each LINES of them make one compressed block, and the
directory, a table of its own, holds the first and last key of each block. A look-up of any number of keys bisects the
bounds of the parts (as many as partitions), then the directory of each part, then the lines of each block found, and
only then reads the ranges of records. Keys move to parts and blocks; the directory is never gathered as a whole.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import partitions, small_batches, stored, table, tidy

#: Captures of an index block, bytes of an archive block at least, zlib level of records.
LINES, BLOCK, LEVEL = 3000, 1 << 20, 2
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: com,example,www)/path?query. No scheme, user, default port or fragment."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip())
    m = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?([^/?#]*)([^#]*)", url)
    scheme, host, rest = (m[1] or "").lower(), m[2].rpartition("@")[2].lower(), m[3] or "/"
    name, colon, port = host.partition(":")
    port = f":{port}" if colon and port and port != {"http": "80", "https": "443"}.get(scheme) else ""
    return ",".join(reversed(name.split("."))) + port + ")" + (rest if rest[0] == "/" else "/" + rest)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; a revisit of first if that is given, which has the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none"), f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's type, ids, payload (None for a revisit), length and digest; the digest of a response is computed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    length = int(named["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = named["warc-payload-digest"].partition(":")[2]
    number = lambda x: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", x)) else None
    if named["warc-type"] == "revisit":
        return {"type": "revisit", "page_id": number(named["warc-record-id"]), "refers_to": number(named["warc-refers-to"]), "payload": None, "bytes": int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), "digest": said, "url": named["warc-target-uri"]}
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != said:
        raise ValueError("a payload doesn't match its digest")
    return {"type": "response", "page_id": number(named["warc-record-id"]), "refers_to": None, "payload": payload, "bytes": len(payload), "digest": digest, "url": named["warc-target-uri"]}


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The archives' table: rows with data are blocks (archive, block, data); rows with a key are captures
    (key, archive, block, at, length, page_id).

    Of records with equal payloads of at least min_bytes bytes, that with the smallest page_id is a response, the others
    revisit it; smaller ones are all responses. A null html is an empty payload, a null url has the key of none.
    Repeated rows of the smallest page_id are responses alike; a row without page_id is a response and never
    revisited. Payloads move once, keyed by page_id; digests alone meet by payload, reduced to the smallest id first.
    """
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("known", F.coalesce("page_id", F.monotonically_increasing_id()))
    light = stored(own.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest").where("page_id IS NOT NULL"))
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    revisits = light.join(firsts, "digest").where("page_id <> first").distinct()
    # rows without page_id have keys of their own here: they meet nothing and spread over tasks
    met = revisits.select(F.col("page_id").alias("known"), "digest", "first", F.lit(False).alias("none"))
    ready = own.withColumn("none", F.col("page_id").isNull()).join(met, ["known", "digest", "none"], "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches):
        archive, number, parts, size, captures = f"capture-{TaskContext.get().partitionId():06d}", 0, [], 0, []

        def rows():
            n = len(captures)
            keys = list(zip(*captures, strict=True))
            cols = [[*k, None] for k in (keys[0], [archive] * n, [number] * n, keys[1], keys[2], keys[3])]
            cols[1][-1], cols[2][-1] = archive, number
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([None] * n + [b"".join(parts)], pa.binary())], names=["key", "archive", "block", "at", "length", "page_id", "data"])

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packed.compress(record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first)) + packed.flush()
                captures.append((url_key(url), size, len(data), page_id))
                parts.append(data)
                size += len(data)
                if size >= BLOCK:
                    yield rows()
                    number, size = number + 1, 0
                    parts.clear(), captures.clear()
        if captures:
            yield rows()

    return stored(ready.mapInArrow(tidy(run), "key string, archive string, block int, at int, length int, page_id long, data binary"))


def build_index(archives: DataFrame) -> DataFrame:
    """(part, block, first_key, last_key, lines) of the captures sorted by key; lines are compressed.

    Rows of equal keys are told apart by page_id and place, so a key of many captures spreads over blocks and parts.
    """
    spark = archives.sparkSession
    captures = archives.where("key IS NOT NULL").select("key", "page_id", "archive", "block", "at", "length")
    ordered = captures.repartitionByRange(partitions(spark, captures), "key", "page_id", "archive", "block", "at").sortWithinPartitions("key", "page_id", "archive", "block", "at")

    def run(batches):
        part, number, lines = TaskContext.get().partitionId(), 0, []

        def row():
            text = "\n".join(lines).encode()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([lines[0].split(" ", 1)[0]]), pa.array([lines[-1].split(" ", 1)[0]]), pa.array([zlib.compress(text, 6)], pa.binary())], names=["part", "block", "first_key", "last_key", "lines"])

        for batch in batches:
            for key, page_id, archive, block, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(f"{key} {archive} {block} {at} {length} {'-' if page_id is None else page_id}")
                if len(lines) == LINES:
                    yield row()
                    number += 1
                    lines.clear()
        if lines:
            yield row()

    return stored(ordered.mapInArrow(tidy(run), "part int, block int, first_key string, last_key string, lines binary"))


def directory_of(index: DataFrame) -> DataFrame:
    """The sparse directory: (part, block, first_key, last_key) of each index block, a table of its own."""
    return stored(index.select("part", "block", "first_key", "last_key"))


def keys_of(urls: DataFrame) -> DataFrame:
    """(key), each once, of a table's column url; null gives the key of none."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col("url").cast("string")).mapInArrow(tidy(run), "key string").distinct()


def _by_key(batches, names: list[str]):
    """(values of the leading columns, rows of the others) of batches sorted by names; a group is read as it comes."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[: len(names)] != last:
                yield last, held
                held = []
            last = row[: len(names)]
            held.append(row[len(names) :])
    if held:
        yield last, held


def captures_of(index: DataFrame, directory: DataFrame, keys: DataFrame) -> DataFrame:
    """(archive, block, at, length) of the captures of keys (key), each once. Only blocks that the directory names for a
    key are unpacked; the rows of one part's directory, and the keys of one block, are held by a task at a time."""
    spark = index.sparkSession
    bounds = sorted((r["part"], r["low"], r["high"]) for r in directory.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect())
    parts, lows, highs = ([b[k] for b in bounds] for k in range(3))

    def to_part(batches):
        for batch in batches:
            out = [(parts[i], k) for k in batch.column(0).to_pylist() for i in range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], names=["part", "first_key"])

    none = F.lit(None)
    asked = keys.mapInArrow(tidy(to_part), "part int, first_key string").select("part", F.lit(1).alias("kind"), "first_key", none.cast("string").alias("last_key"), none.cast("int").alias("block"))
    met = directory.select("part", F.lit(0).alias("kind"), "first_key", "last_key", "block").unionByName(asked)

    def to_block(batches):
        firsts, lasts, blocks, at = [], [], [], None
        for batch in batches:
            out = []
            for part, kind, first, last, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    firsts, lasts, blocks, at = [], [], [], part
                if kind == 0:
                    firsts.append(first), lasts.append(last), blocks.append(block)
                else:
                    out += [(part, blocks[i], first) for i in range(bisect.bisect_left(lasts, first), bisect.bisect_right(firsts, first))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["part", "block", "key"])

    found = met.repartition(partitions(spark, directory), "part").sortWithinPartitions("part", "kind", "first_key", "block").mapInArrow(tidy(to_block), "part int, block int, key string")
    both = index.select("part", "block", F.lit(None).cast("string").alias("key"), "lines").unionByName(found.select("part", "block", "key", F.lit(None).cast("binary").alias("lines")))

    def to_lines(batches):
        for _, rows in _by_key(batches, ["part", "block"]):
            wanted = [key for key, lines in rows if lines is None]
            if not wanted:
                continue
            if rows[0][1] is None:
                raise ValueError("the index lacks a block that its directory names")
            lines = zlib.decompress(rows[0][1]).decode().split("\n")
            own, got = [x.split(" ", 1)[0] for x in lines], []
            for k in wanted:
                got += [x.split(" ")[1:5] for x in lines[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), *(pa.array([int(g[k]) for g in got], pa.int32()) for k in (1, 2, 3))], names=["archive", "block", "at", "length"])

    dealt = both.repartition(partitions(spark, index), "part", "block").sortWithinPartitions("part", "block", F.col("lines").isNull(), "key")
    return dealt.mapInArrow(tidy(to_lines), "archive string, block int, at int, length int")


def read_records(archives: DataFrame, captures: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records at (archive, block, at, length), read by range from the archives' blocks and parsed.

    A block's ranges meet the block once, by the same merge join at every size; they are no more than its records.
    """
    ranges = captures.groupBy("archive", "block").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("ranges"))
    blocks = archives.where("data IS NOT NULL").select("archive", "block", "data")
    joined = blocks.repartition(partitions(archives.sparkSession, archives), "archive", "block").join(ranges.hint("merge"), ["archive", "block"]).select("data", F.transform("ranges", lambda r: r["at"]).alias("at"), F.transform("ranges", lambda r: r["length"]).alias("length"))

    def run(batches):
        for batch in batches:
            for data, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [parse(zlib.decompress(data[a : a + n], 31)) for a, n in zip(at, length, strict=True)]
                columns = [("page_id", pa.int64(), "page_id"), ("payload_bytes", pa.int64(), "bytes"), ("payload_digest", pa.string(), "digest"), ("record_type", pa.string(), "type"), ("refers_to", pa.int64(), "refers_to"), *[("payload", pa.binary(), "payload")] * keep_payload]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for _, kind, k in columns], names=[c[0] for c in columns])

    return joined.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload)


def look_up(archives: DataFrame, index: DataFrame, directory: DataFrame, urls: list[str], keep_payload: bool = True) -> DataFrame:
    """The records of these URLs."""
    keys = keys_of(archives.sparkSession.createDataFrame([(u,) for u in urls], "url string"))
    return read_records(archives, captures_of(index, directory, keys), keep_payload)


def export_archive(archives: DataFrame, archive: str):
    """The bytes of one archive file, block by block, through the driver's iterator."""
    for row in archives.where((F.col("archive") == archive) & F.col("data").isNotNull()).orderBy("block").select("data").toLocalIterator():
        yield bytes(row["data"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, looked up by the key of its URL."""
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(pages)
    index = build_index(archives)
    return read_records(archives, captures_of(index, directory_of(index), keys_of(pages)))


OP10_SQL = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
