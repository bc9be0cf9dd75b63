"""What clients get for tiles and byte ranges: status, headers and body of each request, as rows."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import text as X

#: Level of gzip bodies.
LEVEL = 5
UNSATISFIABLE = "Requested range not satisfiable"


def tile_responses(requests: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """requests (keys, method, accept_encoding, if_none_match and any others) with (status, etag, encoding,
    content_length, body) of the tile of their keys; tiles (keys, tile) has one row a key.

    A request that names the tile's digest gets 304 without a body; others get 200, under gzip if they accept it. HEAD
    gets the length without the body. A tile that isn't there, is null or has a null key is the empty tile.
    Each tile is digested and packed once, before requests meet it, so a tile that a third of all requests ask for isn't
    packed again for each; requests of one tile spread by the join's own treatment of skew.
    """
    plain = F.coalesce(F.col("tile").cast("binary"), F.lit(b""))
    known = tiles.select(*(F.col(k).alias(f"_{k}") for k in keys), plain.alias("_tile")).withColumn("_etag", X.etag(F.col("_tile")))
    names = known.columns

    def pack(batches):
        for batch in batches:
            packed = [gzip.compress(t, LEVEL, mtime=0) for t in batch.column("_tile").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names=[*names, "_packed"])

    ready = known.mapInArrow(pack, ", ".join(f"`{n}` {t}" for n, t in known.dtypes) + ", _packed binary")
    on = [requests[k] == ready[f"_{k}"] for k in keys]
    none = gzip.compress(b"", LEVEL, mtime=0)
    etag = F.coalesce("_etag", X.etag(F.lit(b"")))
    same, packed = F.coalesce(requests["if_none_match"] == etag, F.lit(False)), X.accepts_gzip(requests["accept_encoding"])
    payload = F.when(packed, F.coalesce("_packed", F.lit(none))).otherwise(F.coalesce("_tile", F.lit(b"")))
    return requests.join(ready, on, "left").select(
        *(requests[c] for c in requests.columns), F.when(same, 304).otherwise(200).alias("status"), etag.alias("etag"), F.when(~same & packed, "gzip").alias("encoding"),
        F.when(~same, F.octet_length(payload)).alias("content_length"), F.when(~same & ~F.coalesce(requests["method"] == "HEAD", F.lit(False)), payload).alias("body"),
    )


def decoded(responses: DataFrame) -> DataFrame:
    """responses with plain, their body without its encoding; null without a body."""
    names = responses.columns

    def unpack(batches):
        for batch in batches:
            bodies = zip(batch.column("encoding").to_pylist(), batch.column("body").to_pylist(), strict=True)
            plain = [gzip.decompress(b) if e == "gzip" and b is not None else b for e, b in bodies]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.binary())], names=[*names, "plain"])

    return responses.mapInArrow(unpack, ", ".join(f"`{n}` {t}" for n, t in responses.dtypes) + ", plain binary")


def range_responses(requests: DataFrame, header: str = "range", content: str = "content") -> DataFrame:
    """requests with (status, content_range, content_length, body) of their range of content: 200 and all of it without a
    header, 206 and the range, or 416 where the header isn't one range that the content has. Null content is empty."""
    whole = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    size = F.octet_length(whole).cast("long")
    r = X.byte_range(F.col(header), size)
    asked = F.coalesce(F.col(header) != "", F.lit(False))
    length = r["stop"] - r["start"] + 1
    text = lambda c: c.cast("string")
    body = F.when(~asked, whole).when(r.isNull(), F.lit(UNSATISFIABLE.encode())).otherwise(F.substr(whole, (r["start"] + 1).cast("int"), length.cast("int")))
    told = F.when(asked & r.isNull(), F.concat(F.lit("bytes */"), text(size))).when(asked, F.concat(F.lit("bytes "), text(r["start"]), F.lit("-"), text(r["stop"]), F.lit("/"), text(size)))
    return requests.select("*", F.when(~asked, 200).when(r.isNull(), 416).otherwise(206).alias("status"), told.alias("content_range"), F.octet_length(body).cast("long").alias("content_length"), body.alias("body"))
