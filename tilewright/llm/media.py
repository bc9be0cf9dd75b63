"""Media columns: Netpbm and BMP to numpy arrays, area-resized by integral images, with difference hashes.

decode_image reads PBM, PGM and PPM (plain and raw, 8 and 16 bits) and uncompressed BMP (8 bits grey or palette, 24 and
32 bits). Areas are differences of an integral image, which is summed by strips of rows: only its rows at the edges of
areas are kept, and one pass serves all target sizes. Tiles are NPY files (a header and the samples), which numpy.load
reads; their samples are scaled by the image's own maximum to 0 to 255.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import keyed_texts, small_batches, table, tidy, utf8

#: Samples of a stored row, and sides of the tile and of the difference hash.
WIDTH, TILE, HASH = 64, 32, 8
#: Samples of a strip of the integral image, at least one row.
STRIP = 1 << 19


def encode_pgm(samples: np.ndarray) -> bytes:
    """A two-dimensional uint8 array as raw PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A two-dimensional uint8 array as BMP with a grey palette; rows are stored from the bottom."""
    h, w = samples.shape
    step = (w + 3) // 4 * 4
    rows = np.zeros((h, step), dtype=np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    return b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """count numbers after the magic, comments skipped; and where the samples start (one blank after the last)."""
    out, at = [], 2
    while len(out) < count:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_levels(data: bytes) -> tuple[np.ndarray, int]:
    """(samples as (height, width) or (height, width, 3), the largest value that a sample may have). ValueError for what
    isn't a whole image of these formats: cut off, without rows or columns, or with samples above the maximum."""
    magic = data[:2]
    if magic in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        _sized(w, h)
        if magic == b"P4":
            step = (w + 7) // 8
            raw = np.frombuffer(data, dtype=np.uint8, count=step * h, offset=at).reshape(h, step)
            return (1 - np.unpackbits(raw, axis=1)[:, :w]) * np.uint8(255), 255
        bits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01")[: w * h], dtype=np.uint8).reshape(h, w) - 48
        return (1 - bits) * np.uint8(255), 255
    if magic in (b"P2", b"P3", b"P5", b"P6"):
        (w, h, top), at = _header(data, 3)
        _sized(w, h)
        if not 0 < top < 1 << 16:
            raise ValueError(f"a maximum of {top}")
        shape = (h, w) if magic in (b"P2", b"P5") else (h, w, 3)
        n = int(np.prod(shape))
        kind = np.uint8 if top < 256 else np.uint16
        if magic in (b"P5", b"P6"):
            samples = np.frombuffer(data, dtype=np.dtype(kind).newbyteorder(">"), count=n, offset=at).reshape(shape).astype(kind)
        else:
            samples = np.array(data[at - 1 :].split()[:n], dtype=np.int64).reshape(shape)
        if samples.min() < 0 or samples.max() > top:
            raise ValueError("a sample above the maximum")
        return samples.astype(kind, copy=False), top
    if magic == b"BM":
        start, size, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
        if packed or depth not in (8, 24, 32):
            raise ValueError(f"BMP of {depth} bits, compression {packed}")
        _sized(w, abs(h))
        step = (w * depth // 8 + 3) // 4 * 4
        rows = np.frombuffer(data, dtype=np.uint8, count=step * abs(h), offset=start).reshape(abs(h), step)
        rows = rows[::-1] if h > 0 else rows
        if depth == 8:
            table_ = np.frombuffer(data, dtype=np.uint8, count=(start - 14 - size) // 4 * 4, offset=14 + size).reshape(-1, 4)[:, 2::-1]
            colours = table_[rows[:, :w]]
            grey_ = bool((table_[:, 0] == table_[:, 1]).all() and (table_[:, 1] == table_[:, 2]).all())
            return np.ascontiguousarray(colours[..., 0] if grey_ else colours), 255
        return np.ascontiguousarray(rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[..., 2::-1]), 255
    raise ValueError("neither Netpbm nor BMP")


def _sized(w: int, h: int) -> None:
    if w < 1 or h < 1:
        raise ValueError(f"an image of {w} by {h}")


def decode_image(data: bytes) -> np.ndarray:
    """The samples of decode_levels."""
    return decode_levels(data)[0]


def grey(samples: np.ndarray) -> np.ndarray:
    """One channel: the rounded weighted sum of three by the usual luma weights."""
    if samples.ndim == 2:
        return samples
    return ((samples.astype(np.int64) * [299, 587, 114]).sum(axis=2) + 500) // 1000


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(whole part, fraction) of the edges that cut n samples into equal parts."""
    edges = np.linspace(0, n, parts + 1)
    low = np.minimum(np.floor(edges).astype(np.int64), n - 1)
    return low, edges - low


def integral_rows(samples: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """These rows (ascending, 0 to height) of the integral image, which has a row and a column of zeros first."""
    h, w = samples.shape
    out, carry, step = np.zeros((len(wanted), w + 1)), np.zeros(w), max(1, STRIP // w)
    for top in range(0, h, step):
        strip = np.cumsum(samples[top : top + step], axis=0, dtype=np.float64)
        np.cumsum(strip, axis=1, out=strip)
        strip += carry
        inside = (wanted > top) & (wanted <= top + len(strip))
        out[inside, 1:] = strip[wanted[inside] - top - 1]
        carry = strip[-1].copy()
    return out


def area_resizes(samples: np.ndarray, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each (height, width) the mean of the area that each target sample covers, fractions of samples included, as
    float64; one integral image serves all."""
    h, w = samples.shape
    cuts = [_edges(h, height) for height, _ in sizes]
    wanted = np.unique(np.concatenate([np.concatenate([low, low + 1]) for low, _ in cuts]))
    rows, out = integral_rows(samples, wanted), []
    for (low, part), (height, width) in zip(cuts, sizes, strict=True):
        a, b = rows[np.searchsorted(wanted, low)], rows[np.searchsorted(wanted, low + 1)]
        sums = a + (b - a) * part[:, None]
        low, part = _edges(w, width)
        sums = sums[:, low] + (sums[:, low + 1] - sums[:, low]) * part
        out.append(np.diff(np.diff(sums, axis=0), axis=1) / ((h / height) * (w / width)))
    return out


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_resizes(samples, [(height, width)])[0]


def features_of(samples: np.ndarray, top: int = 255, size: int = TILE, bits: int = HASH) -> tuple[str, bytes]:
    """(difference hash, tile): bits * bits bits in hex, whether each area is brighter than the one to its left; and the
    area-resized samples as an NPY file of uint8, size by size."""
    small, square = area_resizes(samples, [(bits, bits + 1), (size, size)])
    small = np.rint(small * 256).astype(np.int64)
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(square * (255 / top)), 0, 255).astype(np.uint8), allow_pickle=False)
    return np.packbits((small[:, 1:] > small[:, :-1]).ravel()).tobytes().hex(), out.getvalue()


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def media_features(images: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, height, width, feature, tile) of a binary column of images.

    feature: the difference hash; tile: NPY bytes. A null or unreadable image has nulls there. Rows keep their number.
    """
    small_batches(images.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    x, top = decode_levels(data or b"")
                    x = grey(x)
                    rows.append((*x.shape, *features_of(x, top)))
                except (ValueError, IndexError, struct.error):
                    rows.append((None, None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.binary())))], names=[key, "height", "width", "feature", "tile"])

    return images.select(key, media).mapInArrow(tidy(run), f"{key} {images.schema[key].dataType.simpleString()}, height int, width int, feature string, tile binary")


def stored_form(payload: bytes, form: str | None = None) -> bytes:
    """The payload as an image of WIDTH columns: "pgm", "bmp", or, without form, one of them by its digest."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    if form is None:
        form = "bmp" if hashlib.sha256(payload).digest()[0] & 1 else "pgm"
    return {"pgm": encode_pgm, "bmp": encode_bmp}[form](samples)


def text_media(documents: DataFrame, form: str | None = None) -> DataFrame:
    """Every text stored as an image and read back: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, tile).

    A null text is empty and stored as one row of zeros. Rows with equal texts have equal values; other columns are
    ignored, null and repeated ids keep their rows. form: as of stored_form; texts of even digests are PGM, others BMP. One
    pass; a text's image is dropped before the next is made, and its integral image is a strip at a time.
    """
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                media = stored_form(payload_of(text), form)
                samples, top = decode_levels(media)
                back = samples.tobytes()
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), *features_of(samples, top)))
            columns = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(columns))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    return keyed_texts(documents).mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def media_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_media that SQL can make too."""
    return op9_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", F.octet_length("tile").alias("tile_bytes"))


#: The header of PGM has the height in decimal; BMP has 1078 bytes of header and palette.
MEDIA_SQL = r"""
WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
q AS (SELECT *, greatest(1, (n + 63) // 64) AS h FROM p),
r AS (SELECT *, sha256(b || unhex(repeat('00', CAST(h * 64 - n AS INT)))) AS digest FROM q)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(h * 64 AS BIGINT) AS payload_bytes, digest AS payload_sha256,
  CAST(h * 64 + CASE WHEN substr(digest, 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1078 ELSE 11 + length(CAST(h AS VARCHAR)) END AS BIGINT) AS media_bytes, 1152 AS tile_bytes FROM r
"""
