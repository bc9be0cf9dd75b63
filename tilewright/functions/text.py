"""String, hash and colour functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.replace(F.lower(text), F.lit("/"), F.lit("--")), "[^a-z0-9-]+", "-")
    return F.regexp_replace(F.regexp_replace(s, "-{3,}", "--"), "^-|-$", "")


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def etag(text: Column) -> Column:
    return F.concat(F.lit('"'), F.substring(base64url(F.unhex(F.sha2(text, 256))), 1, 24), F.lit('"'))


def content_version(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def git_blob_sha(text: Column) -> Column:
    data = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def fnv_shard(key: Column, shards: int) -> Column:
    """FNV-1a over code units of an ASCII key, modulo shards; -1 without shards."""
    if shards < 1:
        return F.lit(-1).cast("long")
    codes = F.transform(F.split(key, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF))
    return h % shards


def hex_parameter(data: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(data)))


def safe_label(text: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(text, "[\r\n\t]", " "), 1, most)


def safe_origin(url: Column) -> Column:
    """scheme://host[:port] of an http or https address without user; else null."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1))
    return F.when(scheme.isin("http", "https") & (host != "") & ~F.contains(host, F.lit("@")), F.concat(scheme, F.lit("://"), host))


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, stop) of a single byte range: prefix, open or suffix, with blanks around it; null if it can't be met.
    A number from 2^53 on can't be."""
    pattern, trimmed = r"^bytes=(\d*)-(\d*)$", F.regexp_replace(header, r"^\s+|\s+$", "")
    first, last = F.regexp_extract(trimmed, pattern, 1), F.regexp_extract(trimmed, pattern, 2)
    number = lambda digits: F.when(digits.try_cast("long") < 1 << 53, digits.try_cast("long"))
    a, b = number(first), number(last)
    start = F.when(first != "", a).when(b > 0, F.greatest(size - b, F.lit(0)))
    stop = F.when((first == "") | (last == ""), size - 1).when(b.isNotNull(), F.least(b, size - 1))
    return F.when((start < size) & (start <= stop), F.struct(start.alias("start"), stop.alias("stop")))


def tile_path(path: Column) -> Column:
    """struct(z, x, y) of /tiles/z/x/y.pbf, else null."""
    pattern = r"^/tiles/(\d{1,2})/(\d+)/(\d+)\.pbf$"
    part = lambda k: F.regexp_extract(path, pattern, k).try_cast("int")
    return F.when(path.rlike(pattern), F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y")))


def accepts_gzip(header: Column) -> Column:
    return F.coalesce(header.rlike(r"(?i)(?:^|,)\s*gzip\s*(?:,|$)"), F.lit(False))


def replace_once(text: Column, old: str, new: str) -> Column:
    """The text with old replaced where it stands exactly once; else null."""
    pieces = F.split(text, "\\Q" + old + "\\E")
    return F.when(F.size(pieces) == 2, F.concat(F.element_at(pieces, 1), F.lit(new), F.element_at(pieces, 2)))


def language_key(name: Column) -> Column:
    """name_xx_YY as name:xx-YY."""
    return F.when(name.startswith("name_"), F.concat(F.lit("name:"), F.replace(F.substr(name, F.lit(6)), F.lit("_"), F.lit("-")))).otherwise(name)


# fixed values: family prefix, then (pattern, upright face, italic face) in order of precedence
FONT_RULES = [
    ("DIN Pro", [("(?i)Bold", "Open Sans Semibold", "Open Sans Semibold Italic"), ("(?i)Medium|Semibold", "Open Sans Regular", "Open Sans Italic"), ("", "Open Sans Regular", "Open Sans Italic")]),
    ("Arial Unicode MS", [("(?i)Bold", "Open Sans Semibold", "Open Sans Semibold Italic"), ("", "Open Sans Regular", "Open Sans Italic")]),
    ("Noto Sans", [("(?i)Bold|Semibold", "Open Sans Semibold", "Open Sans Semibold Italic"), ("", "Open Sans Regular", "Open Sans Italic")]),
]
# fixed values: exact names of the first and of the second conversion
FONT_MAP = {"DIN Pro Regular": "Open Sans Regular", "DIN Pro Medium": "Open Sans Semibold", "DIN Pro Bold": "Open Sans Bold", "DIN Pro Italic": "Open Sans Italic", "Arial Unicode MS Regular": "Open Sans Regular"}
FONT_MAP_RESTORED = {"DIN Pro Regular": "Open Sans Regular", "DIN Pro Medium": "Open Sans Regular", "DIN Pro Bold": "Open Sans Semibold", "DIN Pro Italic": "Open Sans Italic", "Arial Unicode MS Regular": "Noto Sans Regular", "Arial Unicode MS Bold": "Noto Sans Semibold"}


def font_family(name: Column) -> Column:
    """The open face of a font's name, by its family's prefix and the words for weight and slant; others stay."""
    italic = name.rlike("(?i)Italic")
    out = None
    for prefix, rules in FONT_RULES:
        for pattern, upright, slanted in rules:
            test = name.startswith(prefix) & name.rlike(pattern) if pattern else name.startswith(prefix)
            face = F.when(italic, slanted).otherwise(upright)
            out = F.when(test, face) if out is None else out.when(test, face)
    return out.otherwise(name)


def looked_up(value: Column, table: dict[str, str]) -> Column:
    """The table's entry, else the value itself."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return value if out is None else out.otherwise(value)


def asset_valid(name: Column, prefix: str, ending: str = "pmtiles") -> Column:
    """Whether a name is prefix-, then lower-case letters, digits and hyphens, and the ending."""
    return F.coalesce(name.rlike(f"^\\Q{prefix}\\E-[a-z0-9-]+\\.\\Q{ending}\\E$"), F.lit(False))


def asset_names(slug: Column, prefix: str) -> Column:
    """struct(asset_name, metadata_name) of a region's slug."""
    return F.struct(F.concat(F.lit(f"{prefix}-"), slug, F.lit(".pmtiles")).alias("asset_name"), F.concat(F.lit(f"{prefix}-"), slug, F.lit(".json")).alias("metadata_name"))


def request_id(value: Column, made: Column) -> Column:
    """A request's id if it has 1 to 128 letters, digits and ._:- after trimming, else the one made."""
    own = F.trim(F.coalesce(value, F.lit("")))
    return F.when(own.rlike("^[A-Za-z0-9._:-]{1,128}$"), own).otherwise(made)


def database_url(value: Column) -> Column:
    """The trimmed address of a PostgreSQL database with user, host and name; else null."""
    own = F.trim(value)
    return F.when(own.rlike("(?i)^postgres(ql)?://[^/?#@:]+(:[^/?#@]*)?@[^/?#@]+/[^?#]+"), own)


def sql_endpoint(url: Column) -> Column:
    """The HTTPS endpoint beside a database's host: its first label becomes api; null if it has one label only."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host.rlike(r"^[^.]+\."), F.concat(F.lit("https://"), F.regexp_replace(host, r"^[^.]+\.", "api."), F.lit("/sql")))


def encoded_parameter(value: Column, kind: str) -> Column:
    """A query's parameter as text by kind: bytes in hex after a backslash and x, whole numbers in digits, times in ISO 8601 (UTC)."""
    if kind == "binary":
        return hex_parameter(value)
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kind == "timestamp" else value.cast("string")


def path_status(path: Column) -> Column:
    """200 for a path inside the root, 400 for a broken escape or a NUL, 403 for one that climbs out of the root."""
    broken = F.coalesce(path.rlike("%(?![0-9A-Fa-f]{2})"), F.lit(False))
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    depth = F.aggregate(
        F.split(plain, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda d, part: F.struct((d["at"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("at"), F.least(d["low"], d["at"] + F.when(part == "..", -1).otherwise(0)).alias("low")),
    )
    return F.when(broken | plain.isNull() | F.contains(plain, F.lit("\0")), 400).when(depth["low"] < 0, 403).otherwise(200)


def error_status(kind: Column, status: Column, code: Column, own: str) -> Column:
    """An error's HTTP status: overloads 503, ranges 404, then its own status, 503 for codes of the service, else 500."""
    return F.when(kind == "overloaded", 503).when(kind == "range", 404).when(status.isNotNull(), status).when(code.startswith(own), 503).otherwise(500)


def cacheable(z: Column, most: int = 6) -> Column:
    return F.coalesce(z.between(0, most), F.lit(False))


def expected_failure(url: Column, error: Column) -> Column:
    """Whether a failure is one that may happen: an icon that browsers ask for, or an aborted request."""
    return F.coalesce(url, F.lit("")).rlike(r"(?i)/favicon\.ico(?:$|\?)") | F.coalesce(error, F.lit("")).rlike("(?i)ERR_ABORTED")


def remote_size(content_range: Column, content_length: Column) -> Column:
    """The size that headers tell: what follows the slash of a range, else a length above 1; else null."""
    length = content_length.try_cast("long")
    return F.coalesce(F.regexp_extract(content_range, r"/(\d+)$", 1).try_cast("long"), F.when(length > 1, length))


# fixed values: what a layer's key is about, water before parks before roads
WATER, PARK, ROAD, BOUNDARY = (
    "water|ocean|lake|river|marine|bay", "park|grass|wood|forest|landcover|landuse|nature|green|garden|golf|pitch|cemetery",
    "road|street|transport|motorway|trunk|primary|secondary|tertiary|minor|path|bridge|tunnel|rail", "boundary|admin|border",
)


def text_class(kind: Column, layer_id: Column, source_layer: Column) -> Column:
    """What a layer shows, by the words of its id and source layer; the order of tests depends on its kind of geometry."""
    key = F.lower(F.concat(F.coalesce(layer_id, F.lit("")), F.lit(" "), F.coalesce(source_layer, F.lit(""))))
    fill = F.when(key.rlike(WATER), "water").when(key.rlike(PARK), F.when(key.rlike("wood|forest"), "park-dark").otherwise("park")).when(key.rlike("building"), "building")
    fill = fill.when(key.rlike("residential|suburb|neighbourhood|industrial|commercial"), "land-soft").otherwise("land")
    line = F.when(key.rlike(BOUNDARY), "boundary").when(key.rlike(WATER), "water-deep").when(key.rlike(ROAD), F.when(key.rlike("case|casing|outline"), "road-casing").otherwise("road"))
    symbol = F.when(key.rlike(WATER), "water-text").when(key.rlike(PARK), "park-text").otherwise("text")
    return F.when(kind == "background", "land").when(kind == "fill", fill).when(kind == "line", line).when(kind == "symbol", symbol)


def shows_water(keys: Column) -> Column:
    """Whether any of the keys names water."""
    return F.exists(keys, lambda k: F.coalesce(F.lower(k).rlike(WATER), F.lit(False)))


def content_type(path: Column) -> Column:
    """By file ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = {"html": "text/html; charset=utf-8", "js": "text/javascript; charset=utf-8", "css": "text/css; charset=utf-8", "json": "application/json; charset=utf-8", "png": "image/png", "svg": "image/svg+xml", "pbf": "application/x-protobuf"}
    out = None
    for k, v in known.items():
        out = F.when(ending == k, v) if out is None else out.when(ending == k, v)
    return out.otherwise("application/octet-stream")


def byte_hex(value: Column) -> Column:
    byte = F.least(F.greatest(F.floor(value + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return F.lpad(F.hex(byte), 2, "0")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hsl_to_hex(h: Column, s: Column, light: Column) -> Column:
    """#RRGGBB of hue in degrees, saturation and lightness from 0 to 1: six sectors of hue."""

    def hexed(v):
        x = v["c"] * (1 - F.abs(v["h"] % 2 - 1))
        low = v["l"] - v["c"] / 2
        k = F.floor(v["h"]).cast("int")
        # the sectors in which each channel is full, part and empty, from sector 0
        order = {"red": "cx00xc", "green": "xccx00", "blue": "00xccx"}
        level = lambda codes: F.array(*({"c": v["c"], "x": x, "0": F.lit(0.0)}[c] for c in codes))
        return F.concat(F.lit("#"), *(byte_hex((F.get(level(codes), k) + low) * 255) for codes in order.values()))

    return let(F.struct((F.pmod(h, F.lit(360.0)) / 60.0).alias("h"), ((1 - F.abs(2 * light - 1)) * s).alias("c"), light.alias("l")), hexed)


def normalize_hex(color: Column) -> Column:
    """Short hex colours doubled, and those of six and eight digits, in upper case; others as they are."""
    doubled = F.concat(F.lit("#"), F.regexp_replace(F.substring(color, 2, 8), "(.)", "$1$1"))
    return F.when(color.rlike("^#[0-9A-Fa-f]{3,4}$"), F.upper(doubled)).when(color.rlike("^#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.upper(color)).otherwise(color)


# fixed values
NAMED_COLORS = {"transparent": "#00000000", "black": "#000000", "white": "#FFFFFF"}


def color_to_hex(color: Column) -> Column:
    """Hex, rgb(), rgba(), hsl(), hsla() and three names as hex, without blanks around; eight digits where alpha is below
    1; channels are clamped. Anything else stays as it is."""
    own = F.trim(color)
    number = r"([+-]?[0-9.]+%?)"
    alpha_ = rf"(?:\s*,\s*{number})?"
    rgb = rf"(?i)^rgba?\(\s*{number}\s*,\s*{number}\s*,\s*{number}{alpha_}\s*\)$"
    hsl = rf"(?i)^hsla?\(\s*([+-]?[0-9.]+)\s*,\s*([+-]?[0-9.]+)%\s*,\s*([+-]?[0-9.]+)%{alpha_}\s*\)$"
    clamped = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    def parsed(pattern, body):
        def made(t):
            plain = lambda k: F.regexp_replace(t[k], "%", "").try_cast("double")
            scaled = lambda k, most: F.when(t[k].endswith("%"), plain(k) / 100 * most).otherwise(plain(k))
            alpha = F.when(t["p4"] == "", F.lit(1.0)).otherwise(clamped(scaled("p4", 1.0)))
            return F.concat(body(plain, scaled), F.when(alpha < 1, byte_hex(alpha * 255)).otherwise(F.lit("")))

        return let(F.struct(*(F.regexp_extract(own, pattern, k).alias(f"p{k}") for k in range(1, 5))), made)

    as_rgb = parsed(rgb, lambda plain, scaled: F.concat(F.lit("#"), *(byte_hex(scaled(k, 255.0)) for k in ("p1", "p2", "p3"))))
    as_hsl = parsed(hsl, lambda plain, scaled: hsl_to_hex(plain("p1"), clamped(plain("p2") / 100), clamped(plain("p3") / 100)))
    named = looked_up(F.lower(own), NAMED_COLORS)
    out = F.when(own.rlike("^#[0-9A-Fa-f]{3,8}$"), normalize_hex(own)).when(own.rlike(rgb), as_rgb).when(own.rlike(hsl), as_hsl)
    return out.when(F.lower(own).isin([*NAMED_COLORS]), named).otherwise(color)


def choose(value: Column, rules: list[tuple[list[str], str]], default: Column) -> Column:
    """The name of the first rule that lists the value."""
    out = None
    for names, to in rules:
        out = F.when(value.isin(names), to) if out is None else out.when(value.isin(names), to)
    return default if out is None else out.otherwise(default)


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern is found."""
    out = None
    for pattern, to in rules:
        out = F.when(text.rlike(pattern), to) if out is None else out.when(text.rlike(pattern), to)
    return out.otherwise(default)


def by_locale(text: Column) -> Column:
    """A text that sorts, groups and joins as readers expect: accents and case count last, not first."""
    return F.collate(text, "UNICODE")


def alike(text: Column) -> Column:
    """A text that equals those that differ from it in case and accents alone."""
    return F.collate(text, "UNICODE_CI_AI")
