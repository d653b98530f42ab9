"""Scalar rules as Column expressions; all but ``nfc`` run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Extensions, export noise, reserved names and the supplemental marker.
IMAGES = ("jpg", "jpeg", "png", "heic", "heif", "webp", "gif", "tif", "tiff", "dng", "cr2", "cr3", "arw", "raf", "nef")
VIDEOS = ("mp4", "mov", "avi", "mkv", "m4v", "3gp")
NOISE = ("@eadir", ".spotlight-v100", ".photostructure", "recently deleted", ".ds_store", "thumbs.db")
SUPPLEMENTAL = "supplemental-metadata"
INI_NAME = ".picasa.ini"
TAKEOUT_PREFIX = "Takeout/Google Photos"
NO_ALBUM_DIRECTORIES = ("Archive", "Trash", "Bin")


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Before the last slash, or empty. These cut by lengths: patterns are an order slower, and Spark evaluates them wherever a filter needs them."""
    return F.substr(path, F.lit(1), F.length(path) - F.length(filename(path)) - 1)


def stem(path: Column) -> Column:
    """Before the last dot of the filename; the whole name without one; empty for a leading dot alone."""
    name = filename(path)
    last = F.length(F.substring_index(name, ".", -1))
    return F.when(last == F.length(name), name).otherwise(F.substr(name, F.lit(1), F.length(name) - last - 1))


def extension(path: Column) -> Column:
    """Lower-case; null without a dot or where only a leading dot is there."""
    name = filename(path)
    last = F.substring_index(name, ".", -1)
    return F.when((last != "") & (F.length(last) + 1 < F.length(name)), F.lower(last))


def media_kind(path: Column) -> Column:
    return F.when(extension(path).isin(*IMAGES), "image").when(extension(path).isin(*VIDEOS), "video")


def metadata_kind(path: Column) -> Column:
    return F.when(extension(path).isin("json", "xmp"), extension(path))


def skipped_prefix(path: Column, names: tuple[str, ...], beginnings: tuple[str, ...] = ()) -> Column:
    """The path up to its first component that has one of these names, in any case, or begins so; null without one."""
    parts = F.split(path, "/")
    noisy = F.transform(parts, lambda p: F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").isin(*names) | F.exists(F.array(*[F.lit(b) for b in (*beginnings, "\0")]), lambda b: F.startswith(p, b)))
    at = F.array_position(noisy, True)
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "/"))


def noise_prefix(path: Column) -> Column:
    """The path up to its first component of export noise; null without one."""
    return skipped_prefix(path, NOISE, ("._",))


def path_too_long(path: Column, max_bytes: int) -> Column:
    return F.octet_length(path) > max_bytes


def unsafe_entry(name: Column) -> Column:
    """Backslash, NUL, absolute, or a component that is empty, ``.`` or ``..``."""
    return name.rlike(r"[\\\x00]") | F.exists(F.split(name, "/"), lambda p: p.isin("", ".", ".."))


def entry_rejection(size: Column, csize: Column, method: Column, flags: Column, max_bytes: int, max_ratio: int, grace: int) -> Column:
    """Why an archive entry must not be read; null if it may."""
    whole = F.call_function("div", size, F.greatest(csize, F.lit(1)))  # integer division: exact for any length
    bomb = (size > grace) & ((csize <= 0) | (whole > max_ratio))
    return F.when(flags.bitwiseAND(1) == 1, "encrypted").when(~method.isin(0, 8), "unsupported_method").when(size > max_bytes, "too_large").when(bomb, "ratio")


def epoch_to_utc(text: Column) -> Column:
    """Digits of Unix seconds -> canonical UTC second; null beyond year 9999."""
    n = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
    return F.when(n <= 253402300799, F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def rfc3339_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def canonical_utc(text: Column) -> Column:
    return F.date_format(F.date_trunc("second", F.try_to_timestamp(text)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def canonical_decimal(x: Column) -> Column:
    """Shortest decimal without an exponent; zero of either sign is 0."""
    return F.when(x == 0, "0").otherwise(F.call_function("format_number", x, F.lit("0." + "#" * 30)))


def chosen_geo(exif: Column, geo: Column) -> Column:
    """exif wins wherever it is there, even as (0, 0)."""
    return F.when(exif.isNotNull(), exif).otherwise(geo)


def location(exif: Column, geo: Column) -> Column:
    """The chosen coordinates as canonical decimals; (0, 0) and invalid ones are no location (see ``geo_invalid``)."""
    use = chosen_geo(exif, geo)
    lat, lon = use["latitude"], use["longitude"]
    zero = (lat == 0) & (lon == 0)
    return F.when(use.isNotNull() & ~geo_invalid(exif, geo) & ~zero, F.struct(canonical_decimal(lat).alias("latitude"), canonical_decimal(lon).alias("longitude")))


def geo_invalid(exif: Column, geo: Column) -> Column:
    """The chosen coordinates lack a half or are out of range: the whole document is invalid."""
    use = chosen_geo(exif, geo)
    return use.isNotNull() & ~F.coalesce(use["latitude"].between(-90, 90) & use["longitude"].between(-180, 180), F.lit(False))


def hides_location(exif: Column, geo: Column) -> Column:
    """An exif (0, 0) that hides a plain location; for a metric."""
    zero = lambda g: (g["latitude"] == 0) & (g["longitude"] == 0)
    return F.coalesce(exif.isNotNull() & zero(exif) & geo.isNotNull() & ~zero(geo), F.lit(False))


def capture_time(taken: Column, created: Column) -> Column:
    """F-15: the time the photo was taken, else the time the document gives for its creation; taken wins wherever it is there."""
    return F.when(taken.isNotNull(), taken).otherwise(created)


def text_valid(text: Column, max_bytes: int, layout: bool = False) -> Column:
    """Not empty, within the cap, no control characters (layout: but for tab, line feed and return)."""
    bad = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]" if layout else r"[\x00-\x1F\x7F-\x9F/\\]"
    return (F.octet_length(text) > 0) & (F.octet_length(text) <= max_bytes) & ~text.rlike(bad)


def description(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def length_prefixed(x: Column) -> Column:
    """The text's bytes after their number as eight little-endian bytes."""
    h = F.lpad(F.hex(F.octet_length(x)), 16, "0")
    return F.concat(F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])), F.encode(x, "UTF-8"))


def stable_id(*fields: Column) -> Column:
    """sha256 over fields, each after its byte length as eight little-endian bytes."""
    return F.sha2(F.concat(*map(length_prefixed, fields)), 256)


def sha1_hex(base64: Column) -> Column:
    """40 hex digits of a base64 SHA-1; null unless it holds 20 bytes."""
    raw = F.try_to_binary(base64, F.lit("base64"))
    return F.when(F.octet_length(raw) == 20, F.lower(F.hex(raw)))


def is_uuid4(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_hex(x: Column, n: int) -> Column:
    return x.rlike(f"^[0-9a-f]{{{n}}}$")


def safe_name(x: Column) -> Column:
    """A filename that every common system accepts."""
    reserved = F.upper(F.substring_index(x, ".", 1)).rlike("^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])$")
    return F.octet_length(x).between(1, 255) & ~x.rlike(r"[/\\\x00-\x1F\x7F-\x9F]|[. ]$") & ~reserved


def filename_date(name: Column) -> Column:
    """YYYYMMDD-HHMMSS at the start of a name -> canonical UTC second; null if no such time exists."""
    return F.date_format(F.try_to_timestamp(F.regexp_extract(name, "^([0-9]{8}-[0-9]{6})", 1), F.lit("yyyyMMdd-HHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _beginnings(word: str) -> str:
    """A pattern for any non-empty beginning of word."""
    out = ""
    for letter in reversed(word):
        out = letter + (f"(?:{out})?" if out else "")
    return out


def indexed_target(name: Column) -> Column:
    """``a.jpg.supp(2).json`` and ``a.jpg(2).json`` -> ``a(2).jpg``; null for other names. A last part that begins the marker is never the extension."""
    mark = _beginnings(SUPPLEMENTAL)
    pattern = rf"(?s)^(?:(.+)\.([^.]+)\.{mark}|(.+)\.(?!{mark}\([0-9]+\)\.json$)([^.]+))\(([0-9]+)\)\.json$"
    return F.when(name.rlike(pattern), F.regexp_replace(name, pattern, "$1$3($5).$2$4"))


def album_from_path(path: Column, mode: str, joiner: str = " / ") -> Column:
    """mode: none, immediate (parent) or joined (all parents); null for files at the root."""
    up = F.nullif(parent(path), F.lit(""))
    return {"none": F.lit(None).cast("string"), "immediate": filename(up), "joined": F.array_join(F.split(up, "/"), joiner)}[mode]


def canonical_rank(path: Column) -> Column:
    return F.when(filename(parent(path)).rlike("^Photos from [0-9]{4}$"), 0).otherwise(1)


def is_album_document(path: Column) -> Column:
    folder = filename(parent(path))
    return (filename(path) == "metadata.json") & ~folder.isin(*NO_ALBUM_DIRECTORIES) & ~F.startswith(folder, F.lit("Photos from "))


def import_times(taken_ms: Column, created: Column, modified: Column, kind: Column) -> tuple[Column, Column]:
    """(created, modified) in ms: the capture time for both; else what the file has; 0 where a kind keeps no file times."""
    files = ~kind.isin("takeout")
    return F.coalesce(taken_ms, F.when(files, F.coalesce(created, modified)), F.lit(0)), F.coalesce(taken_ms, F.when(files, F.coalesce(modified, created)), F.lit(0))


def target_path(ident: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("assets"), ident, name)


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(x: Column) -> Column:
    """NFC. Spark has no function for it, so this is an Arrow UDF on every row; see ``with_nfc``."""
    return _nfc(x)


def with_nfc(df: DataFrame, column: str = "path") -> DataFrame:
    """df with the column in NFC. Only rows with a sign outside ASCII go through Python: Spark would run a UDF inside a
    condition on all rows, so the others take a branch of their own."""
    plain = F.coalesce(F.octet_length(column) == F.char_length(column), F.lit(True))
    rest = [F.col(f"`{c}`") for c in df.columns]
    odd = df.where(~plain).select(*[_nfc(F.col(column)).alias(column) if c == column else F.col(f"`{c}`") for c in df.columns])
    return df.where(plain).select(*rest).unionByName(odd)
