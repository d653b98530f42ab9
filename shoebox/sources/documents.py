"""Text sources: JSON sidecars, INI files, inventory and album pages, plan documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..diagnostics import finding, gather
from ..functions import expr as X
from ..operators.matching import carry_section

GEO = "struct<latitude:double,longitude:double>"
LOCATION = "struct<latitude:string,longitude:string>"
INVENTORY = "assets struct<items:array<struct<id:string,originalFileName:string,checksum:string,type:string,exifInfo:struct<fileSizeInByte:bigint,dateTimeOriginal:string,description:string,latitude:double,longitude:double>,fileCreatedAt:string,fileModifiedAt:string,livePhotoVideoId:string>>,count:bigint,nextPage:string,total:bigint>"
_FINDINGS = "array<struct<rule_id:string,code:string,paths:array<string>>>"
_ASSET = {
    "operation_id": "string", "relative_path": "string", "media_kind": "string", "byte_len": "bigint", "content_sha256": "string", "metadata": "array<struct<relative_path:string,kind:string,rule_id:string>>",
    "normalized_metadata": f"struct<description:string,taken_at_utc:string,location:{LOCATION},albums:array<string>>", "live_photo": "struct<pair_id:string,role:string>", "evidence": "array<struct<rule_id:string,outcome:string>>",
}
PLAN_ASSET = ", ".join(f"{name} {kind}" for name, kind in _ASSET.items())
PLAN = (
    "schema_version int, source struct<kind:string,label:string,fingerprint_sha256:string,case_sensitive:boolean,unicode_normalization:string>, "
    f"assets array<struct<{','.join(map(':'.join, _ASSET.items()))}>>, warnings {_FINDINGS}, errors {_FINDINGS}, summary struct<assets:bigint,sidecars:bigint,bytes_read:bigint>"
)
#: Limits of INI documents and of sidecar texts.
INI_BYTES, INI_LINES, INI_LINE_BYTES, INI_SECTIONS = 1_048_576, 20_000, 16_384, 10_000
JSON_BYTES, TITLE_BYTES, DESCRIPTION_BYTES = 256 * 1024, 4096, 16 * 1024


def parse_json(df: DataFrame, column: str, fields: dict[str, str], max_bytes: int = JSON_BYTES) -> DataFrame:
    """S-4: df + one column a field (dotted paths) + invalid. Unknown keys are ignored; malformed texts, duplicate keys and
    texts above the cap are invalid and give nulls."""
    doc = F.try_parse_json(F.when(F.octet_length(column) <= max_bytes, F.col(column)))
    out = df.withColumn("_doc", doc)
    return out.select(*df.columns, *[F.try_variant_get("_doc", f"$.{path}", kind).alias(path.split(".")[0]) for path, kind in fields.items()], (F.col("_doc").isNull() & F.col(column).isNotNull()).alias("invalid"))


def _kind(doc: Column, path: str) -> Column:
    """Type of a JSON value: null where there is none, or where it is null."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return F.when(kind != "VOID", kind)


def read_sidecar_json(sidecars: DataFrame, album_titles: bool = True) -> DataFrame:
    """S-4: sidecars (path, byte_len, text) of JSON -> (path, title, description, taken_at_utc, location, error: null, invalid or oversized).

    Types are strict: a title that is a number, or coordinates without a half, make the document invalid. Only an album document may
    have an empty title, and only with ``album_titles``; its directory's name is then the title. F-9 to F-15 are applied.
    """
    doc = F.col("doc")
    kinds = {f"k_{n.replace('.', '_')}": _kind(doc, f"$.{n}") for n in ("title", "description", "photoTakenTime", "photoTakenTime.timestamp", "creationTime", "creationTime.timestamp", "geoDataExif", "geoData")}
    halves = {f"{g}_{h}": f"$.{g}.{h}" for g in ("geoDataExif", "geoData") for h in ("latitude", "longitude")}
    d = sidecars.select("path", "byte_len", F.try_parse_json(F.when(F.col("byte_len") <= JSON_BYTES, F.col("text"))).alias("doc")).withColumns(kinds)
    d = d.withColumns({f"k_{n}": _kind(doc, p) for n, p in halves.items()} | {f"n_{n}": F.try_variant_get(doc, p, "double") for n, p in halves.items()})
    text = lambda n: F.when(F.col(f"k_{n.replace('.', '_')}") == "STRING", F.try_variant_get(doc, f"$.{n}", "string"))
    geo = {g: F.when(F.col(f"k_{g}").isNotNull(), F.struct(F.col(f"n_{g}_latitude").alias("latitude"), F.col(f"n_{g}_longitude").alias("longitude"))) for g in ("geoDataExif", "geoData")}
    times = {n: F.when(F.col(f"k_{n}").isNotNull(), F.coalesce(text(f"{n}.timestamp"), F.lit(""))) for n in ("photoTakenTime", "creationTime")}
    d = d.withColumns({"raw_title": text("title"), "description": X.description(text("description")), "time": X.capture_time(*times.values())} | geo)
    d = d.withColumns({"taken_at_utc": X.epoch_to_utc(F.col("time")), "location": X.location(*map(F.col, geo))})
    other = lambda k, pattern: F.col(f"k_{k}").isNotNull() & ~F.col(f"k_{k}").rlike(pattern)
    title, empty_ok = F.col("raw_title"), X.is_album_document(F.col("path")) & F.lit(album_titles)
    bad = [
        doc.isNull(),
        title.isNull() | ~(X.text_valid(title, TITLE_BYTES) | (empty_ok & (title == ""))),
        other("description", "^STRING$"),
        F.col("description").isNotNull() & ~X.text_valid(F.col("description"), DESCRIPTION_BYTES, True),
        *[F.col(f"k_{n}").isNotNull() & ~F.coalesce(F.col(f"k_{n}_timestamp") == "STRING", F.lit(False)) for n in times],
        F.col("time").isNotNull() & F.col("taken_at_utc").isNull(),
        *[other(g, "^OBJECT") for g in geo],
        *[other(n, "^(BIGINT|DOUBLE|FLOAT|DECIMAL)") for n in halves],
        X.geo_invalid(*map(F.col, geo)),
    ]
    d = d.withColumn("wrong", F.exists(F.array(*[F.coalesce(b, F.lit(True)) for b in bad]), lambda x: x))
    d = d.withColumn("error", F.when(F.col("byte_len") > JSON_BYTES, "oversized").when(F.col("wrong"), "invalid"))
    fine = lambda x: F.when(F.col("error").isNull(), x)
    named = F.when(title == "", X.filename(X.parent(F.col("path")))).otherwise(title)
    return d.select("path", fine(named).alias("title"), *[fine(F.col(c)).alias(c) for c in ("description", "taken_at_utc", "location")], "error")


def json_findings(docs: DataFrame) -> DataFrame:
    return gather(finding(docs.where("error = 'invalid'"), "invalid_takeout_json", F.col("path")), finding(docs.where("error = 'oversized'"), "takeout_json_size_limit_exceeded", F.col("path")))


def ini_settings(lines: DataFrame) -> DataFrame:
    """S-5: (file, line, text) -> (file, section, key, value, conflict); a key with two values in a section is a conflict."""
    opened = F.nullif(F.regexp_extract("text", r"^\s*\[(.*)\]\s*$", 1), F.lit(""))
    known = carry_section(lines, opened).where(~F.startswith("text", F.lit("[")) & F.contains("text", F.lit("=")))
    pairs = known.select("file", "section", F.trim(F.substring_index("text", "=", 1)).alias("key"), F.regexp_extract("text", r"=\s*(.*?)\s*$", 1).alias("value"))
    return pairs.groupBy("file", "section", "key").agg((F.min("value") != F.max("value")).alias("conflict"), F.min("value").alias("value"))


def ini_lines(files: DataFrame) -> DataFrame:
    """(path, text) of INI files -> (dir, file, line, text, bytes)."""
    return files.select(X.parent(F.col("path")).alias("dir"), F.col("path").alias("file"), F.octet_length("text").alias("bytes"), F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))


def read_ini(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S-5: INI files (path, text; text null where it is not UTF-8 or unreadable) -> (dir_albums (dir, album), captions (dir, name, caption), findings).

    A syntax error, a conflict, a bad value or an exceeded limit makes the whole document invalid. So do two documents of one directory,
    even equal ones; the first by path still applies.
    """
    raw = ini_lines(files)
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = raw.withColumn("text", trimmed).where((F.col("text") != "") & ~F.col("text").rlike("^[;#]"))
    name = F.regexp_extract("text", r"^\[(.*)\]$", 1)
    is_open = F.startswith("text", F.lit("["))
    rows = carry_section(rows.withColumn("opens", is_open), F.when(is_open, name))
    key, value = F.trim(F.substring_index("text", "=", 1)), F.regexp_extract("text", r"(?s)=\s*(.*)$", 1)
    control = r"[\x00-\x1F\x7F-\x9F]"
    is_name = (F.lower("section") == "picasa") & (F.lower("key") == "name")
    is_caption = ~is_name & (F.lower("key") == "caption")
    rows = rows.withColumn("key", key).withColumn("value", value)
    wrong = (
        F.when(F.col("opens"), (name == "") | (F.octet_length(name) > 4096) | name.rlike(control))
        .when(~F.contains("text", F.lit("=")) | F.col("section").isNull(), True)
        .when((F.col("key") == "") | (F.octet_length("key") > 256) | (F.octet_length("value") > 16_384), True)
        .when(is_name, ~X.text_valid(F.col("value"), 4096))
        .when(is_caption, (F.col("value") == "") | F.col("value").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"))
        .otherwise(False)
    )
    judged = rows.select("dir", "file", "section", "opens", "value", F.coalesce(wrong, F.lit(True)).alias("wrong"), F.when(~F.col("opens") & is_name, "album").when(~F.col("opens") & is_caption, "caption").alias("what"))
    clash = judged.where("what is not null").groupBy("file", "what", F.when(F.col("what") == "caption", F.col("section")).alias("section")).agg((F.min("value") != F.max("value")).alias("two"), F.min("value").alias("value"))
    size = raw.groupBy("file").agg((F.max("line") >= INI_LINES).alias("long"), (F.max("bytes") > INI_BYTES).alias("large"), (F.max(F.octet_length("text")) > INI_LINE_BYTES).alias("wide"))
    sections = judged.where("opens").groupBy("file").agg(F.count("*").alias("n"))
    bad = judged.where("wrong").select("file").unionByName(clash.where("two").select("file")).unionByName(size.where("long or large or wide").select("file")).unionByName(sections.where(F.col("n") > INI_SECTIONS).select("file")).unionByName(files.where("text is null").select(F.col("path").alias("file"))).distinct()
    good = files.select(F.col("path").alias("file"), X.parent(F.col("path")).alias("dir")).join(bad, "file", "left_anti")
    first = good.groupBy("dir").agg(F.min("file").alias("file"), F.count("*").alias("n"))
    kept = clash.join(first.select("dir", "file"), "file")
    twice = files.select(X.parent(F.col("path")).alias("dir")).groupBy("dir").agg(F.count("*").alias("n")).where("n > 1").select("dir")
    dirs = bad.select(X.parent(F.col("file")).alias("dir")).unionByName(twice).distinct()
    found = finding(dirs, "invalid_picasa_ini", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")))
    return kept.where("what = 'album'").select("dir", F.col("value").alias("album")), kept.where("what = 'caption'").select("dir", F.col("section").alias("name"), F.col("value").alias("caption")), found


def _pages(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Pages with their listing (the file's directory) and number. The last page has no successor's number: it follows the largest one before it. Only last
    pages meet what is counted of their listing, so a listing's pages stay where they are read."""
    pages = spark.read.schema(INVENTORY).option("multiLine", multi_line).json(path).select("assets", F.col("_metadata.file_path").alias("file"))
    pages = pages.withColumn("listing", X.parent(F.col("file"))).withColumn("next", F.col("assets.nextPage").cast("bigint"))
    largest = pages.groupBy("listing").agg(F.max("next").alias("page"))
    last = pages.where("next is null").join(largest, "listing").withColumn("page", F.coalesce("page", F.lit(1).cast("bigint")))
    return pages.where("next is not null").withColumn("page", F.col("next") - 1).unionByName(last)


def read_inventory(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """S-6: exported search pages, one directory a listing -> (assets with their listing, pages (listing, page, items, declared)).
    ``multi_line``: a page a file; else a page a line."""
    pages = _pages(spark, path, multi_line)
    return pages.select("listing", F.explode("assets.items").alias("x")).select("listing", "x.*"), pages.select("listing", "page", F.size("assets.items").alias("items"), F.col("assets.count").alias("declared"))


def read_albums(spark: SparkSession, path: str, assets: DataFrame, multi_line: bool = True) -> DataFrame:
    """S-7: pages of album members, one directory an album -> (album, asset_id) of assets that are in scope (id), once each. An album without any is left out."""
    members, _ = read_inventory(spark, path, multi_line)
    known = members.select(F.element_at(F.split(F.url_decode("listing"), "/"), -1).alias("album"), F.col("id").alias("asset_id"))
    return known.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").select("album", "asset_id").distinct()


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """S-9: assets of committed plan documents, one row each, with the schema version and source of their plan."""
    return spark.read.schema(PLAN).option("multiLine", True).json(path).select("schema_version", "source", F.explode("assets").alias("a")).select("schema_version", "source", "a.*")
