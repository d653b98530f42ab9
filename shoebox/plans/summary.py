"""Plan summaries, limits, fingerprints and invariants; checks return violations, and a plan is valid if there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .checks import Checks, differences


def plan_summary(assets: DataFrame) -> DataFrame:
    """A-9: assets (byte_len, associations) -> one row; associations count sidecars attached, not files."""
    return assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("associations"), F.lit(0)).alias("sidecars"), F.coalesce(F.sum("byte_len"), F.lit(0)).alias("bytes_read"))


def upload_summary(operations: DataFrame) -> DataFrame:
    """A-10: (byte_len, xmp, pair_id) -> one row."""
    return operations.agg(F.count("*").alias("operations"), F.sum("byte_len").alias("media_bytes"), F.count("xmp").alias("xmp"), F.countDistinct("pair_id").alias("pairs"))


def import_summary(operations: DataFrame, version: int = 2) -> DataFrame:
    """A-11: (has_metadata, albums) -> one row: counts and the ceiling of mutations: operations + metadata updates + two an album, as creating an album
    and adding to it are one request each. Version 1 plans change neither metadata nor albums, and their ceiling is 0."""
    albums = operations.select(F.explode("albums").alias("album")).agg(F.countDistinct("album").alias("album_creates"))
    x = operations.agg(F.count("*").alias("operations"), F.count_if("has_metadata").alias("metadata_updates")).crossJoin(F.broadcast(albums))  # one row each
    if version == 1:
        x = x.withColumn("metadata_updates", F.lit(0).cast("bigint")).withColumn("album_creates", F.lit(0).cast("bigint"))
    x = x.withColumn("album_memberships", F.col("album_creates"))
    return x.withColumn("max_mutations", F.lit(0).cast("bigint") if version == 1 else F.col("operations") + F.col("metadata_updates") + 2 * F.col("album_creates"))


def migration_summary(assets: DataFrame, albums: DataFrame) -> DataFrame:
    """A-12: assets (byte_len, has_metadata), planned albums (one row each) -> one row; the ceiling counts planned albums, with members or not."""
    planned = albums.agg(F.count("*").alias("album_creates"))
    x = assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("byte_len"), F.lit(0)).alias("media_bytes"), F.count_if("has_metadata").alias("metadata_updates")).crossJoin(F.broadcast(planned))  # one row each
    return x.withColumn("album_memberships", F.col("album_creates")).withColumn("max_mutations", F.col("assets") + F.col("metadata_updates") + 2 * F.col("album_creates"))


def archive_summary(assets: DataFrame) -> DataFrame:
    """A-13: (byte_len) -> (assets, media_bytes). The sum is checked: beyond 64 bits it fails."""
    return assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum(F.col("byte_len").cast("decimal(38,0)")), F.lit(0)).alias("n")).select("assets", F.col("n").cast("bigint").alias("media_bytes"))


def album_members(operations: DataFrame, asset_ids: DataFrame) -> DataFrame:
    """A-16: operations (operation_id, albums), asset_ids (operation_id, asset_id) -> (album, members: sorted set); operations without an id add nothing."""
    rows = operations.select("operation_id", F.explode("albums").alias("album")).join(asset_ids, "operation_id").select("album", "asset_id").distinct()
    return rows.groupBy("album").agg(F.array_sort(F.collect_list("asset_id")).alias("members"))


def numbered(rows: DataFrame, *keys: str, parts: int | None = None, name: str = "nth") -> DataFrame:
    """rows with their place, from 1, in the order of keys of any type: ranges of keys are sorted by a task each, and the sizes of the ranges before it are
    added to a row's place in its own. Rows of equal keys are told apart by their content, so only rows that are equal throughout share a range. Ranges are
    written once; the driver sees a number for each."""
    tie = F.xxhash64(*rows.columns)
    ranges = rows.withColumn("_tie", tie)
    ranges = ranges.repartitionByRange(parts, *keys, "_tie") if parts else ranges.repartitionByRange(*keys, "_tie")
    placed = cut(ranges.sortWithinPartitions(*keys, "_tie").withColumn("_id", F.monotonically_increasing_id()).drop("_tie"))
    placed = placed.withColumns({"_range": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_before", before).drop("n")
    out = placed.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_nth") + 1)  # a row for each range
    return out.select(*rows.columns, name)


def bounded_inventory(assets: DataFrame, page_size: int, max_assets: int, parts: int | None = None) -> DataFrame:
    """O-3: assets (id) -> + page, numbered from 1 in the order of ids of any type; more than ``max_assets`` fail."""
    n = assets.count()
    if n > max_assets:
        raise ValueError(f"limit exceeded: {n} assets")
    return numbered(assets, "id", parts=parts, name="_place").withColumn("page", F.floor((F.col("_place") - 1) / page_size) + 1).drop("_place")


def limit_violations(files: DataFrame, max_entries: int, max_per_dir: int, max_bytes: int, max_total: int) -> DataFrame:
    """A-18: (dir, byte_len) -> (limit, key, value) beyond a limit; fails closed if any."""
    per_dir = files.groupBy("dir").agg(F.count("*").alias("value"), F.max("byte_len").alias("largest"), F.sum("byte_len").alias("total"))
    rows = [
        per_dir.where(F.col("value") > max_per_dir).select(F.lit("directory").alias("limit"), F.col("dir").alias("key"), "value"),
        per_dir.where(F.col("largest") > max_bytes).select(F.lit("asset_bytes").alias("limit"), F.col("dir").alias("key"), F.col("largest").alias("value")),
        per_dir.agg(F.sum("value").alias("value")).where(F.col("value") > max_entries).select(F.lit("entries").alias("limit"), F.lit("").alias("key"), "value"),
        per_dir.agg(F.sum("total").alias("value")).where(F.col("value") > max_total).select(F.lit("total_bytes").alias("limit"), F.lit("").alias("key"), "value"),
    ]
    return reduce(DataFrame.unionByName, rows)


def plan_limit_violations(assets: DataFrame, members: DataFrame, max_assets: int, max_albums: int, max_memberships: int, max_album_members: int) -> DataFrame:
    """A-18 for plans: assets (one row each), members (album, asset_id) -> (limit, key, value) beyond a limit."""
    albums = members.groupBy("album").agg(F.count("*").alias("value"))
    total = albums.agg(F.count("*").alias("albums"), F.coalesce(F.sum("value"), F.lit(0)).alias("memberships"))
    one = lambda df, name, most: df.where(F.col("value") > most).select(F.lit(name).alias("limit"), F.lit("").alias("key"), "value")
    rows = [
        one(assets.agg(F.count("*").alias("value")), "assets", max_assets),
        one(total.select(F.col("albums").alias("value")), "albums", max_albums),
        one(total.select(F.col("memberships").alias("value")), "memberships", max_memberships),
        albums.where(F.col("value") > max_album_members).select(F.lit("album_members").alias("limit"), F.col("album").alias("key"), "value"),
    ]
    return reduce(DataFrame.unionByName, rows)


def tree_fingerprint(rows: DataFrame, column: str, width: int = 4) -> DataFrame:
    """A-17 at scale: digests of sorted digests, by their first ``width`` hex digits, then by two less, up to one. A leaf holds rows / 16**width
    digests of 64 bytes: 65,536 leaves by default; take a larger width above about 10**11 rows. Not the single-fold fingerprint."""
    level = rows.select(F.sha2(F.col(column), 256).alias("d")).groupBy(F.left("d", F.lit(width)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    while width:
        width = max(0, width - 2)
        level = level.groupBy(F.left("b", F.lit(width)).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    return level.select(F.col("d").alias("fingerprint"))


def ordered_fingerprint(assets: DataFrame, sidecars: DataFrame, findings: DataFrame, max_rows: int = 100_000, version: int = 2) -> DataFrame:
    """A-17 exactly: one fold over assets (relative_path, content_sha256, byte_len, metadata), sidecars (path, byte_len, sha256) and findings (severity,
    rule_id, paths), warnings before errors. The fold is serial by definition, so more than ``max_rows`` rows fail; see ``tree_fingerprint``. Version 3 leaves out lengths and sidecars and adds albums."""
    from ..functions import expr as X

    if version == 3:
        sidecars = sidecars.limit(0)

    if assets.limit(max_rows + 1).count() + sidecars.limit(max_rows + 1).count() + findings.limit(max_rows + 1).count() > max_rows:
        raise ValueError("too many rows for the ordered fingerprint")
    text = lambda x: F.col(x).cast("string")
    fields = {
        0: assets.select(F.struct("relative_path").alias("key"), F.concat(F.array("relative_path", "content_sha256", *([text("byte_len")] if version < 3 else [])), F.flatten(F.transform("metadata", lambda m: F.array(m["relative_path"], m["rule_id"]))), *([F.coalesce(F.col("normalized_metadata.albums"), F.array().cast("array<string>"))] if version == 3 else [])).alias("f")),
        1: sidecars.select(F.struct(F.col("path").alias("relative_path")).alias("key"), F.array("path", text("byte_len"), "sha256").alias("f")),
        2: findings.select(F.struct(F.concat(F.when(F.col("severity") == "warning", "0").otherwise("1"), "rule_id", F.lit(" "), "code", F.lit(" "), F.array_join("paths", " ")).alias("relative_path")).alias("key"), F.concat(F.array("rule_id"), "paths").alias("f")),
    }
    every = reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(i)) for i, df in fields.items()])
    bits = F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "f"))), lambda x: x["f"])), X.length_prefixed)
    return every.agg(F.sha2(F.aggregate(bits, F.encode(F.lit("apple-photos-source-v1\0" if version == 3 else "normalized-plan-source-v1\0"), "UTF-8"), lambda a, b: F.concat(a, b)), 256).alias("fingerprint"))


def json_fingerprint(assets: DataFrame, findings: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A-17 exactly, for version 4: the digest of assets, warnings and errors as one compact JSON text. Serial and bounded like ``ordered_fingerprint``."""
    if assets.limit(max_rows + 1).count() + findings.limit(max_rows + 1).count() > max_rows:
        raise ValueError("too many rows for the ordered fingerprint")
    whole = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    names = ["operation_id", "relative_path", "media_kind", "byte_len", "content_sha256", "metadata", "normalized_metadata", "live_photo", "evidence"]
    line = F.when(F.col("normalized_metadata").isNull(), whole(*[n for n in names if n != "normalized_metadata"])).otherwise(whole(*names))  # left out where there are none; other nulls stay
    listed = lambda df, key, line: df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("key"), line.alias("line")))), lambda x: x["line"]), ","), F.lit("]")).alias("x"))
    parts = [listed(assets, F.col("relative_path"), line)]
    parts += [listed(findings.where(F.col("severity") == s), F.struct("rule_id", "code", "paths"), whole("rule_id", "code", "paths")) for s in ("warning", "error")]
    every = reduce(DataFrame.unionByName, [p.withColumn("i", F.lit(i)) for i, p in enumerate(parts)])  # three rows
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda x: x["x"]), ",")
    return every.agg(F.sha2(F.concat(F.lit("picasa-source-v1\0["), text, F.lit("]")), 256).alias("fingerprint"))


def _violation(df: DataFrame, check: str, key: str) -> DataFrame:
    return df.select(F.lit(check).alias("check_id"), F.col(key).cast("string").alias("key"))


#: Schema version of a plan -> source kinds that may have it.
VERSIONS = {1: ("folder", "google_takeout"), 2: ("google_takeout",), 3: ("apple_photos",), 4: ("picasa",)}


def _fits(version, kind):
    fine = F.lit(False)
    for v, kinds in VERSIONS.items():
        fine = fine | ((version == v) & kind.isin(*kinds))
    return F.coalesce(fine, F.lit(False))


def _hex(column: str, n: int = 64):
    return F.coalesce(F.col(column).rlike(f"^[0-9a-f]{{{n}}}$"), F.lit(False))


def _identities(path: str = "path", sha256: str = "sha256") -> Checks:
    """V-1, identities of rows with operation_id, byte_len, a path and a digest."""
    row = F.expr(f"{path} <> '' and {path} not like '/%' and byte_len >= 0")
    return Checks(F.col(path), {"sha256": ~_hex(sha256), "row": ~F.coalesce(row, F.lit(False))}, {"path_unique": F.col(path), "operation_unique": F.col("operation_id")})


def plan_violations(assets: DataFrame) -> DataFrame:
    """V-1, identities: (operation_id, path, byte_len, sha256) -> (check_id, key). An absent value is a violation like a wrong one."""
    return Checks.violations(_identities().facts(assets))


def normalized_plan_violations(assets: DataFrame, findings: DataFrame, summary: DataFrame, source: DataFrame) -> DataFrame:
    """V-1 whole: assets, findings and summary of a plan, source (schema_version, kind, label, fingerprint_sha256) -> (check_id, key). The assets are read once."""
    version = source.select("schema_version").first()  # one row
    one, known = F.lit(bool(version and version[0] == 1)), F.col("normalized_metadata")
    empty = lambda a: F.exists(a, lambda x: F.coalesce(x["rule_id"] == "", F.lit(True)))
    base = _identities("relative_path", "content_sha256")
    own = {"operation_id": ~_hex("operation_id"), "rule_id": empty("evidence") | empty("metadata"), "metadata_in_version_1": known.isNotNull() & one}
    own |= {name: known.isNotNull() & F.coalesce(bad, F.lit(False)) for name, bad in metadata_checks(lambda f: known[f], {"description", "location"}, "taken_at_utc").items()}
    checks = Checks(base.key, base.failed | own, base.unique, totals={"assets": F.lit(1), "sidecars": F.size("metadata")})
    facts = checks.facts(assets)
    wrong = findings.where(F.col("rule_id").isNull() | (F.col("rule_id") == "") | ~F.col("severity").isin("warning", "error") | (F.size("paths") > 8))
    return reduce(DataFrame.unionByName, [
        Checks.violations(facts),
        _violation(wrong, "finding", "code"),
        _violation(source.where(~_fits(F.col("schema_version"), F.col("kind"))), "schema_source", "kind"),
        _violation(source.where(F.coalesce(F.col("label") == "", F.lit(True)) | ~_hex("fingerprint_sha256")), "source", "kind"),
        differences(summary, checks.sums(facts), "summary"),
    ])


def upload_violations(operations: DataFrame) -> DataFrame:
    """V-2, pairs: (operation_id, pair_id, role): a pair has one image and one video; a role needs a pair."""
    pairs = operations.where("pair_id is not null").groupBy("pair_id").agg(F.count_if(F.col("role") == "image").alias("i"), F.count_if(F.col("role") == "video").alias("v"))
    return _violation(pairs.where("i <> 1 or v <> 1"), "pair", "pair_id").unionByName(_violation(operations.where("(pair_id is null) <> (role is null)"), "role", "operation_id"))


def dependency_violations(operations: DataFrame) -> DataFrame:
    """V-2, V-3: (operation_id, pair_id, role, video_operation_id): an image of a pair names a video operation of the same pair."""
    video = operations.where("role = 'video'").select(F.col("operation_id").alias("video_operation_id"), F.col("pair_id").alias("video_pair"))
    images = operations.where("role = 'image'").join(video, "video_operation_id", "left")
    return _violation(images.where("not coalesce(video_pair = pair_id, false)"), "dependency", "operation_id")


def whole_upload_violations(operations: DataFrame, summary: DataFrame, version: int) -> DataFrame:
    """V-2 whole: operations (operation_id, path, byte_len, sha256, pair_id, role, video_operation_id, xmp struct<path,byte_len,sha256>, has_metadata,
    albums) and their summary (operations, media_bytes, xmp, pairs, metadata_updates, album_creates, album_memberships, max_mutations) -> (check_id, key).
    All but the dependencies are one pass."""
    xmp, image = F.col("xmp"), F.col("role") == "image"
    bad_xmp = xmp.isNotNull() & ~F.coalesce((xmp["path"] != "") & (xmp["byte_len"] > 0) & xmp["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False))
    base = _identities()
    failed = base.failed | {"operation_id": ~_hex("operation_id"), "empty": ~F.coalesce(F.col("byte_len") > 0, F.lit(False)), "xmp": bad_xmp}
    if version == 1:
        failed["metadata_in_version_1"] = F.coalesce(F.col("has_metadata"), F.lit(False)) | F.coalesce(F.size("albums") > 0, F.lit(False))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    totals = {"operations": F.lit(1), "media_bytes": F.col("byte_len"), "xmp": yes(xmp.isNotNull()), "pairs": yes(image), "metadata_updates": yes(F.col("has_metadata")) if version > 1 else F.lit(0)}
    checks = Checks(base.key, failed, base.unique, {"album_creates": F.col("albums")}, totals)
    facts = checks.facts(operations)
    own = checks.sums(facts)
    if version == 1:
        own = own.withColumn("album_creates", F.lit(0).cast("bigint"))
    own = own.withColumn("album_memberships", F.col("album_creates")).withColumn("max_mutations", F.lit(0).cast("bigint") if version == 1 else F.col("operations") + F.col("metadata_updates") + 2 * F.col("album_creates"))
    return reduce(DataFrame.unionByName, [Checks.violations(facts), dependency_violations(operations), differences(summary, own, "summary")])


def migration_violations(assets: DataFrame, albums: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """V-3: assets (source_asset_id, operation_id, original_file_name, byte_len, checksum_sha1, content_sha256, created_ms, modified_ms, pair_id, role,
    video_operation_id, has_metadata), albums (name, member_operation_ids) -> (check_id, key). Members must be known, sorted and distinct."""
    from ..functions import expr as X

    time = lambda c: F.col(c).between(-62_135_596_800_000, 253_402_300_799_999)  # noqa: E731  # years 1 to 9999
    fine = X.is_uuid4(F.col("source_asset_id")) & X.safe_name(F.col("original_file_name")) & (F.col("byte_len") > 0) & time("created_ms") & time("modified_ms")
    fine = F.coalesce(fine, F.lit(False)) & _hex("operation_id") & _hex("checksum_sha1", 40) & _hex("content_sha256")
    ids = F.col("member_operation_ids")
    name = F.coalesce(F.octet_length("name").between(1, 4096) & ~F.col("name").rlike(r"[\\\x00-\x1F\x7F-\x9F]"), F.lit(False))
    members = albums.select("name", F.explode("member_operation_ids").alias("operation_id"))
    parts = [
        _violation(assets.where(~fine), "asset", "source_asset_id"),
        _violation(assets.groupBy("source_asset_id").count().where("count > 1"), "asset_unique", "source_asset_id"),
        _violation(assets.groupBy("operation_id").count().where("count > 1"), "operation_unique", "operation_id"),
        dependency_violations(assets),
        _violation(albums.where(~name | ~F.coalesce((F.size(ids) > 0) & (F.array_sort(F.array_distinct(ids)) == ids), F.lit(False))), "album", "name"),
        _violation(albums.groupBy("name").count().where("count > 1"), "album_unique", "name"),
        _violation(members.join(assets.select("operation_id"), "operation_id", "left_anti").select("name").distinct(), "album_member", "name"),
    ]
    if summary is not None:
        parts.append(_violation(summary.exceptAll(migration_summary(assets, albums)), "summary", "assets"))
    return reduce(DataFrame.unionByName, parts)


def _archive_checks() -> Checks:
    from ..functions import expr as X

    ident, name = F.col("asset_id"), F.col("original_file_name")
    fine = X.is_uuid4(ident) & X.safe_name(name) & X.is_hex(F.col("checksum_sha1"), 40) & (F.col("byte_len") >= 0) & (F.col("target_path") == X.target_path(ident, name))
    return Checks(ident, {"asset": ~F.coalesce(fine, F.lit(False))}, {"asset_unique": ident, "path_unique": F.col("target_path")}, totals={"assets": F.lit(1), "media_bytes": F.col("byte_len")})


def archive_violations(assets: DataFrame) -> DataFrame:
    """V-4: manifest rows (asset_id, original_file_name, target_path, byte_len, checksum_sha1) -> (check_id, key).
    An absent value is a violation like a wrong one."""
    return Checks.violations(_archive_checks().facts(assets))


#: The manifest's and report's schema version, and the server version that they are for.
ARCHIVE_VERSION, SERVER_VERSION = 1, (3, 1)


def archive_manifest_violations(assets: DataFrame, manifest: DataFrame) -> DataFrame:
    """V-4 whole: rows as ``archive_violations`` and the manifest's one row (schema_version, configuration_sha256, identity_sha256, major, minor, assets,
    media_bytes) -> (check_id, key). The assets are read once."""
    checks = _archive_checks()
    facts = checks.facts(assets)
    version = F.coalesce(F.col("schema_version") == ARCHIVE_VERSION, F.lit(False))
    server = F.coalesce((F.col("major") == SERVER_VERSION[0]) & (F.col("minor") == SERVER_VERSION[1]), F.lit(False))
    return reduce(DataFrame.unionByName, [
        Checks.violations(facts),
        _violation(manifest.where(~version), "schema", "schema_version"),
        _violation(manifest.where(~(_hex("configuration_sha256") & _hex("identity_sha256") & server)), "identity", "identity_sha256"),
        differences(manifest, checks.sums(facts), "summary"),
    ])


def archive_report_violations(reports: DataFrame, expected: DataFrame) -> DataFrame:
    """V-4: reports (manifest_sha256, schema_version, downloaded, already_complete), expected (manifest_sha256, assets) -> (check_id, key): a report's version and
    identity, and that what was downloaded and what was there add up to the manifest's assets. A report of no known manifest fails too."""
    known = reports.join(expected.select("manifest_sha256", "assets"), "manifest_sha256", "left")
    fine = (F.col("schema_version") == ARCHIVE_VERSION) & _hex("manifest_sha256") & (F.col("downloaded").cast("decimal(38,0)") + F.col("already_complete") == F.col("assets"))
    return _violation(known.where(~F.coalesce(fine, F.lit(False))), "report", "manifest_sha256")


def metadata_checks(field, known: set[str], time: str) -> dict:
    """V-7: check -> whether metadata fail it; ``field`` gives a column by name, ``known`` tells which of description and location there are. Null where absent."""
    from ..functions import expr as X

    albums = field("albums")
    out = {
        "albums": F.array_sort(F.array_distinct(albums)) != albums,
        "album_name": F.exists(albums, lambda a: (F.octet_length(a) == 0) | (F.octet_length(a) > 4096) | a.rlike(r"[\\\x00-\x1F\x7F-\x9F]")),
        "taken_at": ~field(time).eqNullSafe(X.canonical_utc(field(time))),
    }
    if "description" in known:
        out["description"] = ~X.text_valid(field("description"), 16 * 1024, True)
    if "location" in known:
        def half(name: str, most: int):
            text = field("location")[name]
            number = text.try_cast("double")
            return F.coalesce((X.canonical_decimal(number) == text) & number.between(-most, most), F.lit(False))

        out["location"] = field("location").isNotNull() & ~(half("latitude", 90) & half("longitude", 180))
    return out


def metadata_violations(assets: DataFrame) -> DataFrame:
    """V-7: (path, albums, taken_at_utc or taken_at[, description, location]) -> (check_id, key): albums must be strictly increasing and valid, times and
    decimals in their canonical form, coordinates in range, descriptions valid. Absent values are fine."""
    time = "taken_at_utc" if "taken_at_utc" in assets.columns else "taken_at"
    failed = {name: F.coalesce(bad, F.lit(False)) for name, bad in metadata_checks(F.col, set(assets.columns), time).items()}
    return Checks.violations(Checks(F.col("path"), failed).facts(assets))
