"""Whole plans: from media and sidecars to assets, findings and a summary.

Each matching step is a join on directory and name, each attachment one aggregation by path, so what one
task sees depends on a directory's or content's own rows only. What several steps read is written to the shared folder
once (``cut``), which keeps the plans that Spark has to optimise small; a lost executor redoes one step. ``Plan.discard`` deletes those tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import diagnostics as D
from ..functions import expr as X
from ..operators import aliases as A
from ..operators import matching as M
from ..sources import documents as S
from ..sources.archives import scan_archives
from ..sources.files import APPLE_NOISE, Scan, Skip, scan_media
from ..sources.tables import cut, cut_all, discard, spread

EMPTY = "array<string>"
METADATA = f"struct<description:string,taken_at_utc:string,location:{S.LOCATION},albums:array<string>>"


@dataclass(frozen=True)
class Plan:
    """assets: operation_id, relative_path, media_kind, byte_len, content_sha256, metadata, normalized_metadata, live_photo, evidence; findings: see
    ``diagnostics``; summary: one row; kind and version: of the source; source: its row, once ``document.with_source`` has added it."""

    kind: str
    version: int
    assets: DataFrame
    findings: DataFrame
    summary: DataFrame
    tables: list = field(default_factory=list)
    source: DataFrame | None = None

    def discard(self) -> None:
        """Deletes the tables below this plan, once its parts have been written."""
        discard(*self.tables)


@dataclass(frozen=True)
class SourceAdapter:
    """How a kind of export becomes a plan: the schema version, the matching, what is added to the finished plan, what a scan skips, the folder that
    it must have, and the family of its archives."""

    kind: str
    version: int
    match: Callable[..., tuple[DataFrame, DataFrame, DataFrame]]
    finish: Callable[..., Plan] = lambda plan, **options: plan
    skip: Skip | None = None
    prefix: str | None = None
    archives: str | None = None


def _attached(bridge: DataFrame) -> DataFrame:
    """bridge (path, sidecar, kind, rule_id) -> the same as evidence (path, rule_id, outcome)."""
    return bridge.select("path", "rule_id", F.lit("metadata_candidate_associated").alias("outcome"))


def match_folder(media: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J-1, J-2 -> (media with normalized null, bridge, findings): an exact name first, then the base name."""
    exact = cut(M.exact_sidecars(sidecars, media))
    hit = exact.where("media is not null")
    base = cut(M.basename_sidecars(sidecars.join(hit.select(F.col("sidecar").alias("path")), "path", "left_anti"), media))
    kind = sidecars.select(F.col("path").alias("sidecar"), "kind")
    both = hit.withColumn("rule_id", F.lit(D.SIDECAR_EXACT_NAME)).unionByName(base.where("outcome = 'matched'").select("sidecar", "media", F.lit(D.SIDECAR_BASENAME).alias("rule_id")))
    bridge = both.join(kind, "sidecar").select(F.col("media").alias("path"), "sidecar", "kind", "rule_id")
    found = D.finding(base.where("outcome = 'orphan'"), "sidecar_without_media", F.col("sidecar")).unionByName(D.finding(base.where("outcome = 'ambiguous'"), "ambiguous_sidecar_match", F.col("sidecar"), F.col("candidates")))
    return media.withColumn("normalized", F.lit(None).cast(METADATA)), bridge, found


def _json_only(sidecars: DataFrame, album_titles: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents that parse, their findings, all parsed documents)."""
    docs = cut(S.read_sidecar_json(sidecars.where("kind = 'json'"), album_titles))
    found = D.gather(S.json_findings(docs), D.finding(sidecars.where("kind = 'xmp'"), "unsupported_takeout_metadata_family", F.col("path")))
    return docs.where("error is null"), found, docs


def match_takeout_titles(media: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J-3 (version 1): a document's title names one file of its directory; album documents are documents like any other."""
    docs, found, _ = _json_only(sidecars, False)
    asked = docs.select(F.col("path").alias("sidecar"), F.concat_ws("/", F.nullif(X.parent(F.col("path")), F.lit("")), "title").alias("path"))
    hit = asked.join(media.select("path"), "path")
    several = hit.groupBy("path").agg(F.count("*").alias("n"), F.min("sidecar").alias("sidecar"))
    many = hit.join(several.where("n > 1").select("path"), "path", "left_semi")
    files = D.first_paths(many, "path", path="sidecar")
    found = D.gather(found, D.finding(asked.join(hit.select("sidecar"), "sidecar", "left_anti"), "takeout_title_without_media", F.col("sidecar")), D.finding(files, "multiple_takeout_sidecars_for_media", F.col("path"), F.col("paths")))
    bridge = several.where("n = 1").select("path", "sidecar", F.lit("json").alias("kind"), F.lit(D.TAKEOUT_TITLE).alias("rule_id"))
    bare = media.join(bridge.select("path"), "path", "left_anti")
    return media.withColumn("normalized", F.lit(None).cast(METADATA)), bridge, D.gather(found, D.finding(bare, "takeout_media_without_json", F.col("path")))


def match_takeout(media: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J-4, A-7, J-5, A-5, A-6, J-18, J-19 (version 2): tiers of names, then documents, albums, and one asset for each content."""
    docs, found, _ = _json_only(sidecars)
    tiers = cut(M.tiered_sidecars(docs, media))
    rule = F.when(F.col("tier") == 1, D.TAKEOUT_TITLE).otherwise(D.TAKEOUT_SUPPLEMENTAL)
    hit = tiers.where("media is not null").select("sidecar", F.col("media").alias("path"), rule.alias("rule_id"))
    lost = tiers.where("n is null").select(F.col("sidecar").alias("path"))
    album_docs = docs.join(lost.where(X.is_album_document(F.col("path"))), "path", "left_semi").select(F.col("path").alias("sidecar"), X.parent(F.col("path")).alias("dir"), F.col("title").alias("album"))
    facts = docs.select(F.col("path").alias("sidecar"), "title", "description", "taken_at_utc", "location")
    # documents of one medium: equal ones all attach, unequal ones none
    judged = cut(hit.join(facts, "sidecar"))
    fact = F.struct("title", "description", "taken_at_utc", "location")
    by_media = judged.groupBy("path").agg(F.min(fact).alias("low"), F.max(fact).alias("high"), F.count("*").alias("n"))
    by_media = cut(by_media)
    clash = by_media.where(~F.col("low").eqNullSafe(F.col("high"))).select("path")
    names = D.first_paths(hit.join(clash, "path", "left_semi"), "path", path="sidecar")
    good = hit.join(clash, "path", "left_anti")
    value = by_media.join(clash, "path", "left_anti").select("path", "low.description", "low.taken_at_utc", "low.location")
    # albums of the directory
    m = media.withColumn("dir", X.parent(F.col("path"))).withColumn("rank", X.canonical_rank(F.col("path")))
    album = album_docs.groupBy("dir").agg(F.max_by(F.struct("album", "sidecar"), "sidecar").alias("a")).select("dir", "a.album", F.col("a.sidecar").alias("album_sidecar"))
    m = m.join(value.withColumn("has", F.lit(True)), "path", "left").join(album, "dir", "left")
    m = cut(m).withColumn("albums", F.when(F.col("album").isNotNull(), F.array("album")).otherwise(F.array().cast(EMPTY)))
    bridge = good.select("path", "sidecar", F.lit("json").alias("kind"), "rule_id").unionByName(m.where("album is not null").select("path", F.col("album_sidecar").alias("sidecar"), F.lit("json").alias("kind"), F.lit(D.TAKEOUT_ALBUM).alias("rule_id")))
    # one asset for each content
    folded = cut(A.collapse(m))
    owner = A.owners(m)
    merged = A.resolve_metadata(m, ["description", "taken_at_utc", "location"], "albums")
    merged = merged.join(m.groupBy("byte_len", "sha256").agg(F.max(F.col("has").isNotNull() | F.col("album").isNotNull()).alias("any")), ["byte_len", "sha256"])
    out = cut(folded.join(merged, ["byte_len", "sha256"]))
    normal = F.when(F.col("any") & (F.size("conflicts") == 0), F.struct("description", "taken_at_utc", "location", "albums"))
    assets = out.select("path", "byte_len", "sha256", normal.cast(METADATA).alias("normalized"), (F.col("n") > 1).alias("folded"), "conflicts")
    bridge = bridge.join(owner, "path").select(F.col("owner").alias("path"), "sidecar", "kind", "rule_id")
    bare = assets.join(bridge.where(F.col("rule_id").isin(D.TAKEOUT_TITLE, D.TAKEOUT_SUPPLEMENTAL)).select("path").distinct(), "path", "left_anti")
    codes = {"description": "conflicting_takeout_description", "taken_at_utc": "conflicting_takeout_timestamp", "location": "conflicting_takeout_location"}
    found = D.gather(
        found,
        D.finding(lost.where(~X.is_album_document(F.col("path"))), "takeout_metadata_without_media", F.col("path")),
        D.finding(tiers.where("n > 1"), "ambiguous_takeout_metadata", F.col("sidecar"), F.col("candidates")),
        D.finding(names, "conflicting_takeout_asset_metadata", F.col("path"), F.col("paths")),
        A.alias_findings(folded),
        *[D.finding(assets.where(F.array_contains("conflicts", f)), code, F.col("path")) for f, code in codes.items()],
        D.finding(bare, "takeout_media_without_json", F.col("path")),
    )
    return assets.drop("conflicts"), bridge, found


def finish_folder_albums(plan: Plan, mode: str = "none", joiner: str = " / ", rule: str = D.APPLE_FOLDER_ALBUM, **_) -> Plan:
    """F-21: the folder's album joins each asset's albums."""
    album = X.album_from_path(F.col("relative_path"), mode, joiner)
    return replace(plan, assets=_with_albums(plan.assets.withColumn("album", album), rule, "folder_album_selected"))


def _with_albums(assets: DataFrame, rule: str, outcome: str) -> DataFrame:
    """assets with the column ``album`` (may be null) added to their albums and evidence."""
    old = F.col("normalized_metadata")
    albums = F.array_sort(F.array_distinct(F.concat(F.coalesce(old["albums"], F.array().cast(EMPTY)), F.array("album"))))
    merged = F.struct(old["description"].alias("description"), old["taken_at_utc"].alias("taken_at_utc"), old["location"].alias("location"), albums.alias("albums")).cast(METADATA)
    return _proved(assets.withColumn("normalized_metadata", F.when(F.col("album").isNotNull(), merged).otherwise(old)), F.col("album").isNotNull(), rule, outcome).drop("album")


def _proved(assets: DataFrame, when, rule: str, outcome: str) -> DataFrame:
    more = F.array_sort(F.array_distinct(F.concat("evidence", F.array(F.struct(F.lit(rule).alias("rule_id"), F.lit(outcome).alias("outcome"))))))
    return assets.withColumn("evidence", F.when(when, more).otherwise(F.col("evidence")))


def finish_picasa(plan: Plan, ini: DataFrame | None = None, ini_albums: bool = True, filename_date: bool = True, mode: str = "none", joiner: str = " / ", **_) -> Plan:
    """S-5, J-6, F-19: captions, INI albums, folder albums, then dates from names. ini: (path, text) of INI files."""
    assets, findings = plan.assets, plan.findings
    columns = assets.columns
    if ini is not None:
        dirs, captions, found = S.read_ini(ini)
        assets = assets.withColumn("dir", X.parent(F.col("relative_path"))).withColumn("name", X.filename(F.col("relative_path")))
        assets = assets.join(captions, ["dir", "name"], "left")
        old = F.col("normalized_metadata")
        captioned = F.struct(F.col("caption").alias("description"), old["taken_at_utc"].alias("taken_at_utc"), old["location"].alias("location"), F.coalesce(old["albums"], F.array().cast(EMPTY)).alias("albums")).cast(METADATA)
        assets = _proved(assets.withColumn("normalized_metadata", F.when(F.col("caption").isNotNull(), captioned).otherwise(old)), F.col("caption").isNotNull(), D.PICASA_CAPTION, "picasa_caption_selected")
        if ini_albums:
            assets = _with_albums(assets.join(dirs, "dir", "left"), D.PICASA_ALBUM, "picasa_album_selected")
        findings = D.gather(findings, found)
    assets = _with_albums(assets.withColumn("album", X.album_from_path(F.col("relative_path"), mode, joiner)), D.PICASA_FOLDER_ALBUM, "folder_album_selected")
    if filename_date:
        old, date = F.col("normalized_metadata"), X.filename_date(X.filename(F.col("relative_path")))
        use = date.isNotNull() & old["taken_at_utc"].isNull()
        dated = F.struct(old["description"].alias("description"), date.alias("taken_at_utc"), old["location"].alias("location"), F.coalesce(old["albums"], F.array().cast(EMPTY)).alias("albums")).cast(METADATA)
        assets = _proved(assets, use, D.PICASA_FILENAME_DATE, "filename_date_selected").withColumn("normalized_metadata", F.when(use, dated).otherwise(old))
    return replace(plan, assets=assets.select(*columns), findings=findings)


ADAPTERS: dict[str, SourceAdapter] = {}


def register(name: str, adapter: SourceAdapter) -> None:
    """Makes an adapter known by a name that is free."""
    if name in ADAPTERS:
        raise ValueError(f"adapter {name} is known already")
    ADAPTERS[name] = adapter


register("folder", SourceAdapter("folder", 1, match_folder))
register("google_takeout_v1", SourceAdapter("google_takeout", 1, match_takeout_titles, prefix=X.TAKEOUT_PREFIX))
register("google_takeout", SourceAdapter("google_takeout", 2, match_takeout, prefix=X.TAKEOUT_PREFIX, archives="takeout"))
register("apple_photos", SourceAdapter("apple_photos", 3, match_folder, finish_folder_albums, skip=APPLE_NOISE, archives="apple"))
register("picasa", SourceAdapter("picasa", 4, match_folder, finish_picasa, archives="picasa"))


def scan_source(spark: SparkSession, source: str | list[str], adapter: str | SourceAdapter, **limits) -> Scan:
    """The scan that an adapter asks for: of a tree (a path or URI), or of ZIP parts (a list of them)."""
    kind = ADAPTERS[adapter] if isinstance(adapter, str) else adapter
    if isinstance(source, str):
        return scan_media(spark, source, kind.prefix, kind.skip, **limits)
    if not kind.archives:
        raise ValueError(f"{kind.kind} has no archives")
    return scan_archives(spark, source, kind.archives, kind.prefix if kind.archives == "takeout" else None, kind.skip, **limits)


def plan_scan(adapter: str | SourceAdapter, scan: Scan, **options) -> Plan:
    """The plan of a scan, whose paths are in NFC."""
    return build_plan(adapter, *scan, nfc=True, **options)


def build_plan(adapter: str | SourceAdapter, media: DataFrame, sidecars: DataFrame, scan_findings: DataFrame | None = None, nfc: bool = False, **options) -> Plan:
    """A plan of media (path, byte_len, sha256) and sidecars (path, kind, byte_len, text). Options go to the adapter's ``finish``. ``nfc``: paths are normalised.

    Steps: paths in NFC, colliding ones dropped (A-1); matching; live pairs (J-7) after aliases are folded; case collisions (A-2) and repeated
    base names (A-3) over what is left; ids (F-16), sorted sets (A-8), summary (A-9: attachments, and bytes of all that was read).
    """
    kind = ADAPTERS[adapter] if isinstance(adapter, str) else adapter
    ini = sidecars.where("kind = 'ini'").select("path", "text")
    every, notes, twice = A.drop_collisions(media.select("path", "byte_len", "sha256"), sidecars.where("kind <> 'ini'").select("path", "kind", "byte_len", "text"), nfc)
    every, notes, twice = cut_all(spread(every, "path"), spread(notes, "path"), twice)
    assets, bridge, found = cut_all(*kind.match(every, notes))
    pairs = cut(M.live_pairs(assets))
    roles = pairs.select(F.col("image").alias("path"), "pair_id", F.lit("image").alias("role")).unionByName(pairs.select(F.col("video").alias("path"), "pair_id", F.lit("video").alias("role")))
    proofs = [assets.select("path", F.lit(D.REGULAR_MEDIA).alias("rule_id"), F.lit("streamed_content_identity").alias("outcome")), _attached(bridge), roles.select("path", F.lit(D.LIVE_PHOTO).alias("rule_id"), F.lit("live_photo_member").alias("outcome"))]
    if "folded" in assets.columns:
        proofs.append(assets.where("folded").select("path", F.lit(D.TAKEOUT_ALIAS).alias("rule_id"), F.lit("content_identical_paths_collapsed").alias("outcome")))
    evidence = proofs[0]
    for p in proofs[1:]:
        evidence = evidence.unionByName(p)
    attached = A.evidence(bridge.withColumnRenamed("sidecar", "relative_path"), "relative_path", "kind", "rule_id", name="metadata")
    out = assets.join(attached, "path", "left").join(roles.select("path", F.struct("pair_id", "role").alias("live_photo")), "path", "left").join(A.evidence(evidence), "path")
    out = cut(out.select(
        X.stable_id(F.lit("normalized-plan-operation-v1"), F.col("path"), F.col("sha256"), F.col("byte_len").cast("string")).alias("operation_id"),
        F.col("path").alias("relative_path"), X.media_kind(F.col("path")).alias("media_kind"), "byte_len", F.col("sha256").alias("content_sha256"),
        F.coalesce("metadata", F.array().cast("array<struct<relative_path:string,kind:string,rule_id:string>>")).alias("metadata"), F.col("normalized").alias("normalized_metadata"), "live_photo", "evidence",
    ))
    lint = [D.finding(A.case_collisions(assets), "portable_case_collision", F.col("paths")), D.finding(A.duplicate_basenames(assets), "duplicate_basename_across_directories", F.col("paths"))]
    found_table, found = found, D.gather(found, twice, *lint, *([scan_findings] if scan_findings is not None else []))
    read = media.select("byte_len").unionByName(sidecars.where("kind <> 'ini'").select("byte_len")).agg(F.coalesce(F.sum("byte_len"), F.lit(0)).alias("bytes_read"))
    summary = out.agg(F.count("*").alias("assets"), F.coalesce(F.sum(F.size("metadata")), F.lit(0)).alias("sidecars")).crossJoin(F.broadcast(read))  # one row each
    return kind.finish(Plan(kind.kind, kind.version, out, found, summary, [every, notes, twice, assets, bridge, found_table, pairs, out]), **({"ini": ini} | options))
