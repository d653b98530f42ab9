"""Collisions, duplicates and content aliases: aggregations by path, name or content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..diagnostics import finding, first_paths
from ..functions import expr as X
from ..sources.tables import cut


def unicode_collisions(media: DataFrame, sidecars: DataFrame, nfc: bool = False) -> DataFrame:
    """A-1, U-1: normalised paths that occur more than once over both -> (path, n). Those paths are to be dropped. ``nfc``: they are normalised, as scans give them."""
    both = media.select("path").unionByName(sidecars.select("path"))
    return (both if nfc else X.with_nfc(both)).groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def drop_collisions(media: DataFrame, sidecars: DataFrame, nfc: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A-1: (media, sidecars, findings) with paths in NFC and without those that collide, which are a table of their own."""
    twice = cut(unicode_collisions(media, sidecars, nfc))
    fine = [(df if nfc else X.with_nfc(df)).join(twice, "path", "left_anti").select(*df.columns) for df in (media, sidecars)]
    return *fine, finding(twice, "native_paths_share_nfc_path", F.col("path"))


def case_collisions(media: DataFrame) -> DataFrame:
    """A-2: -> (folded, n, paths)."""
    rows = media.select(F.lower("path").alias("folded"), "path")
    many = rows.groupBy("folded").agg(F.count("*").alias("n")).where("n > 1")
    return many.join(first_paths(rows, "folded"), "folded")


def duplicate_basenames(media: DataFrame) -> DataFrame:
    """A-3: a file name in more than one directory -> (name, n_dirs, paths)."""
    rows = media.select(F.lower(X.filename(F.col("path"))).alias("name"), X.parent(F.col("path")).alias("dir"), "path")
    dirs = rows.select("name", "dir").distinct().groupBy("name").agg(F.count("*").alias("n_dirs")).where("n_dirs > 1")
    return dirs.join(first_paths(rows, "name"), "name")


def merge_archives(entries: DataFrame, identity: list[str]) -> DataFrame:
    """A-4: a path in several parts -> (path, n, outcome: single, duplicate or conflict). A conflict hides the duplicate warning, whatever the order of the parts."""
    g = entries.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct(F.struct(*identity)).alias("kinds"))
    return g.select("path", "n", F.when(F.col("kinds") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("single").alias("outcome"))


def canonical(media: DataFrame) -> DataFrame:
    """W-2: marks the copy of a content that stands for all. The pick is one aggregation with map-side combine; it comes back by path, which
    is unique, so a content that a third of all files share makes no hot key."""
    best = media.groupBy("byte_len", "sha256").agg(F.min(F.struct("rank", "path")).alias("best")).select(F.col("best.path").alias("path"), F.lit(True).alias("is_canonical"))
    return media.join(best, "path", "left").withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False))).select(*media.columns, "is_canonical")


def collapse(media: DataFrame) -> DataFrame:
    """A-5: one row for each content -> (byte_len, sha256, path, n, paths). An aggregation with map-side combine picks
    the canonical path, so a content that a third of all files share needs no window over its copies; paths: the eight smallest."""
    key = ["byte_len", "sha256"]
    one = media.groupBy(*key).agg(F.min(F.struct("rank", "path")).alias("best"), F.count("*").alias("n"))
    return one.join(first_paths(media, *key), key).select(*key, F.col("best.path").alias("path"), "n", "paths")


def alias_findings(collapsed: DataFrame) -> DataFrame:
    """A-5: a warning for each content with several paths."""
    return finding(collapsed.where("n > 1"), "content_identical_takeout_aliases", F.col("paths"))


def collapse_owner(media: DataFrame) -> DataFrame:
    """(byte_len, sha256, owner, n): the canonical path of each content, and its copies."""
    best = media.groupBy("byte_len", "sha256").agg(F.min(F.struct("rank", "path")).alias("best"), F.count("*").alias("n"))
    return best.select("byte_len", "sha256", F.col("best.path").alias("owner"), "n")


def owners(media: DataFrame, parts: int | None = None) -> DataFrame:
    """A-5: (path, owner) of every copy. Contents of so many copies that one task would have more than its eighth of a share from them alone are few, by their
    counts: their owners are sent to all tasks. The rest is joined by hash, so no content is any task's work."""
    parts = parts or int(media.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cut(collapse_owner(media))
    total = known.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * 8 * parts > total  # fewer than 8 * parts contents
    key = ["byte_len", "sha256"]
    few = known.where(heavy).select(*key, "owner")
    tagged = media.select("path", *key).join(F.broadcast(few), key, "left")
    rest = tagged.where("owner is null").select("path", *key).join(known.where(~heavy).select(*key, "owner"), key)
    return tagged.where("owner is not null").select("path", "owner").unionByName(rest.select("path", "owner"))


def resolve_metadata(media: DataFrame, fields: list[str], albums: str | None = None) -> DataFrame:
    """A-6: per content and field the first non-null value in canonical order; all fields are null where any field has two values, and the
    albums (union of all copies' albums) empty. -> (byte_len, sha256, fields..., [albums,] conflicts). All conflicting fields are
    reported, in a set, not only those before the first. A field conflicts if its smallest and largest values differ."""
    key, order = ["byte_len", "sha256"], F.struct("rank", "path")
    g = media.groupBy(*key).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields], *[F.min(f).alias(f"low_{f}") for f in fields], *[F.max(f).alias(f"high_{f}") for f in fields])
    conflicts = F.filter(F.array(*[F.when(F.col(f"low_{f}") != F.col(f"high_{f}"), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    g = g.withColumn("conflicts", conflicts)
    clean = F.size("conflicts") == 0
    out = g.select(*key, *[F.when(clean, F.col(f)).alias(f) for f in fields], "conflicts")
    if albums:
        sets = media.select(*key, F.explode(albums).alias("album")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("album")).alias(albums))
        out = out.join(sets, key, "left").withColumn(albums, F.when((F.size("conflicts") == 0) & F.col(albums).isNotNull(), F.col(albums)).otherwise(F.array().cast("array<string>")))
        out = out.select(*key, *fields, albums, "conflicts")
    return out


def sidecar_conflicts(matches: DataFrame) -> DataFrame:
    """A-7: matches (media, document) -> (media, n, document): unequal documents of one media attach none."""
    g = matches.groupBy("media").agg(F.count("*").alias("n"), F.countDistinct("document").alias("kinds"), F.min("document").alias("document"))
    return g.select("media", "n", F.when(F.col("kinds") == 1, F.col("document")).alias("document"))


def evidence(bridge: DataFrame, *fields: str, name: str = "evidence") -> DataFrame:
    """A-8: (path, fields...) -> (path, sorted set of structs), for evidence (rule_id, outcome), metadata (relative_path, kind, rule_id) alike."""
    fields = fields or ("rule_id", "outcome")
    every = bridge.select("path", F.struct(*fields).alias("x")).distinct()
    return every.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias(name))
