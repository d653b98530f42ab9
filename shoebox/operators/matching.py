"""Sidecars to media, live photos, albums and captions: equi-joins on directory and name.

Every operator aggregates before or beside its join by the same key, so that Spark's
map-side combine and skew-join handling apply; nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..diagnostics import MAX_PATHS, first_paths
from ..functions import expr as X


def exact_sidecars(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """J-1: a JSON sidecar named after the whole media path -> (sidecar, media), media null where there is none."""
    s = sidecars.select(F.col("path").alias("sidecar"), F.when(F.endswith("path", F.lit(".json")), F.left("path", F.length("path") - 5)).alias("target"))
    return s.join(media.select(F.col("path").alias("media")), F.col("target") == F.col("media"), "left").select("sidecar", "media")


def basename_sidecars(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """J-2: same directory and stem; a single image is preferred -> (sidecar, media, outcome: matched, orphan or ambiguous, candidates: up to
    seven paths of an ambiguous one)."""
    m = media.select("path", X.parent(F.col("path")).alias("dir"), X.stem(F.col("path")).alias("stem"), (X.media_kind(F.col("path")) == "image").alias("is_image"))
    group = m.groupBy("dir", "stem").agg(F.count("*").alias("n"), F.count_if("is_image").alias("images"), F.min("path").alias("any"), F.min(F.when(F.col("is_image"), F.col("path"))).alias("image"))
    s = sidecars.select(F.col("path").alias("sidecar"), X.parent(F.col("path")).alias("dir"), X.stem(F.col("path")).alias("stem"))
    several = first_paths(m.join(group.where("n > 1 and images <> 1").select("dir", "stem"), ["dir", "stem"], "left_semi"), "dir", "stem", n=MAX_PATHS - 1)
    pick = F.when(F.col("images") == 1, F.col("image")).when(F.col("n") == 1, F.col("any"))
    outcome = F.when(F.col("n").isNull(), "orphan").when(pick.isNull(), "ambiguous").otherwise("matched")
    return s.join(group, ["dir", "stem"], "left").join(several, ["dir", "stem"], "left").select("sidecar", pick.alias("media"), outcome.alias("outcome"), F.coalesce("paths", F.array().cast("array<string>")).alias("candidates"))


def title_sidecars(docs: DataFrame, media: DataFrame) -> DataFrame:
    """J-3: documents (path, title) whose title is a filename of their directory; more than one on either side attaches none."""
    d = docs.select(F.col("path").alias("sidecar"), X.parent(F.col("path")).alias("dir"), F.col("title").alias("name"))
    m = media.select(F.col("path").alias("media"), X.parent(F.col("path")).alias("dir"), X.filename(F.col("path")).alias("name"))
    one_m = m.groupBy("dir", "name").agg(F.count("*").alias("n_media"), F.min("media").alias("media"))
    one_d = d.groupBy("dir", "name").agg(F.count("*").alias("n_docs"))
    both = d.join(one_m, ["dir", "name"], "left").join(one_d, ["dir", "name"], "left")
    fine = (F.col("n_media") == 1) & (F.col("n_docs") == 1)
    return both.select("sidecar", F.when(fine, F.col("media")).alias("media"), F.when(F.col("n_media").isNull(), "unmatched").when(fine, "matched").otherwise("ambiguous").alias("outcome"))


def base_name(sidecar: Column) -> Column:
    """A sidecar's file name without ``.supplemental-metadata.json``, else without ``.json``; null if it has neither or nothing before it."""
    return F.nullif(F.regexp_extract(X.filename(sidecar), rf"(?s)^(.*?)(?:\.{X.SUPPLEMENTAL})?\.json$", 1), F.lit(""))


def tiered_sidecars(docs: DataFrame, media: DataFrame) -> DataFrame:
    """J-4: indexed name (0), exact title (1), base name (2), names that begin with the base name (3); the first tier with candidates counts.

    docs (path, title), media (path, unique) -> (sidecar, tier, n, media, candidates): media is null unless the tier has exactly one candidate;
    candidates: up to seven paths. Only documents without an earlier hit reach tier 3. There, each media name is cut to the lengths that
    base names of its directory have, at most 255 of them, and joined by (directory, length, beginning): exact for every length, and no
    directory or common beginning is compared as a product.
    """
    d = docs.select(F.col("path").alias("sidecar"), X.parent(F.col("path")).alias("dir"), "title", X.indexed_target(X.filename(F.col("path"))).alias("indexed"), base_name(F.col("path")).alias("base"))
    m = media.select(F.col("path").alias("media"), X.parent(F.col("path")).alias("dir"), X.filename(F.col("path")).alias("name"))
    names = F.array(*[F.struct(F.lit(i).alias("tier"), F.col(c).alias("name")) for i, c in enumerate(("indexed", "title", "base"))])
    asked = d.select("sidecar", "dir", F.explode(F.filter(names, lambda x: x["name"].isNotNull())).alias("x")).select("sidecar", "dir", "x.tier", "x.name")
    equal = asked.join(m, ["dir", "name"]).select("sidecar", "tier", "media")
    rest = d.join(equal.select("sidecar").distinct(), "sidecar", "left_anti").where("base is not null").withColumn("size", F.length("base"))
    sizes = rest.select("dir", "size").distinct()
    begun = m.join(sizes, "dir").where(F.length("name") > F.col("size")).select("dir", "size", F.left("name", F.col("size")).alias("base"), "media")
    prefix = rest.join(begun, ["dir", "size", "base"]).select("sidecar", F.lit(3).alias("tier"), "media")
    found = equal.unionByName(prefix)
    tiers = found.groupBy("sidecar", "tier").agg(F.count("*").alias("n"), F.min("media").alias("one"))
    best = tiers.groupBy("sidecar").agg(F.min(F.struct("tier", "n", "one")).alias("x")).select("sidecar", "x.*")
    several = first_paths(found.join(best.where("n > 1").select("sidecar", "tier"), ["sidecar", "tier"], "left_semi").withColumnRenamed("media", "path"), "sidecar", n=MAX_PATHS - 1)
    return d.select("sidecar").join(best, "sidecar", "left").join(several, "sidecar", "left").select("sidecar", "tier", "n", F.when(F.col("n") == 1, F.col("one")).alias("media"), F.coalesce("paths", F.array().cast("array<string>")).alias("candidates"))


def live_pairs(media: DataFrame) -> DataFrame:
    """J-7: exactly one image and one .mov of a directory and stem -> (pair_id, image, video). Files of no such kind go first. An extension travels as a
    number, its bytes, so that the aggregation's buffers are of fixed size and it hashes instead of sorting; the paths are put together again from it."""
    path, ext = F.col("path"), X.extension(F.col("path"))
    m = media.select("path", ext.isin(*X.IMAGES).alias("is_image"), (ext == "mov").alias("is_mov")).where("is_image or is_mov")
    name = X.filename(path)
    as_number = F.conv(F.hex(F.substring_index(path, ".", -1)), 16, 10).cast("bigint")  # at most eight signs, of ASCII
    m = m.select(F.left(path, F.length(path) - F.length(name)).alias("folder"), X.stem(path).alias("stem"), as_number.alias("ext"), "is_image")
    image, video = F.when(F.col("is_image"), F.col("ext")), F.when(~F.col("is_image"), F.col("ext"))
    g = m.groupBy("folder", "stem").agg(F.count(image).alias("images"), F.count(video).alias("movs"), F.min(image).alias("image"), F.min(video).alias("video"))
    whole = lambda n: F.concat("folder", "stem", F.lit("."), F.decode(F.unhex(F.hex(n)), "UTF-8")).alias(n)
    pairs = g.where("images = 1 and movs = 1").select(whole("image"), whole("video"))
    return pairs.select(X.stable_id(F.lit("live-photo-v1"), F.col("image"), F.col("video")).alias("pair_id"), "image", "video")


def bind_pairs(assets: DataFrame) -> DataFrame:
    """J-8: (operation_id, pair_id, role) -> + video_operation_id for images of a pair, + missing_video where the pair has none."""
    video = assets.where("role = 'video'").groupBy("pair_id").agg(F.min("operation_id").alias("video_id"))
    out = assets.join(video, "pair_id", "left").withColumn("video_operation_id", F.when(F.col("role") == "image", F.col("video_id"))).drop("video_id")
    return out.withColumn("missing_video", F.coalesce((F.col("role") == "image") & F.col("video_operation_id").isNull(), F.lit(False)))


def bind_xmp(assets: DataFrame, bridge: DataFrame, version: int = 2) -> DataFrame:
    """J-9: bridge (operation_id, sidecar) -> (operation_id, xmp, outcome). Version 2 allows JSON and at most one XMP; version 1 allows
    one XMP alone: any JSON or a second sidecar is unsupported."""
    is_xmp = F.endswith("sidecar", F.lit(".xmp"))
    g = bridge.groupBy("operation_id").agg(F.count("*").alias("every"), F.count_if(is_xmp).alias("n"), F.min(F.when(is_xmp, F.col("sidecar"))).alias("xmp"))
    bad = F.coalesce((F.col("n") > 1) if version == 2 else (F.col("every") > 1) | (F.col("every") > F.col("n")), F.lit(False))
    return assets.select("operation_id").join(g, "operation_id", "left").select("operation_id", F.when(~bad, F.col("xmp")).alias("xmp"), F.when(bad, "unsupported").otherwise("bound").alias("outcome"))


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """J-18, J-19: rows whose key the other side lacks (orphan sidecars, media without metadata)."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def with_albums(media: DataFrame, albums: DataFrame) -> DataFrame:
    """J-5: albums (dir, album) -> every media of the directory, albums as a sorted set."""
    sets = albums.groupBy("dir").agg(F.array_sort(F.collect_set("album")).alias("albums"))
    return media.withColumn("dir", X.parent(F.col("path"))).join(sets, "dir", "left").withColumn("albums", F.coalesce("albums", F.array().cast("array<string>")))


def with_captions(assets: DataFrame, captions: DataFrame, dir_albums: DataFrame) -> DataFrame:
    """J-6: a caption replaces the description, a directory's album is added. captions (dir, name, caption), dir_albums (dir, album); a repeated
    caption or album of the same place counts once (the smallest), so no asset is multiplied."""
    a = assets.withColumn("dir", X.parent(F.col("path"))).withColumn("name", X.filename(F.col("path")))
    c = captions.groupBy("dir", "name").agg(F.min("caption").alias("caption"))
    d = dir_albums.groupBy("dir").agg(F.min("album").alias("album"))
    return a.join(c, ["dir", "name"], "left").join(d, "dir", "left").withColumn("description", F.coalesce("caption", "description")).drop("caption", "name")


def carry_section(lines: DataFrame, section: Column) -> DataFrame:
    """W-3: lines (file, line, ...) -> + section, the last one opened before."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(section, ignorenulls=True).over(w))
