"""Plan against destination, journal and stored state: anti, semi and outer joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_check(plan: DataFrame, inventory: DataFrame) -> DataFrame:
    """J-10: by SHA-1 -> + asset_id, decision (accept or duplicate); an inventory checksum counts once, by its smallest id."""
    one = inventory.groupBy("sha1").agg(F.min("asset_id").alias("asset_id"))
    return plan.join(one, "sha1", "left").withColumn("decision", F.when(F.col("asset_id").isNull(), "accept").otherwise("duplicate"))


def pending(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """J-11: not completed, and the completed mates of open halves of a pair."""
    open_ = plan.join(completed.select("operation_id").distinct(), "operation_id", "left_anti")
    mates = plan.where("pair_id is not null").join(open_.where("pair_id is not null").select("pair_id").distinct(), "pair_id", "left_semi")
    return open_.where("pair_id is null").unionByName(mates.select(*plan.columns))


def foreign_keys(keys: DataFrame, allowed: DataFrame) -> DataFrame:
    """J-12: journal keys that the plan does not allow; must be empty."""
    return keys.select("effect_key").distinct().join(allowed.select("effect_key").distinct(), "effect_key", "left_anti")


def allowed_keys(plan: DataFrame) -> DataFrame:
    """Keys of a plan (operation_id, albums): asset and metadata by operation, album and membership by the name's digest."""
    names = plan.select(F.explode("albums").alias("album")).distinct().select(F.sha2("album", 256).alias("id"))
    ops = plan.select(F.col("operation_id").alias("id"))
    kinds = {"asset": ops, "metadata": ops, "album": names, "membership": names}
    return reduce(DataFrame.unionByName, [df.select(F.concat(F.lit(k + ":"), "id").alias("effect_key")) for k, df in kinds.items()])


def in_scope(members: DataFrame, assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """J-13, S-7: memberships of known assets, once each."""
    return members.join(assets.select(key), key, "left_semi").dropDuplicates()


def linked_closure(assets: DataFrame, details: DataFrame) -> DataFrame:
    """J-14: adds the linked assets (one hop) that the listing lacks. assets and details: (id, linked_id)."""
    missing = assets.where("linked_id is not null").select(F.col("linked_id").alias("id")).distinct().join(assets.select("id"), "id", "left_anti")
    return assets.unionByName(details.join(missing, "id", "left_semi").select(*assets.columns))


def mismatches(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """J-15, V-5: keys on one side only, or with fields that differ -> (key, reason, fields: those that differ)."""
    x, y = (df.select(key, F.struct(*fields).alias(n)) for df, n in ((a, "l"), (b, "r")))
    both = x.join(y, key, "full_outer")
    reason = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").when(~F.col("l").eqNullSafe(F.col("r")), "differs")
    off = F.filter(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    return both.select(key, reason.alias("reason"), F.when(reason == "differs", off).otherwise(F.array().cast("array<string>")).alias("fields")).where("reason is not null")


def drift(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """J-16: rows of either side that the other lacks, as a multiset -> + side."""
    return stored.exceptAll(observed).withColumn("side", F.lit("stored")).unionByName(observed.exceptAll(stored).withColumn("side", F.lit("observed")))


def album_decisions(wanted: DataFrame, server: DataFrame) -> DataFrame:
    """J-17: by exact name: none creates, one reuses, more fail -> (album, decision, album_id)."""
    g = server.groupBy("album").agg(F.count("*").alias("n"), F.min("album_id").alias("id"))
    x = wanted.select("album").distinct().join(g, "album", "left")
    return x.select("album", F.when(F.col("n").isNull(), "create").when(F.col("n") == 1, "reuse").otherwise("ambiguous").alias("decision"), F.when(F.col("n") == 1, F.col("id")).alias("album_id"))


def materialization(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """J-20: (path, byte_len, sha1) on both sides -> (path, action: complete, conflict, download or extra)."""
    a, b = manifest.select("path", F.struct("byte_len", "sha1").alias("want")), listing.select("path", F.struct("byte_len", "sha1").alias("have"))
    action = F.when(F.col("have").isNull(), "download").when(F.col("want").isNull(), "extra").when(F.col("want").eqNullSafe(F.col("have")), "complete").otherwise("conflict")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def archive_report(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """K-5: what applying a manifest (path, byte_len, sha1) to a destination does -> one row. Its first three counts add up to the manifest's rows."""
    x = manifest.select("path", "byte_len").join(materialization(manifest, listing), "path")
    counts = [F.count_if(F.col("action") == a).alias(n) for a, n in (("download", "downloaded"), ("complete", "already_complete"), ("conflict", "conflicts"))]
    return x.agg(*counts, F.coalesce(F.sum(F.when(F.col("action") == "download", F.col("byte_len"))), F.lit(0)).alias("bytes_written"))


def remote_roles(inventory: DataFrame) -> DataFrame:
    """J-21: (id, kind, linked_id) -> images with a link: (image, video, violation). The video must exist, be one, link to nothing and have one owner."""
    images = inventory.where("linked_id is not null").select(F.col("id").alias("image"), F.col("linked_id").alias("video"))
    owners = images.groupBy("video").agg(F.count("*").alias("owners"))
    target = inventory.select(F.col("id").alias("video"), F.col("kind").alias("video_kind"), F.col("linked_id").alias("its_link"))
    why = F.when(F.col("video_kind").isNull(), "missing").when(F.col("video_kind") != "video", "not_video").when(F.col("its_link").isNotNull(), "linked").when(F.col("owners") > 1, "shared")
    return images.join(owners, "video").join(target, "video", "left").select("image", "video", why.alias("violation"))


def albums_by_operation(members: DataFrame, operations: DataFrame) -> DataFrame:
    """J-22, A-16: (album, asset_id) x (asset_id, operation_id) -> (operation_id, albums, unknown). Unknown members have a null operation."""
    return members.join(operations, "asset_id", "left").groupBy("operation_id").agg(F.array_sort(F.collect_set("album")).alias("albums"), F.count_if(F.col("operation_id").isNull()).alias("unknown"))


def visibility_union(*inventories: DataFrame, key: str = "id", fields: list[str]) -> DataFrame:
    """U-2: all inventories by key -> (key, fields..., n, conflict): one row an asset; with different facts it is a conflict and its fields are null."""
    every = reduce(DataFrame.unionByName, inventories)
    facts = F.struct(*fields)
    g = every.groupBy(key).agg(F.count("*").alias("n"), F.min(facts).alias("low"), F.max(facts).alias("high"))
    conflict = ~F.col("low").eqNullSafe(F.col("high"))
    return g.select(key, *[F.when(~conflict, F.col(f"low.{f}")).alias(f) for f in fields], "n", conflict.alias("conflict"))


def multiset_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """A-21: contents that the two corpora hold a different number of times -> (key..., n_a, n_b)."""
    x, y = a.groupBy(*key).agg(F.count("*").alias("n_a")), b.groupBy(*key).agg(F.count("*").alias("n_b"))
    return x.join(y, key, "full_outer").na.fill(0, ["n_a", "n_b"]).where("n_a <> n_b")


def differential(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """U-3: one boolean a check over two path sets -> (check_id, passed)."""
    a, b = plan.select("path").distinct().withColumn("a", F.lit(1)), observed.select("path").distinct().withColumn("b", F.lit(1))
    n = a.join(b, "path", "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count("*").alias("every"))
    checks = {"equal": (F.col("only_a") + F.col("only_b")) == 0, "subset": F.col("only_a") == 0, "superset": F.col("only_b") == 0, "disjoint": F.col("only_a") + F.col("only_b") == F.col("every")}
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("passed")) for k, v in checks.items()])).alias("x")).select("x.*")


#: Check of a plan against what another tool was seen to do -> whether the observed facts must equal the plan's, or may be some of them.
PLAN_CHECKS = {"discovered": "equal", "sidecar": "equal", "duplicate": "equal", "uploaded": "subset", "updated": "subset", "album": "equal"}


def plan_facts(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """U-3: what a plan says, as (check_id, path, value): files discovered (assets and their aliases), sidecars attached, duplicates, assets to upload, assets with
    metadata, and their albums."""
    alias = findings.where("code = 'content_identical_takeout_aliases'").select(F.explode("paths").alias("path")).distinct()
    own = assets.select(F.col("relative_path").alias("path"))
    fact = lambda df, check, value=None: df.select(F.lit(check).alias("check_id"), "path", (value if value is not None else F.lit("")).alias("value"))
    albums = assets.where("normalized_metadata is not null").select(F.col("relative_path").alias("path"), F.explode("normalized_metadata.albums").alias("album"))
    parts = [
        fact(own.unionByName(alias), "discovered"),
        fact(assets.select(F.explode("metadata.relative_path").alias("path")), "sidecar"),
        fact(alias.join(own, "path", "left_anti"), "duplicate"),
        fact(own, "uploaded"),
        fact(assets.where("normalized_metadata is not null").select(F.col("relative_path").alias("path")), "updated"),
        fact(albums, "album", F.col("album")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def plan_differential(assets: DataFrame, findings: DataFrame, observed: DataFrame) -> DataFrame:
    """U-3 for plans: observed facts (check_id, path, value) against a plan's -> (check_id, passed, missing, unexpected), one row for each of PLAN_CHECKS. All
    checks are one comparison."""
    said, seen = plan_facts(assets, findings).withColumn("s", F.lit(1)), observed.select("check_id", "path", "value").distinct().withColumn("o", F.lit(1))
    both = said.join(seen, ["check_id", "path", "value"], "full_outer").groupBy("check_id").agg(F.count_if(F.col("o").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("unexpected"))
    known = F.explode(F.array(*[F.struct(F.lit(c).alias("check_id"), F.lit(m).alias("mode")) for c, m in PLAN_CHECKS.items()])).alias("x")
    out = assets.sparkSession.range(1).select(known).select("x.*").join(both, "check_id", "left").na.fill(0, ["missing", "unexpected"])
    return out.select("check_id", ((F.col("unexpected") == 0) & ((F.col("mode") == "subset") | (F.col("missing") == 0))).alias("passed"), "missing", "unexpected")
