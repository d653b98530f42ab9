"""Journals, reports, ordering and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DONE = ("created", "duplicate")
OUTCOMES = ("created", "duplicate", "failed", "indeterminate")


def latest(journal: DataFrame, key: str) -> DataFrame:
    """W-1: the newest row of each key; one aggregation, no self join."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), "sequence").alias("x")).select(key, "x.*")


def completed(journal: DataFrame, key: str) -> DataFrame:
    """Keys whose newest row succeeded: a later failure reopens a key."""
    return latest(journal, key).where(F.col("outcome").isin(*DONE))


def report(effects: DataFrame) -> DataFrame:
    """A-14 for uploads: one row of outcome counts, retries and keys."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return effects.agg(*counts, F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retried"), F.countDistinct("effect_key").alias("keys"))


def import_report(effects: DataFrame, done: DataFrame) -> DataFrame:
    """A-14 for imports: effects (effect_key, outcome, retry_count) of this run and keys (effect_key) that were done before it -> one row.
    Assets, metadata, albums and memberships are told apart by the key's prefix."""
    kind = F.substring_index("effect_key", ":", 1)
    of = lambda k, *outcomes: F.count_if((kind == k) & F.col("outcome").isin(*outcomes))
    any_of = lambda o: F.count_if(F.col("outcome") == o)
    run = effects.agg(
        of("asset", "created").alias("created"), of("asset", "duplicate").alias("duplicate"), of("metadata", "completed").alias("metadata_updated"),
        of("album", "created").alias("albums_created"), of("album", "reused").alias("albums_reused"), of("membership", "completed").alias("album_memberships_updated"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retried"), any_of("failed").alias("failed"), any_of("indeterminate").alias("indeterminate"),
    )
    before = done.select("effect_key").distinct().agg(F.count("*").alias("resumed_effects"))
    return run.crossJoin(F.broadcast(before))  # one row each


def gauges(history: DataFrame, status: str) -> DataFrame:
    """A-20: rows by status."""
    return history.groupBy(status).agg(F.count("*").alias("n"))


def dry_run(plan: DataFrame, done: DataFrame) -> DataFrame:
    """A-15: planned, resumed, would_upload."""
    x = plan.join(done.select("operation_id").distinct().withColumn("d", F.lit(1)), "operation_id", "left")
    return x.agg(F.count("*").alias("planned"), F.count("d").alias("resumed")).withColumn("would_upload", F.col("planned") - F.col("resumed"))


def effect_violations(effects: DataFrame) -> DataFrame:
    """V-6: rows whose key is not prefix:64 hex, or whose id is there against the outcome -> (sequence, reason). An id is 1 to 4096 bytes; any other is none."""
    bad_key = ~F.col("effect_key").rlike("^(asset|metadata|album|membership):[0-9a-f]{64}$")
    wants = F.col("outcome").isin("created", "duplicate", "reused")
    bad_key, wants = F.coalesce(bad_key, F.lit(True)), F.coalesce(wants, F.lit(False))
    there = F.coalesce(F.octet_length("remote_id").between(1, 4096), F.lit(False))
    reason = F.when(bad_key, "key").when(wants & ~there, "id_missing").when(~wants & there, "id_unexpected")
    return effects.select("sequence", reason.alias("reason")).where("reason is not null")


def dependency_order(operations: DataFrame) -> DataFrame:
    """W-6: (operation_id, path, pair_id, is_video) -> + leader (path of the group's first operation), nth in the group; order by both.
    Videos come before their images."""
    group = Window.partitionBy(F.coalesce("pair_id", "operation_id")).orderBy(F.desc("is_video"), "path")
    return operations.withColumn("leader", F.first("path").over(group)).withColumn("nth", F.row_number().over(group))


def retain(history: DataFrame, cutoff: int, n: int) -> DataFrame:
    """W-7, O-2: not older than the cutoff, the newest n: a top-k, not a global window."""
    return history.where(F.col("recorded_unix") >= cutoff).orderBy(F.desc("sequence")).limit(n)


def page_gaps(pages: DataFrame) -> DataFrame:
    """W-8: (listing, page, items, declared) -> pages whose successor is not page + 1, or whose count is off. A page that is there twice is followed by itself. Pages look
    for their successors by a join, and only those without one ask how far their listing goes, so a listing of any length is no single task's work."""
    own = Window.partitionBy("listing", "page")
    x = pages.withColumns({"nth": F.row_number().over(own.orderBy("items", "declared")), "times": F.count("*").over(own)})
    after = pages.select("listing", (F.col("page") - 1).alias("page"), F.lit(True).alias("followed")).distinct()
    x = x.join(after, ["listing", "page"], "left").withColumn("again", F.col("nth") < F.col("times"))
    known = x.where("followed or again").withColumn("gap", F.col("again"))
    ends = pages.groupBy("listing").agg(F.max("page").alias("last"))
    open_ = x.where("followed is null and not again").join(ends, "listing").withColumn("gap", F.when(F.col("page") < F.col("last"), F.lit(True))).drop("last")
    out = known.unionByName(open_)
    return out.select("listing", "page", "gap", (F.col("items") != F.col("declared")).alias("count_off")).where("coalesce(gap, false) or count_off")


def order_violations(rows: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """W-4: rows not strictly above their predecessor."""
    w = Window.partitionBy(group).orderBy(position)
    return rows.withColumn("previous", F.lag(value).over(w)).where(F.col("previous") >= F.col(value)).select(group, position)


def replay(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """T-2: events (run, sequence), cursors (run, cursor) -> (run, status: ok, invalid or exhausted, n events after the cursor)."""
    g = events.join(cursors, "run").groupBy("run", "cursor").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count_if(F.col("sequence") > F.col("cursor")).alias("n"))
    status = F.when(F.col("cursor") > F.col("high"), "invalid").when(F.col("cursor") + 1 < F.col("low"), "exhausted").otherwise("ok")
    return g.select("run", "cursor", status.alias("status"), F.when(status == "ok", F.col("n")).otherwise(0).alias("n"))


def replayed(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """T-2: the events after the cursor of each run whose cursor is good."""
    good = replay(events, cursors).where("status = 'ok'").select("run", "cursor")
    return events.join(good, "run").where(F.col("sequence") > F.col("cursor")).select(*events.columns)


def newest(events: DataFrame, n: int) -> DataFrame:
    """T-4 in batch: the newest n events of each run; Spark cuts each task's ranking before the shuffle."""
    w = Window.partitionBy("run").orderBy(F.desc("sequence"))
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def statistics(samples: DataFrame, *by: str, accuracy: int = 10_000) -> DataFrame:
    """A-19: min, median, nearest-rank p95, max of value -> (by..., lowest, median, p95, highest), exact.

    A sketch first brackets the wanted ranks; then the values below each bracket are only counted, and those inside it (about
    4 / accuracy of a group) ranked. So no task holds a group's values.
    """
    by, d = list(by), 2.0 / accuracy
    marks = F.percentile_approx("value", F.array(*[F.lit(max(0.0, min(1.0, p))) for p in (0.5 - d, 0.5 + d, 0.95 - d, 0.95 + d)]), F.lit(accuracy))
    rough = samples.groupBy(*by).agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count("value").alias("n"), marks.alias("m"))
    x = samples.where("value is not null").join(rough.select(*by, F.struct(F.col("m")[0].alias("a"), F.col("m")[1].alias("b"), F.col("m")[2].alias("c"), F.col("m")[3].alias("d")).alias("m")), by)
    sides = {"mid": ("a", "b"), "top": ("c", "d")}
    below = x.groupBy(*by).agg(*[F.count_if(F.col("value") < F.col(f"m.{lo}")).alias(name) for name, (lo, _) in sides.items()])
    ranked = {}
    for name, (lo, hi) in sides.items():
        own = x.where((F.col("value") >= F.col(f"m.{lo}")) & (F.col("value") <= F.col(f"m.{hi}"))).groupBy(*by, "value").agg(F.count("*").alias("times"))
        own = own.withColumn("upto", F.sum("times").over(Window.partitionBy(*by).orderBy("value")))
        ranked[name] = own.join(rough.select(*by, "n"), by).join(below, by).withColumn("rank", F.col("upto") + F.col(name))
    at = lambda r: F.min(F.when(F.col("rank") >= r, F.col("value")))
    n = F.col("n")
    half = ranked["mid"].groupBy(*by).agg(((at(F.expr("(n + 1) div 2")) + at(F.expr("n div 2 + 1"))) / 2).alias("median"))
    most = ranked["top"].groupBy(*by).agg(at(F.expr("(95 * n + 99) div 100")).alias("p95"))
    return rough.where(n > 0).join(half, by).join(most, by).select(*by, "lowest", "median", "p95", "highest")


def fresh_receipts(receipts: DataFrame, bindings: DataFrame, fields: list[str]) -> DataFrame:
    """V-8: receipts whose binding equals the current one in every field."""
    b = bindings.select("plan_ref", *[F.col(f).alias(f"now_{f}") for f in fields])
    x = receipts.join(b, "plan_ref")
    for f in fields:
        x = x.where(F.col(f).eqNullSafe(F.col(f"now_{f}")))
    return x.select(*receipts.columns)
