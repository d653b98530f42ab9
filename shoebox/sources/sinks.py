"""Sinks: plans, append-only journals, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .journal_store import Journal


def write_plan(assets: DataFrame, diagnostics: DataFrame, summary: DataFrame, path: str) -> None:
    """K-1 as three Parquet tables; assets are range-partitioned and sorted by path. See ``plans.document`` for documents."""
    key = "relative_path" if "relative_path" in assets.columns else "path"
    assets.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(f"{path}/assets")
    diagnostics.write.mode("errorifexists").parquet(f"{path}/diagnostics")
    summary.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")


def append_effects(path: str):
    """K-3: for foreachBatch. A batch that is delivered again is already in the log, so no effect is doubled; one that was cut short never shows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        Journal(batch.sparkSession, path).append(batch.dropDuplicates(["effect_key", "sequence"]), batch_id)

    return write


def read_effects(spark: SparkSession, path: str) -> DataFrame:
    """S-8: the effects that have been committed."""
    return Journal(spark, path).read()


def stream_effects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-8: the same as a stream, batch by batch."""
    return Journal(spark, path).stream(schema)


def write_operations(operations: DataFrame, summary: DataFrame, path: str, manifest: bool = False) -> None:
    """K-2: an upload plan's or migration plan's operations, sorted by path, with their one-row summary; ``manifest``: an archive's assets, sorted by asset_id."""
    key = "asset_id" if manifest else "path"
    operations.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(f"{path}/{'assets' if manifest else 'operations'}")
    summary.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")  # one row


def write_report(report: DataFrame, path: str) -> None:
    """K-5: a one-row report as JSON."""
    report.coalesce(1).write.mode("errorifexists").json(path)


def append_receipts(new: DataFrame, path: str, key: str = "receipt_ref") -> None:
    """K-4: receipts that are not yet there."""
    Journal(new.sparkSession, path).append_new(new.withColumn("stored", F.lit(True)), key)


def append_history(records: DataFrame, path: str) -> None:
    """K-4: terminal records (sequence, recorded_unix, status, ...), each sequence once."""
    Journal(records.sparkSession, path).append_new(records, "sequence")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """K-4: the receipts or records that have been committed."""
    return Journal(spark, path).read()
