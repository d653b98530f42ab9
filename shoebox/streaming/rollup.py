"""Streams over files, rollups by key, and running them over what is there; see ``state`` for keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_folder, shared_folder


def event_stream(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table as a stream: the file name.parquet, or the files of a directory of that name; no other table that begins alike."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def progress(events: DataFrame) -> DataFrame:
    """T-1: per run the newest sequence with its stage, and the most assets observed and bytes read. Late and repeated rows change nothing."""
    more = [F.max(c).alias(c) for c in ("assets_observed", "bytes_read") if c in events.columns]
    return events.groupBy("run").agg(F.max("sequence").alias("sequence"), F.max_by("stage", "sequence").alias("stage"), *more)


def advance(stream: DataFrame, at: str) -> None:
    """Runs a stream over all that is there, from where it stopped at this place before; its batches stand below ``out``. A batch that runs again replaces itself."""

    def write(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/b{n}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def read_deliveries(stream: DataFrame, at: str) -> DataFrame:
    """What ``advance`` has written so far, with the number of each row's batch."""
    return read_folder(stream.sparkSession, f"{at}/out", stream.withColumn("_batch", F.lit(0)).schema)


def deliveries(stream: DataFrame, at: str | None = None) -> DataFrame:
    """All rows that a stream gives over what is there, as a table."""
    at = at or shared_folder(stream.sparkSession)
    advance(stream, at)
    return read_deliveries(stream, at)


def drain(stream: DataFrame, key: list[str]) -> DataFrame:
    """Runs a keyed update stream over all that is there and returns its newest row of each key, as a table."""
    out = deliveries(stream)
    rest = [c for c in out.columns if c not in (*key, "_batch")]
    return out.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*key, "x.*")
