"""What several operators share: folds, bounded labelled samples, tables, rows taken apart, cut-offs by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, discard, shared_folder

__all__ = ["apart", "cut", "discard", "in_fold", "labelled_sample", "named", "shared_folder", "table", "together", "top_counts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: Column, parts: int, which: int) -> Column:
    """crc32 of the id's text, modulo parts, equals which; a null id is in no such fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most: int | None = None) -> DataFrame:
    """(text, label, doc_id): at most ``per_class`` texts of each label, and about ``most`` of all labels together.

    Rows are picked by a hash of doc_id, so any partitioning gives the same rows. Of a label with many rows only those
    whose hash is low enough for about 8 * per_class of them are ranked, so that what reaches a label's task does not
    grow with the input. Where there are so many labels that they would exceed ``most``, each has fewer rows, but every label has some.
    """
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    known = some.groupBy("label").agg(F.count("*").alias("rows"))
    labels_n = known.count()
    if most:
        per_class = max(1, min(per_class, most // max(1, labels_n)))
    fits = per_class * labels_n <= 1_000_000  # only then the ids are small enough to be sent to all
    small = F.broadcast if fits else lambda df: df
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    low = (F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5) * F.col("rows") <= 8 * per_class + 24
    ids = some.join(small(known), "label").where(low).select("doc_id", "label").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_class)
    return docs.select("doc_id", "text").where("text is not null").join(small(ids.dropDuplicates(["doc_id"]).drop("rank")), "doc_id").select("text", "label", "doc_id")


def named(column: str) -> Column:
    """A column by its exact name, whatever signs it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def apart(docs: DataFrame) -> tuple[Column, Column]:
    """(text as a string, all other columns in one struct ``rest``): inside it they have numbers for names, so none can clash with ours."""
    fields = [named(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() != "text"]
    return F.col("text").cast("string").alias("text"), F.struct(F.lit(True).alias("c"), *fields).alias("rest")


def together(df: DataFrame, docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of docs, in their order, from (text, rest)."""
    kind = docs.schema["text"].dataType if "text" in docs.columns else "string"
    return df.select(*[F.col("text").cast(kind).alias(c) if c.lower() == "text" else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)], *more)


def top_counts(counts: DataFrame, size: int) -> DataFrame:
    """Of (..., n) the rows with the largest n, at most ``size``: those from a cut-off on, which a histogram of n gives (exact up
    to 1024, 64 steps an octave above). Rows at a cut-off that would exceed size stay out together, so no task ranks them all."""
    power = F.floor(F.log2(F.col("n").cast("double")))
    step = F.when(F.col("n") < 1024, F.col("n").cast("double")).otherwise(F.floor(F.col("n") / F.pow(F.lit(2.0), power - 6)) * F.pow(F.lit(2.0), power - 6))
    bars = sorted(((r.low, r.rows) for r in counts.groupBy(step.alias("low")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, least = 0, None
    for low, rows in bars:
        total += rows
        if total > size:
            break
        least = low
    return counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
