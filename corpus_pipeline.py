"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir). Stages but the last keep all columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import decontamination, jaccard_join, packing, quality_classifier, substring_dedup
from shoebox.llm.common import cut, discard, in_fold, table


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifier scores below 0.5. Null and empty texts are judged as empty ones; repeated rows
    and rows without an id are judged by their texts like any other. An empty table stays empty."""
    held = in_fold(F.col("doc_id"), 3, 1)
    model = quality_classifier.train(docs.select("doc_id", "text").where(~held), table(spark, sf_dir, "labels").where(~held))
    return quality_classifier.select(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of 5-word Jaccard similarity 0.8 or more: the one with the smallest id, rows without an id last. Different
    texts that share an id are different documents. Null and empty texts link with nothing and stay. An empty table stays empty."""
    return jaccard_join.deduplicate(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 35 words or more that occur more than once; documents that lose every word go. Null and empty texts stay;
    rows of 35 words or more that repeat each other go. An empty table stays empty."""
    return _sized(substring_dedup.remove_repeats(docs, drop_emptied=True))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out benchmark passages; documents that mostly consist of them go. Null and empty texts stay. An empty table stays empty."""
    return _sized(decontamination.remove_spans(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 4096 tokens. A null or empty text is its end token alone; repeated rows
    and rows without an id are packed like any other. An empty table gives no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]
#: SQL cannot express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            discard(before)
    return docs
