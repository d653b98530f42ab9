"""Digest trees (A-17, J-16): a table's identity by levels, and drift between two of them.

A row belongs to the leaf that the first hex digits of its key's digest name. A leaf's digest is that of its rows' digests, in order; a node's that of its children's. The tree is stored
by level beside the rows, which are sorted by leaf. Two trees are compared from the root: only children of nodes that differ are looked at, and only rows of leaves
that differ are read, so finding little drift in a large plan costs little.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, discard

LEVEL = "node string, digest string, n bigint"


def row_digest(columns: list[str]) -> Column:
    """Of all columns, nulls and names included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class DigestTree:
    """levels: from 0, the root; the names of a level's nodes are ``step`` digits longer than those of the one above; ``digits``: of a leaf's name."""

    spark: SparkSession
    path: str
    digits: int
    step: int

    def level(self, digits: int) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(f"{self.path}/level={digits}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def root(self) -> str:
        """The digest of the whole table."""
        return self.level(0).first().digest


def write_tree(rows: DataFrame, key: list[str], path: str, digits: int = 4, step: int = 2) -> DigestTree:
    """Stores rows with their tree. ``digits``: 16 ** digits leaves; choose them so that a leaf has some thousand rows. Rows with the same key are in one leaf, in any number."""
    columns = rows.columns
    marked = rows.withColumns({"_leaf": F.left(F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256), F.lit(digits)), "_digest": row_digest(columns)})
    marked.repartitionByRange("_leaf", "_digest").sortWithinPartitions("_leaf", "_digest").write.parquet(f"{path}/rows")
    spark = rows.sparkSession
    # equal rows are counted before they meet, so that a row that a third of the table repeats is one member of its leaf
    each = spark.read.parquet(f"{path}/rows").groupBy("_leaf", "_digest").agg(F.count("*").alias("n"))
    member = F.transform(F.array_sort(F.collect_list(F.struct("_digest", "n"))), lambda x: F.concat(x["_digest"], F.lit("*"), x["n"].cast("string")))
    level = each.groupBy(F.col("_leaf").alias("node")).agg(F.sha2(F.array_join(member, ","), 256).alias("digest"), F.sum("n").alias("n"))
    while True:
        level.write.parquet(f"{path}/level={digits}")
        if not digits:
            break
        below, shorter = spark.read.schema(LEVEL).parquet(f"{path}/level={digits}"), max(0, digits - step)
        child = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"], F.lit(":"), x["digest"]))
        level = below.groupBy(F.left("node", F.lit(shorter)).alias("node")).agg(F.sha2(F.array_join(child, ","), 256).alias("digest"), F.sum("n").alias("n"))
        if not shorter:  # an empty table has a root too
            level = level.groupBy().agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("").alias("node"), "digest", "n")
        digits = shorter
    return DigestTree(spark, path, len(_longest(spark, path)), step)


def _longest(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    digits = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(hadoop.Path(path)) if s.getPath().getName().startswith("level=")]
    return "x" * max(digits)


def read_tree(spark: SparkSession, path: str, step: int = 2) -> DigestTree:
    """A tree that ``write_tree`` stored."""
    return DigestTree(spark, path, len(_longest(spark, path)), step)


def differing_leaves(stored: DigestTree, observed: DigestTree) -> tuple[DataFrame, list[int]]:
    """(leaf: the leaves whose rows differ, a table; nodes compared at each level). Both trees must have the same shape."""
    if (stored.digits, stored.step) != (observed.digits, observed.step):
        raise ValueError("the trees have different shapes")
    levels, digits = [stored.digits], stored.digits
    while digits:
        digits = max(0, digits - stored.step)
        levels.insert(0, digits)
    suspects, looked = None, []
    for digits in levels:
        one, other = stored.level(digits), observed.level(digits)
        if suspects is not None:
            one, other = (x.join(suspects, F.left("node", F.lit(above)) == suspects["leaf"], "left_semi") for x in (one, other))
        both = cut(one.join(other.select("node", F.col("digest").alias("other")), "node", "full_outer").select("node", (~F.col("digest").eqNullSafe(F.col("other"))).alias("differs")))
        looked.append(both.count())
        if suspects is not None:
            discard(suspects)
        suspects, above = cut(both.where("differs").select(F.col("node").alias("leaf"))), digits
        discard(both)
    return suspects, looked


def drift(stored: DigestTree, observed: DigestTree) -> DataFrame:
    """J-16: rows of either side that the other lacks, as a multiset -> + side; the same as comparing all rows. What is returned reads tables below both trees and of its own."""
    leaves, _ = differing_leaves(stored, observed)
    one, other = (t.rows().join(leaves, F.col("_leaf") == leaves["leaf"], "left_semi").drop("_leaf", "_digest") for t in (stored, observed))
    out = one.exceptAll(other).withColumn("side", F.lit("stored")).unionByName(other.exceptAll(one).withColumn("side", F.lit("observed")))
    return out
