"""Plan documents (K-1, S-9): a plan with its source, written by ranges and read back whole.

A document is a folder: ``assets``, ``warnings`` and ``errors`` as lines of canonical JSON in parts whose names follow the order of their rows (no task sorts
all of them), and ``plan``, its version, source and summary, which is written last: without it there is no document. A single JSON file, as other tools write it, is read alike.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..diagnostics import SCHEMA as FINDING
from ..sources.documents import PLAN, PLAN_ASSET
from .build import Plan
from .summary import json_fingerprint, ordered_fingerprint, tree_fingerprint

HEADER = "schema_version int, source struct<kind:string,label:string,fingerprint_sha256:string,case_sensitive:boolean,unicode_normalization:string>, summary struct<assets:bigint,sidecars:bigint,bytes_read:bigint>"
SIDES = {"warning": "warnings", "error": "errors"}


def plan_fingerprint(plan: Plan, sidecars: DataFrame, exact: bool = False) -> DataFrame:
    """A-17 -> one row (fingerprint). ``exact``: the plan format's single fold, which is serial and refuses large plans; else the digest of three trees of digests, of any size."""
    if exact:
        if plan.version == 4:
            return json_fingerprint(plan.assets, plan.findings)
        return ordered_fingerprint(plan.assets, sidecars, plan.findings, version=plan.version)
    line = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("line"))
    parts = [line(plan.assets), line(sidecars.select("path", "byte_len", "sha256")), line(plan.findings)]
    roots = [tree_fingerprint(p, "line", 3).select(F.lit(i).alias("i"), "fingerprint") for i, p in enumerate(parts)]
    return roots[0].unionByName(roots[1]).unionByName(roots[2]).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "fingerprint"))), lambda x: F.concat(x["i"].cast("string"), F.lit(":"), x["fingerprint"])), ","), 256).alias("fingerprint"))  # three rows


def with_source(plan: Plan, sidecars: DataFrame, label: str, exact: bool = False, case_sensitive: bool = True) -> Plan:
    """The plan with its source: one row (schema_version, kind, label, fingerprint_sha256, case_sensitive, unicode_normalization)."""
    row = plan_fingerprint(plan, sidecars.where("kind <> 'ini'"), exact)
    source = row.select(F.lit(plan.version).alias("schema_version"), F.lit(plan.kind).alias("kind"), F.lit(label).alias("label"), F.col("fingerprint").alias("fingerprint_sha256"), F.lit(case_sensitive).alias("case_sensitive"), F.lit("nfc").alias("unicode_normalization"))
    return replace(plan, source=source)


def _lines(rows: DataFrame, columns: list[str], *order: str) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*columns)).alias("value"))


def write_document(plan: Plan, path: str) -> None:
    """K-1: a plan with its source. The folder must be new."""
    if plan.source is None:
        raise ValueError("the plan has no source; see with_source")
    names = plan.assets.columns
    _lines(plan.assets, names, "relative_path").write.mode("errorifexists").text(f"{path}/assets")
    for severity, name in SIDES.items():
        _lines(plan.findings.where(F.col("severity") == severity), ["rule_id", "code", "paths"], "rule_id", "code", "paths").write.text(f"{path}/{name}")
    head = plan.source.select("schema_version", F.struct("kind", "label", "fingerprint_sha256", "case_sensitive", "unicode_normalization").alias("source")).join(F.broadcast(plan.summary.select(F.struct("assets", "sidecars", "bytes_read").alias("summary"))))  # one row each
    head.coalesce(1).write.json(f"{path}/plan")


def read_document(spark: SparkSession, path: str) -> Plan:
    """S-9: the plan of a folder that ``write_document`` wrote, or of one JSON file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(hadoop.Path(path)).isDirectory():
        if not files.exists(hadoop.Path(f"{path}/plan/_SUCCESS")):
            raise ValueError(f"no whole plan at {path}")
        head = spark.read.schema(HEADER).json(f"{path}/plan")
        assets = spark.read.schema(PLAN_ASSET).json(f"{path}/assets")
        found = [spark.read.schema("rule_id string, code string, paths array<string>").json(f"{path}/{name}").select(F.lit(severity).alias("severity"), "rule_id", "code", "paths") for severity, name in SIDES.items()]
    else:
        head = spark.read.schema(PLAN).option("multiLine", True).json(path)
        assets = head.select(F.explode("assets").alias("a")).select("a.*")
        found = [head.select(F.explode(name).alias("x")).select(F.lit(severity).alias("severity"), "x.*") for severity, name in SIDES.items()]
    known = head.select("schema_version", "source.kind").first()
    source = head.select("schema_version", "source.*")
    return Plan(known.kind, known.schema_version, assets, found[0].unionByName(found[1]).to(spark.createDataFrame([], FINDING).schema), head.select("summary.*"), source=source)
