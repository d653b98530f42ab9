"""Checks over a table in one pass.

Every row gives one array: the checks that it fails, the values that must be unique, the members of sets to be counted, and numbers to be summed. The array is exploded and
aggregated once, with map-side combine, so that a table is scanned once and shuffled once however many checks there are, and a value that a third of all rows share
is a few rows a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

FACT = "struct<what:string,check_id:string,key:string,n:decimal(38,0)>"


@dataclass(frozen=True)
class Checks:
    """failed: check -> whether a row fails it; unique: check -> value that no two rows may share; sets: name -> array of members; totals: name -> number."""

    key: Column
    failed: dict[str, Column] = field(default_factory=dict)
    unique: dict[str, Column] = field(default_factory=dict)
    sets: dict[str, Column] = field(default_factory=dict)
    totals: dict[str, Column] = field(default_factory=dict)

    def facts(self, rows: DataFrame) -> DataFrame:
        """(what, check_id, key, rows, n): what is failed, unique (those found twice only), set or total. Written once, as violations and sums read it: it holds what
        is wrong, not the rows."""
        fact = lambda what, name, key, n: F.struct(F.lit(what).alias("what"), F.lit(name).alias("check_id"), key.cast("string").alias("key"), n.cast("decimal(38,0)").alias("n"))
        one, none = F.lit(1), F.lit(0)
        parts = [F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), fact("failed", name, self.key, one)) for name, c in self.failed.items()]), lambda x: x.isNotNull())] if self.failed else []
        parts += [F.array(*[fact("unique", name, c, none) for name, c in self.unique.items()])] if self.unique else []
        member = lambda name: lambda x: fact("set", name, x, none)  # noqa: E731  # a second argument would be the place
        parts += [F.coalesce(F.transform(c, member(name)), F.array().cast(f"array<{FACT}>")) for name, c in self.sets.items()]
        parts += [F.array(*[fact("total", name, F.lit(""), F.coalesce(c.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))) for name, c in self.totals.items()])] if self.totals else []
        grouped = rows.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.what", "x.check_id", "x.key").agg(F.count("*").alias("rows"), F.sum("x.n").alias("n"))
        return cut(grouped.where("what <> 'unique' or rows > 1"))

    @staticmethod
    def violations(facts: DataFrame) -> DataFrame:
        """(check_id, key): one row for each failed check of a row, one for each value that is not unique."""
        times = F.when(F.col("what") == "failed", F.col("rows")).otherwise(1).cast("int")
        bad = facts.where("what in ('failed', 'unique')")
        return bad.select("check_id", "key", F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")

    def sums(self, facts: DataFrame) -> DataFrame:
        """One row: each total, and the number of different members of each set."""
        total = lambda name: F.coalesce(F.sum(F.when((F.col("what") == "total") & (F.col("check_id") == name), F.col("n"))), F.lit(0)).cast("bigint").alias(name)
        members = lambda name: F.count_if((F.col("what") == "set") & (F.col("check_id") == name)).alias(name)
        return facts.agg(*[total(n) for n in self.totals], *[members(n) for n in self.sets])


def differences(stated: DataFrame, counted: DataFrame, check: str) -> DataFrame:
    """One-row tables: a violation for each number that isn't what was counted, absent ones included."""
    names = counted.columns
    both = stated.select(*[F.col(n).alias(f"s_{n}") for n in names]).limit(1).join(F.broadcast(counted), how="full_outer")  # one row each
    off = F.filter(F.array(*[F.when(~F.col(f"s_{n}").cast("decimal(38,0)").eqNullSafe(F.col(n).cast("decimal(38,0)")), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return both.where(F.size(off) > 0).select(F.lit(check).alias("check_id"), F.array_join(off, ",").alias("key"))
