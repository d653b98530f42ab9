"""Tables that cut a long plan: written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one only on a local master where that is unset, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shoebox-")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def read_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """All Parquet files below a folder, whatever its subfolders are called."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by a hash of columns to at least two tasks a core. Spark cuts a scan by bytes on disk, and small, well compressed files make few tasks, of
    whatever work their rows are."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def cut(df: DataFrame) -> DataFrame:
    """df as a table: its lineage ends there, it is computed once, and any executor can be lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut_all(*tables: DataFrame) -> list[DataFrame]:
    """Several independent tables at once: their jobs share the cluster."""
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        return list(pool.map(cut, tables))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "cut_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
