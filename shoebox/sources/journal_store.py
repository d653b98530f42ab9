"""Append-only journals with commits.

Rows are staged in a folder of their own; a small record in the commit log then makes them part of the journal. The record appears under its batch's
number by one rename that fails where the number is taken, so a batch counts once however often it is delivered, two writers can't both have a number, and what a killed writer
has left is never read. Readers, in batch or as a stream, follow the log and nothing else.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "batch bigint, folder string, files array<string>"


class Journal:
    """A journal at a path of any file system that Spark reaches: ``log`` has a record a batch, ``data`` a folder for each attempt to write one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self.files.exists(self.hadoop.Path(path))

    def stage(self, rows: DataFrame) -> str:
        """Writes rows to a folder that no reader knows yet."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def commit(self, batch: int, folder: str) -> bool:
        """Makes a staged folder the batch of this number; false, and the folder is gone, where the number is taken."""
        top = self.hadoop.Path(f"{self.path}/data/{folder}")
        names = [s.getPath().getName() for s in self.files.listStatus(top) if s.getPath().getName().startswith("part-")]
        draft, final = self.hadoop.Path(f"{self.path}/drafts/{folder}"), self.hadoop.Path(f"{self.path}/log/{batch:019}.json")
        self.files.mkdirs(final.getParent())
        out = self.files.create(draft, False)
        out.write(bytearray((json.dumps({"batch": batch, "folder": folder, "files": names}) + "\n").encode()))
        out.close()
        spark, none = self.spark, self.spark._sc._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        context = self.hadoop.FileContext.getFileContext(self.files.getUri(), spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(final), none)
        except Exception:
            if not self.files.exists(final):
                raise
            self.files.delete(draft, False)
            self.files.delete(top, True)
            return False
        return True

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Adds rows as the batch of this number; false where it has been added before."""
        return not self._exists(f"{self.path}/log/{batch:019}.json") and self.commit(batch, self.stage(rows))

    def commits(self) -> list:
        """(batch, folder, files) in order; a record a batch."""
        if not self._exists(f"{self.path}/log"):
            return []
        return self.spark.read.schema(RECORD).json(f"{self.path}/log").orderBy("batch").collect()

    def read(self, schema: str | T.StructType | None = None) -> DataFrame:
        """All committed rows. Without any the schema must be given."""
        folders = [f"{self.path}/data/{c.folder}" for c in self.commits()]
        if not folders:
            if schema is None:
                raise ValueError(f"nothing has been committed at {self.path}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*folders)

    def stream(self, schema: str | T.StructType) -> DataFrame:
        """S-8 as a stream: rows of batches as they are committed, each once. The log is the source; tasks read the files that its records name."""
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        top, names = self.path, kind.fieldNames()
        self.files.mkdirs(self.hadoop.Path(f"{top}/log"))

        def run(batches):
            import pyarrow as pa
            import pyarrow.parquet as pq

            from .files import place

            tree = place(f"{top}/data")
            for batch in batches:
                for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with tree.open(f"{folder}/{name}".encode()) as file:
                        for part in pq.ParquetFile(file).iter_batches():
                            yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index(n)) for n in names], names)

        log = self.spark.readStream.schema(RECORD).json(f"{top}/log")
        files = log.select("folder", F.explode("files").alias("name"))
        return files.repartition(F.xxhash64("folder", "name")).mapInArrow(run, kind)

    def append_new(self, rows: DataFrame, key: str) -> int:
        """Adds rows whose key isn't there, each key once, as the next batch; where another writer is faster, against what that one has added. The batch's number."""
        while True:
            log = self.commits()
            new = rows.dropDuplicates([key])
            if log:
                new = new.join(self.read().select(key), key, "left_anti")
            batch = log[-1].batch + 1 if log else 0
            if self.commit(batch, self.stage(new)):
                return batch

    def sweep(self) -> int:
        """Deletes folders that no record names and drafts, as killed writers leave them; no writer may be at work. Their number."""
        known, gone = {c.folder for c in self.commits()}, 0
        for place in ("data", "drafts"):
            if self._exists(f"{self.path}/{place}"):
                for s in self.files.listStatus(self.hadoop.Path(f"{self.path}/{place}")):
                    if s.getPath().getName() not in known:
                        gone += self.files.delete(s.getPath(), True)
        return gone
