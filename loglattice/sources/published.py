"""A ledger of published batches: all rows of a batch, of whatever kinds, become visible in one move or not at all.

``root/batch=00000000000000000007/kind=calls/month=2024-05/…``: a batch is staged beside the ledger and renamed into place. The name is
the mark that the batch is done: a batch that is there is never written again, so one that was killed half-way and runs again
adds every row once; of two writers of one batch the second finds the name taken. Staged files of a killed batch are never read.

The rename has to fail if the name is taken, as it does on HDFS and on local file systems; object stores need a committer that does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class AlreadyPublished(RuntimeError):
    """Another writer has published this batch: its rows stand, and this writer's do not."""


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    root: str

    # --- files ---

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root.rstrip("/"), *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The batches that are published, in order: a listing of names, one a batch."""
        fs, root = self._files(), self._path()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def writer_of(self, batch: int) -> str | None:
        fs, mark = self._files(), self._path(self._name(batch), "_writer")
        if not fs.exists(mark):
            return None
        stream = fs.open(mark)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["writer"]
        finally:
            stream.close()

    @staticmethod
    def _name(batch: int) -> str:
        return f"batch={batch:020d}"

    # --- rows ---

    def scan(self, kind: str, schema: str, since: str | None = None, batch: int | None = None, months: list[str] | None = None) -> DataFrame:
        """Published rows of a kind with their ``batch``; months before ``since``, or other than ``months``, are not opened; rows without a time always are."""
        names = [self._name(b) for b in self.batches() if batch is None or b == batch]
        fs = self._files()
        paths = [f"{self.root.rstrip('/')}/{n}" for n in names if fs.exists(self._path(n, f"kind={kind}"))]
        full = f"{schema}, batch long, kind string, month string"
        if not paths:
            return self.spark.createDataFrame([], full).drop("kind", "month")
        rows = self.spark.read.schema(full).option("basePath", self.root).json(paths).where(F.col("kind") == kind)
        if months is not None:
            rows = rows.where(F.col("month").isin(months))
        if since:
            rows = rows.where((F.col("month") >= since[:7]) | (F.col("month") == "undated")).where(F.col("ts").isNull() | (F.col("ts") >= since))
        return rows.drop("kind", "month")

    def newest(self, kind: str, schema: str) -> DataFrame:
        """The rows of a kind that is written anew with each batch, as of the last one that has it."""
        fs = self._files()
        for b in reversed(self.batches()):
            if fs.exists(self._path(self._name(b), f"kind={kind}")):
                return self.scan(kind, schema, batch=b).drop("batch")
        return self.spark.createDataFrame([], schema)

    def unseen(self, rows: DataFrame, kind: str, key: str = "id") -> DataFrame:
        """The rows whose id is not published yet in the months they fall in, the smallest of those that share one."""
        rest = [c for c in rows.columns if c != key]
        first = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*rows.columns)
        # The months of a batch: those in which its logs were written, not the ledger's.
        months = [r["m"] for r in rows.select(month_of(F.col("ts")).alias("m")).distinct().toLocalIterator()]
        known = self.scan(kind, f"{key} {rows.schema[key].dataType.simpleString()}, ts string", months=months)
        return first.join(known.select(key).distinct(), key, "left_anti")

    def publish(self, batch: int, writer: str, tables: dict[str, DataFrame], staged_now: Callable[[int], None] | None = None) -> bool:
        """Write the tables as one batch. False if this writer has published it before; ``AlreadyPublished`` if another one has. ``staged_now`` is called
        when all is staged and nothing is visible yet."""
        if batch in self.batches():
            return self._mine(batch, writer)
        fs = self._files()
        staged = f"_staged/{self._name(batch)}-{uuid.uuid4().hex}"
        for kind, rows in tables.items():
            dated = rows.withColumn("month", month_of(F.col("ts")) if "ts" in rows.columns else F.lit("undated"))
            dated.write.partitionBy("month").option("compression", "gzip").option("ignoreNullFields", "false").json(f"{self.root.rstrip('/')}/{staged}/kind={kind}")
        fs.mkdirs(self._path(staged))
        mark = fs.create(self._path(staged, "_writer"))
        mark.write(bytearray(json.dumps({"writer": writer, "kinds": sorted(tables)}).encode()))
        mark.close()
        if staged_now:
            staged_now(batch)
        if not self._move(self._path(staged), self._path(self._name(batch))):
            fs.delete(self._path(staged), True)
            return self._mine(batch, writer)
        return True

    def _mine(self, batch: int, writer: str) -> bool:
        if self.writer_of(batch) != writer:
            raise AlreadyPublished(f"batch {batch} of {self.root} is of another writer")
        return False

    def _move(self, source, target) -> bool:
        """Rename a folder, never onto or into another one; False if the name is taken."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._files().getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        from py4j.protocol import Py4JJavaError

        try:
            context.rename(source, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName() or self._files().exists(target):
                return False
            raise
        return True

    def sweep_staged(self) -> None:
        """Delete what killed batches have left; only while no writer runs."""
        self._files().delete(self._path("_staged"), True)


def month_of(ts):
    return F.coalesce(F.nullif(F.regexp_extract(ts, r"^\d{4}-\d{2}", 0), F.lit("")), F.lit("undated"))


def columns(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names
