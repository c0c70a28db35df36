"""Shared-folder tables and small distributed helpers used by the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MASK64 = (1 << 64) - 1


#: Bytes hashed at once; a longer word is hashed whole all the same.
HASH_BYTES = 1 << 20
#: Longer words are hashed one by one.
WORD_BYTES = 64
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_SPACE = bytes(c in SPACES for c in range(256))
#: What is kept of eight bytes of which only the first so many belong to a word.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_words(raw: bytes, strip: bytes = b"") -> np.ndarray:
    """64-bit hashes of the words of ``raw`` in order: split at ASCII white space, A-Z as a-z.

    Bytes in ``strip`` at either end of a word are left out, if anything is left then. A word's hash starts from its
    length and mixes in eight bytes at a time, all words of a block together.
    """
    if len(raw) <= HASH_BYTES:
        return _hash_block(raw, strip)
    out, at = [], 0
    while at < len(raw):
        end = min(at + HASH_BYTES, len(raw))
        while end < len(raw) and raw[end] not in SPACES:
            end += 1
        out.append(_hash_block(raw[at:end], strip))
        at = end
    return np.concatenate(out)


def _hash_block(raw: bytes, strip: bytes) -> np.ndarray:
    raw = b" %b %b" % (raw.lower(), bytes(8))
    space = np.frombuffer(raw.translate(_IS_SPACE), bool)[:-8]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    if strip:
        core = np.frombuffer(raw.translate(_trim(strip)), bool)[:-8]
        at, before = np.flatnonzero(core), np.r_[0, np.cumsum(core)]
        some = before[end] > before[start]
        start, end = start.copy(), end.copy()
        start[some], end[some] = at[before[start[some]]], at[before[end[some]] - 1] + 1
    size = end - start
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = mix64(out ^ (eight[start] & _KEEP[np.minimum(size, 8)]))
    rows = np.flatnonzero(size > 8)
    for at in range(8, WORD_BYTES, 8):
        if not len(rows):
            break
        out[rows] = mix64(out[rows] ^ (eight[start[rows] + at] & _KEEP[np.minimum(size[rows] - at, 8)]))
        rows = rows[size[rows] > at + 8]
    for k in rows.tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return out


@lru_cache
def _trim(strip: bytes) -> bytes:
    return bytes(c not in strip and c not in SPACES for c in range(256))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see. A session of one machine that names none gets one of its own; a cluster has to name it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = tempfile.mkdtemp(prefix="llm-work-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/llm/{tag}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, batches between Spark and Python are of few rows and bytes, in both memories; the session's own sizes return."""
    before = {key: spark.conf.get(key, None) for key in BATCHES}
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def gather(df: DataFrame) -> list:
    """The rows of a table whose size is fixed, whatever the input."""
    with small_batches(df.sparkSession):
        return df.collect()


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, tag: str, spent: tuple[DataFrame | None, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``spent`` are earlier tables of this kind that nothing reads any more: their files go when ``df`` is written.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    for old in spent:
        discard(old)
    return out


def discard(table: DataFrame | None) -> None:
    """Delete the files of a materialised table; a table of another kind is left alone."""
    if table is not None and (path := _written.pop(table, None)):
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A copy of ``schema`` with more fields; the caller drops columns of these names first."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def number_rows(df: DataFrame, keys: list[str], name: str, tag: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in the order of ``keys``.

    Range-partitions by the keys, numbers each partition on its own and adds partition offsets, so no task
    holds more than its range. The per-partition totals are as many rows as there are partitions.
    Rows that tie in all keys are numbered in some order.
    """
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = parts.withColumn("_shard", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = materialize(parts, tag)
    totals = parts.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n"))
    return parts.join(F.broadcast(shard_offsets(totals, "_n", "_base")), "_shard").withColumn(name, F.col("_base") + F.col("_local")).drop("_shard", "_local", "_base")


def shard_offsets(totals: DataFrame, size: str, base: str) -> DataFrame:
    """(_shard, base): exclusive running sum over one row per partition."""
    from pyspark.sql import Window

    order = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_shard", F.coalesce(F.sum(size).over(order), F.lit(0)).alias(base))


def sum_slices(df: DataFrame, dtype: str = "<i8") -> DataFrame:
    """Sum equal-length count vectors: rows (slice int, counts binary) to one row a slice, in 64 bits ("<i8").

    Each slice has a fixed number of counters (of ``dtype`` in the rows given), one row comes from each task, and a
    group is summed row by row, so memory stays at a few rows whatever the number of tasks.
    """

    def adder(taken: str):
        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                for k, blob in zip(pdf["slice"], pdf["counts"], strict=True):
                    got = np.frombuffer(blob, taken)
                    if k not in sums:
                        sums[k] = got.astype("<i8")
                    else:
                        sums[k] += got
            yield pd.DataFrame({"slice": list(sums), "counts": [v.tobytes() for v in sums.values()]})

        return add

    # Salted first so that one slice of many tasks is combined in several places.
    salted = df.withColumn("salt", F.spark_partition_id() % 8).repartition("slice", "salt").mapInPandas(adder(dtype), "slice int, counts binary")
    return salted.repartition("slice").mapInPandas(adder("<i8"), "slice int, counts binary")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64 (arrays wrap around without a warning)."""
    x = x + _MIX[0]
    x ^= x >> _MIX[1]
    x *= _MIX[2]
    x ^= x >> _MIX[3]
    x *= _MIX[4]
    x ^= x >> _MIX[5]
    return x


_MIX = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31)]


def uniform(bits: np.ndarray) -> np.ndarray:
    """uint64 to doubles strictly between 0 and 1."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))
