"""Tables by key: the last value of each, merged bucket by bucket, so that what a write does not touch stays byte for byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loglattice.operators import fold

BUCKETS = 256


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows, one a key. A table never written is empty."""
    try:
        return spark.read.schema(f"{schema}, bucket int").parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, bucket int")


def upsert(rows: DataFrame, root: str, key: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Put rows in: of a key's rows, old and new, the one last by ``order`` stays. Only buckets that a new row falls into are read and written.

    One writer at a time; the number of buckets is the table's and does not change. Rows without a key are left out.
    """
    spark, names = rows.sparkSession, rows.columns
    new = rows.where(F.col(key).isNotNull()).withColumn("bucket", _bucket(key, buckets)).persist()
    try:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = read(spark, root, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)).where(F.col("bucket").isin(touched))
        # At a tie in order the new row stays.
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        merged = fold.latest_per_key(both, ["bucket", key], [*order, "_new"]).select(*names, "bucket")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)
    finally:
        new.unpersist()
