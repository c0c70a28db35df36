"""The ledger as a folder of JSON rows, by kind and month: scans that skip months, appends of unseen rows, rewrites.

``root/kind=calls/month=2024-05/…``: the month is that of a row's own time, so a scan since a time opens no earlier month,
and an append compares ids with the months at hand alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

#: Kinds of rows that tell use. Together they say who was captured; they tell the same use several times and are never summed.
USAGE_KINDS = ["calls", "consumer", "copilot", "kiro", "claude"]


def _dated(rows: DataFrame, kind: str) -> DataFrame:
    month = F.regexp_extract("ts", r"^\d{4}-\d{2}", 0)
    return rows.withColumn("kind", F.lit(kind)).withColumn("month", F.coalesce(F.nullif(month, F.lit("")), F.lit("undated")))


def append(rows: DataFrame, root: str, kind: str) -> None:
    """Add rows to their months. Rows without a time stand in a month of their own."""
    _dated(rows, kind).write.mode("append").partitionBy("kind", "month").json(root)


def scan(spark: SparkSession, root: str, kind: str, schema: str, since: str | None = None) -> DataFrame:
    """Rows of a kind, of ``since`` or later where it is given; rows without a time always. A kind never written is empty.

    A broken line, or the last one of a log cut off, is skipped; a value of the wrong type is NULL and its row stays.
    """
    try:
        lines = spark.read.schema("value string, kind string, month string").text(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    lines = lines.where(F.col("kind") == kind)
    if since:
        lines = lines.where((F.col("month") >= since[:7]) | (F.col("month") == "undated"))
    rows = lines.where("trim(value) <> '' and try_parse_json(value) is not null").select(F.from_json("value", StructType.fromDDL(schema)).alias("r")).where("r is not null").select("r.*")
    return rows.where(F.col("ts").isNull() | (F.col("ts") >= since)) if since else rows


def unseen(rows: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose id is not kept yet, the smallest of those that share one."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    return first.join(kept.select(key).distinct(), key, "left_anti").select(*rows.columns)


def append_new(rows: DataFrame, root: str, kind: str, key: str = "id") -> None:
    """Append the rows whose id their own months do not hold yet. One writer at a time, as of any table of files."""
    spark = rows.sparkSession
    months = _dated(rows, kind).select("month").distinct()
    try:
        have = spark.read.schema("value string, kind string, month string").text(root).where(F.col("kind") == kind).join(months, "month", "left_semi")
        kept = have.select(F.get_json_object("value", f"$.{key}").cast(rows.schema[key].dataType).alias(key))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = rows.select(key).limit(0)
    append(unseen(rows, kept, key), root, kind)


def union_usage(tables: dict[str, DataFrame]) -> DataFrame:
    """All kinds of use in one table, each row with its ``kind``, for questions of who and when."""
    out = None
    for kind, rows in tables.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def savings(spark: SparkSession, root: str, schema: str, reserved: tuple[str, ...] = ("calls", "kiro", "claude", "copilot", "consumer")) -> DataFrame:
    """Receipts of all tools: one folder of logs a tool, folders of other kinds left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(root).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"))
    lines = lines.where(~F.col("folder").isin(*reserved) & F.expr("try_parse_json(value) is not null"))
    return lines.select("folder", F.from_json("value", StructType.fromDDL(schema)).alias("r")).where("r is not null").select("folder", "r.*")


def tail(rows: DataFrame, n: int, at: str = "ts") -> DataFrame:
    """The n newest rows: a feature of the log's view, for a person to read."""
    return rows.orderBy(F.desc(at)).limit(n)


def where_equal(rows: DataFrame, **values: str | None) -> DataFrame:
    """Rows with these values; an empty value asks for nothing."""
    for name, value in values.items():
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def prune(spark: SparkSession, root: str, kind: str, schema: str, before: str, out: str) -> DataFrame:
    """Write what retention keeps to a new root: rows of ``before`` or later and rows without a time. Gives what it wrote."""
    kept = scan(spark, root, kind, schema)
    append(kept.where(F.col("ts").isNull() | (F.col("ts") >= before)), out, kind)
    return scan(spark, out, kind, schema)


def retain(spark: SparkSession, root: str, kind: str, before: str) -> tuple[int, int]:
    """Retention in place: rows of a kind older than ``before`` go, as they stand in their lines; gives (months dropped, months rewritten).

    Whole months go with their folder, the month of the cutoff is written anew, no other file is touched; rows without a time stay, and so do
    lines that are no JSON.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(f"{root}/kind={kind}")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    months = sorted(s.getPath().getName().removeprefix("month=") for s in fs.listStatus(top)) if fs.exists(top) else []
    drop = lambda m: fs.delete(hadoop.Path(top, f"month={m}"), True)
    gone = [m for m in months if m != "undated" and m < before[:7]]
    for m in gone:
        drop(m)
    if before[:7] not in months:
        return len(gone), 0
    lines = spark.read.schema("value string, kind string, month string").text(root).where((F.col("kind") == kind) & (F.col("month") == before[:7]))
    ts = F.get_json_object("value", "$.ts")
    kept = lines.where(ts.isNull() | (ts >= before))
    if lines.count() == (left := kept.count()):
        return len(gone), 0
    if left:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "month").text(root)
    else:
        drop(before[:7])
    return len(gone), 1
