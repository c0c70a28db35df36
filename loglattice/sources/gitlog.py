"""Commits from what git prints: ``git log --numstat --format='commit %H %cI'``, and the same with ``-p`` for lines.

The text is written by whoever may run git; here it is read like any other log, commit by commit: a log is split where a commit begins, which no
line of a patch does, so a long log is shared out between tasks and no row holds more than one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators.authorship import CommitLog


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha, ts, body): one row a commit of each log."""
    texts = spark.read.text(path, lineSep="\ncommit ", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^commit ", "").alias("value"))
    head = r"^([0-9a-f]{7,64}) (\S+)\r?(?:\n|$)"
    rows = texts.select("file", F.nullif(F.regexp_extract("value", head, 1), F.lit("")).alias("sha"), F.regexp_extract("value", head, 2).alias("ts"), F.regexp_replace("value", head, "").alias("body"))
    return rows.where("sha is not null")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha, at, line) of each commit's body."""
    return _commits(spark, path).select("file", "sha", F.posexplode(F.split("body", "\r?\n")).alias("at", "line"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(sha, ts) of each commit, in UTC."""
    return _commits(spark, path).select("sha", S.normal_form(F.col("ts")).alias("ts")).distinct()


def numstat(spark: SparkSession, path: str) -> DataFrame:
    """(sha, path, added, removed): NULL counts for a binary file; a renamed file under its new name."""
    form = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    rows = _lines(spark, path).where(F.col("line").rlike(form))
    count = lambda k: F.expr(f"try_cast(regexp_extract(line, '^([0-9]+|-)\\\\t([0-9]+|-)\\\\t(.+)$', {k}) as bigint)")
    return rows.select("sha", S.rename_target(F.regexp_extract("line", form, 3)).alias("path"), count(1).alias("added"), count(2).alias("removed"))


def _patch(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``path``, and whether each is an added line or a file's header.

    A hunk has as many new lines as its header says; until they are there, a line is one of them, whatever it looks like.
    """
    rows = _lines(spark, path)
    w = Window.partitionBy("file", "sha").orderBy("at")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+(?:,(\d+))? @@", 1)
    hunk = F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")
    plus = F.substring("line", 1, 1).isin("+", " ")
    seen = rows.withColumn("_seen", F.count_if(plus).over(before))
    size = F.when(new == "", F.lit(1)).otherwise(new.try_cast("int"))
    seen = seen.withColumn("_until", F.last(F.when(hunk, F.col("_seen") + size), ignorenulls=True).over(upto))
    inside = plus & (F.col("_seen") < F.coalesce("_until", F.lit(0)))
    header = F.col("line").startswith("+++ ") & ~inside
    target = F.when(header, F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]+)", 1)).when(F.col("line").startswith("diff --git "), "")
    named = seen.withColumn("path", F.last(target, ignorenulls=True).over(upto))
    return named.withColumn("is_header", header).withColumn("is_added", inside & F.col("line").startswith("+")).where("path not in ('', '/dev/null')")


def patched_files(spark: SparkSession, path: str) -> DataFrame:
    """(sha, path): files that a commit leaves with a patch, even one that takes lines away alone; removed and merely renamed ones are not among them."""
    return _patch(spark, path).where("is_header").select("sha", "path").distinct()


def added_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sha, path, line): each line that a commit's patch adds, as it stands; a removed file has none."""
    return _patch(spark, path).where("is_added").select("sha", "path", F.substring("line", 2, 1 << 30).alias("line"))


def commit_log(spark: SparkSession, path: str) -> CommitLog:
    """All that authorship capture reads of a log."""
    at = commits(spark, path).select("sha", F.col("ts").cast("timestamp").alias("ts"))
    return CommitLog(at, numstat(spark, path), patched_files(spark, path), added_lines(spark, path))
