"""Sweeps over the logs of agents: only what has changed since the last one is parsed, and only unseen rows are added.

A cursor is a table (file, size, changed) of what a sweep has read; a grown file differs and is read again as a whole, since its
last line may have been cut off, and the ids of its rows keep what is known from being added twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.sources import store, transcripts


def listing(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, size, changed) of every log; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def changed(files: DataFrame, cursor: DataFrame | None) -> DataFrame:
    """The files that are new or differ from what the cursor says."""
    return files if cursor is None else files.join(cursor, ["file", "size", "changed"], "left_anti")


def sweep(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], root: str, kind: str, cursor: DataFrame | None = None, rescan: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parse the changed logs and append their unseen rows; gives (what was appended, the new cursor).

    A rescan reads every log and leaves the cursor as it was, so that the repair of one kind of row hides nothing from
    another. The list of changed files is on the driver, as that of any read is.
    """
    files = listing(spark, path)
    fresh = files if rescan else changed(files, cursor)
    names = [r["file"] for r in fresh.select("file").toLocalIterator()]
    rows = parse(transcripts.numbered_lines(spark, names)) if names else parse(transcripts.numbered_lines(spark, [path])).limit(0)
    added = store.unseen(rows, store.scan(spark, root, kind, "id string, ts string").select("id"))
    store.append_new(added, root, kind)
    return added, cursor if rescan and cursor is not None else files


def restamp(rows: DataFrame, agent: str, surface: str) -> DataFrame:
    """Rows of a custom tool that writes another agent's format, under its own name."""
    return rows.withColumn("agent", F.lit(agent)).withColumn("surface", F.lit(surface))


def uncovered(edits: DataFrame, commits: DataFrame, at: str = "ts") -> DataFrame:
    """Edits newer than the newest commit: they wait for one, and are joined again by the next sweep."""
    newest = commits.agg(F.max(at).alias("_newest"))
    return edits.join(newest, F.col("_newest").isNull() | (F.col(at) > F.col("_newest"))).drop("_newest")


def due(last: float | None, now: float, every: float = 60.0) -> bool:
    """Whether a read should sweep first: not if one has within so many seconds."""
    return last is None or now - last >= every


def captured_counts(before: DataFrame, added: DataFrame) -> DataFrame:
    """(agent, prior, added): rows of each agent so far, and of this sweep."""
    prior = before.groupBy("agent").agg(F.count(F.lit(1)).alias("prior"))
    now = added.groupBy("agent").agg(F.count(F.lit(1)).alias("added"))
    return prior.join(now, "agent", "full").select("agent", F.coalesce("prior", F.lit(0)).alias("prior"), F.coalesce("added", F.lit(0)).alias("added"))
