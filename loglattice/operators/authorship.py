"""Authorship capture: what agents proposed in their sessions, matched with what commits added, as rows to record once.

Edits that no commit covers yet are kept in a table of their own between sweeps and joined again, so that work is recorded when its
commit is made, however late that is; a row's key makes a sweep that runs again harmless.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loglattice.functions import scalars as S
from loglattice.operators import attribution
from loglattice.sources.shared import cut

#: Fixed values of the record: how far a method is trusted (ranks from 0), and what a second method adds.
TRUST = {"hooked": 2, "transcript": 1, "heuristic": 0}
CORROBORATED = 0.2

EDIT = "id string, session string, ts timestamp, path string, lines array<string>, context array<string>"
ROW = """id string, ts string, sha string, agent string, session string, method string, files array<string>, lines_added bigint, lines_removed bigint,
 suggested bigint, kept bigint, kept_modified bigint, dropped bigint, agent_lines bigint, residual_lines bigint, confidence double"""


@dataclass
class CommitLog:
    """A repository's log: commits (sha, ts), numstat (sha, path, added, removed; NULL for binary), patched (sha, path) and added lines (sha, path, line)."""

    commits: DataFrame
    numstat: DataFrame
    patched: DataFrame
    added: DataFrame


def confidence(method: str, corroborated: Column) -> Column:
    base = (TRUST[method] + 1) / len(TRUST)
    return F.round(F.least(F.lit(1.0), F.lit(base) + F.when(corroborated, CORROBORATED).otherwise(0.0)), 4)


def capture(edits: DataFrame, log: CommitLog, have: DataFrame, repo: str, agent: str = "claude", method: str = "transcript") -> tuple[DataFrame, DataFrame]:
    """(rows to record, edits that still wait).

    ``edits``: ``EDIT``; an id that comes twice is one edit. ``have``: the rows recorded so far (``ROW``). One row a (commit, session) of which
    something landed: its landed files, git's counts for them, what became of the proposed lines, and the other matchable
    lines of those files. Binary files of the commit land with every session on it, as no one can read them. Edits outside the
    repository and edits without a time are left out; those newer than every commit wait.
    """
    commits = cut(log.commits.select("sha", "ts"), "commits")
    placed = cut(attribution.place_edits(edits.dropDuplicates(["id"]).where("ts is not null"), commits, repo), "placed-edits")
    waiting = placed.where("sha is null").withColumn("path", F.concat(F.lit(f"{repo}/"), "path")).select(*edits.columns)
    held = placed.where("sha is not null")
    keys = ["sha", "session"]
    buckets = held.select(*keys).distinct()
    lines = attribution.subtract_context(held, keys)
    files = held.select(*keys, "path").distinct()
    # The commit's side, for the sessions on it alone. Only proposed and binary files bear on a session's row.
    line = S.normalize_line(F.col("line")).alias("line")
    added = log.added.select("sha", "path", line).groupBy("sha", "path", "line").agg(F.count(F.lit(1)).alias("n")).join(files, ["sha", "path"])
    numstat = cut(log.numstat.join(buckets.select("sha").distinct(), "sha", "left_semi"), "numstat")
    patched, binary = log.patched.join(files, ["sha", "path"]), numstat.where("added is null").select("sha", "path").distinct().join(buckets, "sha")
    matches = attribution.match_files(lines, added, binary, keys, files, patched)
    landed = F.col("verdict").isin(*attribution.LANDED)
    counts = numstat.groupBy("sha", "path").agg(F.sum("added").alias("plus"), F.sum("removed").alias("minus"))
    sums = matches.join(counts, ["sha", "path"], "left").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(landed, F.col("path")))).alias("files"), F.sum(F.when(landed, F.coalesce("plus", F.lit(0))).otherwise(0)).alias("lines_added"),
        F.sum(F.when(landed, F.coalesce("minus", F.lit(0))).otherwise(0)).alias("lines_removed"), *(F.sum(c).alias(c) for c in ("suggested", "kept", "kept_modified", "dropped")),
        F.sum("kept").alias("agent_lines"), F.greatest(F.sum(F.when(landed, F.col("added") - F.col("added_gated")).otherwise(0)) - F.sum("kept"), F.lit(0)).alias("residual_lines"),
    ).where(F.size("files") > 0)
    rows = cut(sums, "landed").join(commits.groupBy("sha").agg(F.max("ts").alias("_at")), "sha").withColumn("agent", F.lit(agent)).withColumn("method", F.lit(method))
    other = have.where(F.col("method") != method).select("sha", "session", F.explode("files").alias("_f")).distinct()
    twice = rows.select("sha", "session", F.explode("files").alias("_f")).join(other, ["sha", "session", "_f"]).select(*keys).distinct().withColumn("_c", F.lit(True))
    rows = rows.join(twice, keys, "left").withColumn("confidence", confidence(method, F.coalesce("_c", F.lit(False))))
    rows = rows.withColumn("id", S.short_id("p_", F.col("sha"), F.col("agent"), F.col("session"), F.col("method"))).withColumn("ts", F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    fresh = attribution.not_recorded(rows, have, ["agent", "session", "method"])
    return fresh.select(*StructType.fromDDL(ROW).names), waiting
