"""Folds over append-only logs: latest per key, field-wise merge, deltas of counters, multisets of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import scalars as S


#: Rows that one task sorts: tasks grow in number with the table, not in size.
TASK_ROWS = 1 << 20
#: Tasks over which the rows of one key are dealt.
SALTS = 64


def tasks_for(n_rows: int) -> int:
    return max(1, -(-n_rows // TASK_ROWS))


def latest_per_key(rows: DataFrame, keys: list[str], score: list[str]) -> DataFrame:
    """The row with the largest score (in order of its columns) of each key. Partially aggregated, not sorted."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*score)).alias("best"))
    return best.select(*keys, *(F.col("best")[c].alias(c) for c in rest))


def credit_fold(rows: DataFrame) -> DataFrame:
    """Of each session's credit rows, from either home, the one of most turns; the home still written wins a tie, then the id."""
    return latest_per_key(rows, ["session"], ["turns", "live", "id"])


def copilot_fold(rows: DataFrame) -> DataFrame:
    """Of each (source, session, surface, request, call) the row of most tokens, then of most credits: none counts below zero."""
    scored = rows.withColumn("_tokens", F.col("tokens_in") + F.col("tokens_out")).withColumn("_credits", F.coalesce("credits", F.lit(-1.0)))
    return latest_per_key(scored, ["source", "session", "surface", "request", "call"], ["_tokens", "_credits", "id"]).drop("_tokens", "_credits")


def kiro_fold(rows: DataFrame) -> DataFrame:
    """Of each (source, session, turn, row_ref) the row of most turns, then of most tokens."""
    scored = rows.withColumn("_tokens", F.col("tokens_in") + F.col("tokens_out"))
    return latest_per_key(scored, ["source", "session", "turn", "row_ref"], ["turns", "_tokens", "id"]).drop("_tokens")


def claude_chat_fold(rows: DataFrame) -> DataFrame:
    """Of each session's transcript rows the one of most requests, then of most tokens."""
    scored = rows.where("source = 'transcript'").withColumn("_tokens", F.col("tokens_in") + F.col("tokens_out"))
    return latest_per_key(scored, ["session"], ["requests", "_tokens", "id"]).drop("_tokens")


def claude_request_fold(rows: DataFrame) -> DataFrame:
    """Of each (session, request) of the transcripts the row of most tokens."""
    scored = rows.where("source = 'transcript'").withColumn("_tokens", F.col("tokens_in") + F.col("tokens_out"))
    return latest_per_key(scored, ["session", "request"], ["_tokens", "id"]).drop("_tokens")


def credits_of(rows: DataFrame) -> DataFrame:
    """Conversation rows as credit rows; those without credits and without context say nothing and go."""
    used = (F.coalesce("credits", F.lit(0.0)) > 0) | (F.coalesce("context_pct", F.lit(0.0)) > 0)
    return rows.where(used).withColumn("credits", F.coalesce("credits", F.lit(0.0))).withColumn("unit", F.lit("credits")).withColumn("method", F.lit("measured"))


def field_merge(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each field's last recorded value: a later row overrides only what it has."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest))


def delta_with_reset(rows: DataFrame, keys: list[str], order: str, counter: str, name: str) -> DataFrame:
    """Growth of a cumulative counter; a smaller value is a restart and counts whole. Missing values keep the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(counter, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn(name, F.when(F.col(counter) < F.col("_before"), F.col(counter)).otherwise(F.col(counter) - F.col("_before"))).drop("_before")


def multiset_counts(lines: DataFrame, keys: list[str], line: str, name: str) -> DataFrame:
    return lines.groupBy(*keys, line).agg(F.count(F.lit(1)).alias(name))


def multiset_match(proposed: DataFrame, added: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, kept): how many lines both sides have, each used once."""
    p, a = multiset_counts(proposed, keys, line, "p"), multiset_counts(added, keys, line, "a")
    return p.join(a, [*keys, line]).groupBy(*keys).agg(F.sum(F.least("p", "a")).alias("kept"))


def multiset_subtract(proposed: DataFrame, context: DataFrame, keys: list[str], line: str, name: str) -> DataFrame:
    """Lines of ``proposed`` left when those of ``context`` are taken away one by one, with how often.

    A line too short to be matched is never taken away: it says nothing of where it came from.
    """
    p, c = multiset_counts(proposed, keys, line, "p"), multiset_counts(context.where(S.matchable(F.col(line))), keys, line, "c")
    left = F.greatest(F.col("p") - F.coalesce("c", F.lit(0)), F.lit(0))
    return p.join(c, [*keys, line], "left").withColumn(name, left).where(F.col(name) > 0).drop("p", "c")
