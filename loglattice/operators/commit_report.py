"""The report of commits: each one's calls, hours and lines, what became of proposals, its files, and the totals of what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators import attribution, joins

#: Of a commit's calls, in the order of ``report``.
USE = {"tokens_in": "tokens_in", "tokens_out": "tokens_out", "cache_read": "cached_in", "cache_write": "cache_write_in"}
PROPOSALS = ("suggested", "kept", "kept_modified", "dropped")
BUCKETS = ("agent", "human", "unattributed", "unknown")


def shown(commits: DataFrame, since: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sha, lo, hi) of the commits to show, and one row (windowed_out, limited_out): how many are older than ``since``, and how many
    of the others are not among the ``limit`` newest. Both are features of the view; without them every commit is shown."""
    windows = joins.windows_of(commits).select("sha", "lo", "hi")
    recent = windows.where(F.col("hi") >= F.lit(since).cast("timestamp")) if since else windows
    newest = recent.orderBy(F.desc("hi"), F.desc("sha")).limit(limit) if limit is not None else recent
    inside = (F.col("hi") >= F.lit(since).cast("timestamp")) if since else F.lit(True)
    left = F.greatest(F.count_if(inside) - limit, F.lit(0)) if limit is not None else F.lit(0).cast("long")
    return newest, windows.agg(F.count_if(~F.coalesce(inside, F.lit(False))).alias("windowed_out"), left.alias("limited_out"))


def on_commits(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """``rows`` with the sha of the one commit that theirs begins or is begun by; rows recorded under short and full shas meet so.

    A sha that is not there, or begins several, stays as it is; rows without one go.
    """
    found = joins.prefix_match(rows.where("coalesce(sha, '') <> ''").select(F.col("sha").alias("_probe")), commits.select("sha"), "_probe", "sha").select("_probe", "match")
    named = rows.withColumnRenamed("sha", "_probe").join(found, "_probe")
    return named.withColumn("sha", F.coalesce("match", "_probe")).select(*rows.columns)


def use_of(joined: DataFrame) -> DataFrame:
    """Each commit's calls: how many, by which way, tokens, and the agents' time: what the calls measured, else from the first to the last of them."""
    micros = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    measured = F.floor(F.sum(F.coalesce("latency_ms", F.lit(0))) / 1000).cast("long")
    span = F.floor((micros(lambda c: F.max(c)) - micros(lambda c: F.min(c))) / 1_000_000).cast("long")
    latency = F.sum(F.coalesce("latency_ms", F.lit(0))) > 0
    return joined.where("sha is not null").groupBy("sha").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("via") == "task").alias("via_task"), F.count_if(F.col("via") == "window").alias("via_window"),
        *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(n) for n, c in USE.items()), F.when(latency, measured).otherwise(span).alias("agent_span_s"),
        F.when(latency, "measured").when(F.max("ts").isNotNull(), "span").otherwise("").alias("agent_span_method"),
    )


def evidence_of(rows: DataFrame) -> DataFrame:
    """Each commit's provenance: sessions and agents in order, the method trusted most (of equals the smallest), sums of what became of proposals."""
    trust = F.coalesce("confidence", F.lit(0.0))
    names = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    return rows.groupBy("sha").agg(
        names("session").alias("sessions"), names("agent").alias("agents"), F.max(trust).alias("confidence"), F.min_by("method", F.struct(-trust, "method")).alias("method"),
        *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in PROPOSALS),
    )


def report(commits: DataFrame, joined: DataFrame, files: DataFrame, provenance: DataFrame, minutes: DataFrame, cap_s: int = 0, estimate: bool = True) -> DataFrame:
    """One row a commit of ``shown``, whether or not anything is known of it.

    ``joined``: calls on commits (``attribution.commit_join``) with latency_ms and the tokens of ``USE``; ``files``: sha, path, added,
    added_gated, removed, binary of the commits' patches; ``provenance``: rows under shas of these commits (``on_commits``), with
    session, agent, method, confidence, files, agent_lines and ``PROPOSALS``; ``minutes``: what people attested. Sums without a row are 0, texts
    NULL. Hours are the attested ones, else the time since the commit before less the agents', unless that is unknown or above ``cap_s``.
    """
    keep = commits.select("sha")
    patch, rows = files.join(keep, "sha", "left_semi"), provenance.join(keep, "sha", "left_semi")
    sizes = patch.groupBy("sha").agg(F.sum(F.when(F.col("binary"), 0).otherwise(F.col("removed"))).cast("long").alias("removed"), F.count_if("binary").alias("binary_files"))
    lines = attribution.commit_buckets(patch.where("not binary"), rows)
    out = commits.join(use_of(joined.join(keep, "sha", "left_semi")), "sha", "left").join(evidence_of(rows), "sha", "left").join(sizes, "sha", "left").join(lines, "sha", "left")
    out = out.join(minutes.select("sha", F.col("minutes").alias("_said")), "sha", "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    wall = F.floor((micros("hi") - micros("lo")) / 1_000_000).cast("long")
    cell = S.hours(wall, F.col("agent_span_s"), F.col("_said"), cap_s, estimate, exact=True)
    counted = ["calls", "via_task", "via_window", *USE, *PROPOSALS, "added", "removed", *BUCKETS, "binary_files"]
    none = F.array().cast("array<string>")
    return out.withColumn("_h", cell).select(
        "sha", F.col("hi").alias("ts"), (F.coalesce("calls", F.lit(0)) > 0).alias("attributed"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted), wall.alias("wall_s"), "agent_span_s",
        F.coalesce("agent_span_method", F.lit("")).alias("agent_span_method"), F.col("_h.value").alias("hours"), F.col("_h.tier").alias("tier"), F.col("_h.reason").alias("reason"),
        F.coalesce("sessions", none).alias("sessions"), F.coalesce("agents", none).alias("agents"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "method",
    )


def totals(rows: DataFrame) -> DataFrame:
    """One row: the sums of a report, its hours with how many of them are attested and estimated, its commits and those with calls."""
    counted = ["calls", *USE, "added", "removed", *PROPOSALS, "binary_files", *BUCKETS]
    return rows.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted), F.round(F.coalesce(F.sum("hours"), F.lit(0.0)), 2).alias("hours"), F.count_if(F.col("tier") == "attested").alias("hours_attested_n"),
        F.count_if(F.col("tier") == "estimated").alias("hours_estimated_n"), F.count(F.lit(1)).alias("commits"), F.count_if("attributed").alias("attributed"),
    )


def file_rows(files: DataFrame, provenance: DataFrame) -> DataFrame:
    """The files of each commit, the most added first, with their lines by author; a binary file has none."""
    text = files.where("not binary")
    split = attribution.file_split(text, provenance).join(text.select("sha", "path", "removed"), ["sha", "path"]).withColumn("binary", F.lit(False))
    rest = files.where("binary").select("sha", "path", *(F.lit(0).cast("long").alias(c) for c in ("added", *BUCKETS, "removed")), F.lit(True).alias("binary"))
    out = split.unionByName(rest)
    return out.orderBy("sha", F.desc("added"), "path")


#: Fewer adopted calls than this say nothing, and how far an adoption is trusted (fixed values).
LEAST = 5
ADOPTED = 0.5


def adopted(calls: DataFrame, tasks: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, task, session, ts, method, confidence): calls without a task that lie in the session and span of a closed one (a row of ``tasks``
    with an outcome). None at all if there are fewer than ``least``. Calls that name a task are no estimate and stay out."""
    closed = tasks.where("coalesce(outcome, '') <> ''").select("task").distinct()
    found = joins.task_join(calls).where("task_via = 'session'").join(closed, "task", "left_semi")
    enough = found.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = found.select("id", "task", "session", "ts", F.lit("estimated").alias("method"), F.lit(ADOPTED).alias("confidence"))
    return rows.where(enough.select("n").scalar().isNotNull())
