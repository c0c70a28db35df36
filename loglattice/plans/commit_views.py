"""Registered views of the report of commits, its files and totals, and of calls adopted by tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.operators import attribution, commit_report
from loglattice.plans.ledger_views import CAPTURE_SQL, COMMITS, JOIN_SQL, _captured, _commits, _joined, _task_calls, _tasks
from loglattice.plans.registry import query

#: Both parts have a table of placed rows.
LAID_SQL = CAPTURE_SQL.removeprefix(f"{COMMITS}, ").replace("placed", "laid")
REPORT_SQL = f"""{JOIN_SQL}, {LAID_SQL}, mins AS (SELECT c.sha, CAST(sum(t.task % 90) AS BIGINT) AS minutes FROM tasks t JOIN commits c ON starts_with(c.sha, t.commit) WHERE t.task % 8 = 0 GROUP BY c.sha),
 rec AS (SELECT sha, CAST(session AS VARCHAR) AS session, sum(suggested) AS suggested, sum(kept) AS kept, sum(CASE WHEN landed THEN suggested - kept ELSE 0 END) AS kept_modified, sum(CASE WHEN landed THEN 0 ELSE suggested END) AS dropped FROM g GROUP BY sha, session HAVING count(*) FILTER (landed) > 0),
 told AS (SELECT sha, string_agg(session, ',' ORDER BY session) AS sessions, sum(suggested) AS suggested, sum(kept) AS kept, sum(kept_modified) AS kept_modified, sum(dropped) AS dropped FROM rec GROUP BY sha), claims AS (SELECT DISTINCT sha, path FROM g WHERE landed),
 bits AS (SELECT x.sha, x.path, x.added IS NULL AS bin, coalesce(x.added, 0) AS added, CASE WHEN x.added IS NULL THEN 0 ELSE x.removed END AS removed, coalesce(x.added - 1, 0) AS keep, CASE WHEN x.added IS NULL THEN 0 ELSE 1 END AS unknown, c.sha IS NOT NULL AND x.added IS NOT NULL AS p FROM patch x LEFT JOIN claims c ON c.sha = x.sha AND c.path = x.path),
 sums AS (SELECT sha, sum(added) AS added, sum(removed) AS removed, count(*) FILTER (bin) AS binary_files, sum(unknown) AS unknown, sum(CASE WHEN p THEN keep ELSE 0 END) AS mine, sum(CASE WHEN p THEN 0 ELSE keep END) AS unattributed FROM bits GROUP BY sha),
 used AS (SELECT sha, count(*) AS calls, count(*) FILTER (named) AS via_task, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, sum(tokens_in // 4) AS cache_read, sum(id % 10) AS cache_write, sum(CASE WHEN id % 9 = 0 THEN id % 5000 ELSE 0 END) AS ms, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS whole FROM placed WHERE reason IS NULL GROUP BY sha),
 r0 AS (SELECT c.sha, c.ts, u.calls, u.via_task, u.tokens_in, u.tokens_out, u.cache_read, u.cache_write, CASE WHEN ms > 0 THEN ms // 1000 ELSE whole END AS span, CASE WHEN ms > 0 THEN 'measured' WHEN whole IS NOT NULL THEN 'span' ELSE '' END AS how, (epoch_us(c.ts) - epoch_us(c.lo)) // 1000000 AS wall, minutes, s.*, least(coalesce(t.kept, 0), coalesce(mine, 0)) AS agent, t.sessions, t.suggested, t.kept, t.kept_modified, t.dropped
 FROM commits c LEFT JOIN used u ON u.sha = c.sha LEFT JOIN told t ON t.sha = c.sha LEFT JOIN (SELECT sha AS s_sha, * EXCLUDE (sha) FROM sums) s ON s_sha = c.sha LEFT JOIN mins m ON m.sha = c.sha),
 report AS (SELECT sha, ts, coalesce(calls, 0) AS calls, coalesce(via_task, 0) AS via_task, coalesce(calls - via_task, 0) AS via_window, CAST(coalesce(tokens_in, 0) AS BIGINT) AS tokens_in, CAST(coalesce(tokens_out, 0) AS BIGINT) AS tokens_out, CAST(coalesce(cache_read, 0) AS BIGINT) AS cache_read, CAST(coalesce(cache_write, 0) AS BIGINT) AS cache_write,
 CAST(coalesce(suggested, 0) AS BIGINT) AS suggested, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(kept_modified, 0) AS BIGINT) AS kept_modified, CAST(coalesce(dropped, 0) AS BIGINT) AS dropped, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(agent AS BIGINT) AS agent,
 CAST(coalesce(mine, 0) - agent AS BIGINT) AS human, CAST(coalesce(unattributed, 0) AS BIGINT) AS unattributed, CAST(coalesce(unknown, 0) AS BIGINT) AS unknown, coalesce(binary_files, 0) AS binary_files, CAST(wall AS BIGINT) AS wall_s, CAST(span AS BIGINT) AS agent_span_s, how AS agent_span_method,
 CASE WHEN minutes IS NOT NULL THEN CAST(format('{{:.2f}}', minutes / 60.0) AS DOUBLE) WHEN wall <= 86400 AND span IS NOT NULL THEN CAST(format('{{:.2f}}', greatest(wall - span, 0) / 3600.0) AS DOUBLE) END AS hours, CASE WHEN minutes IS NOT NULL THEN 'attested' WHEN wall <= 86400 AND span IS NOT NULL THEN 'estimated' END AS tier,
 CASE WHEN minutes IS NOT NULL THEN '' WHEN wall IS NULL THEN 'no-wall' WHEN span IS NULL THEN 'no-agent-span' WHEN wall > 86400 THEN 'gap-too-wide' ELSE '' END AS reason, coalesce(sessions, '') AS sessions FROM r0)"""


def _recorded(spark, d):
    """(files of the patches, provenance): a third of the rows were recorded under short shas."""
    patch, rows = _captured(spark, d)
    text = F.col("added").isNotNull()
    files = patch.select("sha", "path", F.coalesce("added", F.lit(0)).alias("added"), F.when(text, 1).otherwise(0).alias("added_gated"), F.when(text, F.col("removed")).otherwise(0).alias("removed"), (~text).alias("binary"))
    short = rows.withColumn("sha", F.when(F.col("session").cast("long") % 3 == 0, F.substring("sha", 1, 12)).otherwise(F.col("sha")))
    return files, commit_report.on_commits(short, _commits(spark, d))


def _report(spark, d):
    joined = _joined(spark, d)
    use = {"cached_in": F.floor(F.col("tokens_in") / 4), "cache_write_in": F.col("id") % 10, "latency_ms": F.when(F.col("id") % 9 == 0, F.col("id") % 5000).otherwise(0)}
    files, rows = _recorded(spark, d)
    commits = _commits(spark, d)
    return commit_report.report(commit_report.shown(commits)[0], joined.withColumns(use), files, rows, attribution.attested_minutes(_tasks(spark, d), commits), 86400)


@query(f", {REPORT_SQL} SELECT * FROM report")
def commits_report(spark, d):
    """All commits with their calls, tokens, hours (attested by people, else estimated), lines by author and what became of proposals."""
    return _report(spark, d).drop("attributed", "agents", "confidence", "method").withColumn("sessions", F.array_join("sessions", ","))


@query(f""", {REPORT_SQL} SELECT {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["calls", *commit_report.USE, "added", "removed", *commit_report.PROPOSALS, "binary_files", *commit_report.BUCKETS])},
 round(coalesce(sum(hours), 0), 2) AS hours, count(*) FILTER (tier = 'attested') AS hours_attested_n, count(*) FILTER (tier = 'estimated') AS hours_estimated_n, count(*) AS commits, count(*) FILTER (calls > 0) AS attributed FROM report""")  # fmt: skip
def commits_totals(spark, d):
    return commit_report.totals(_report(spark, d))


@query(f""", {REPORT_SQL}, dealt AS (SELECT b.*, coalesce(CASE WHEN b.p AND pool > 0 THEN least(CAST(round_even(CAST(t.kept AS DOUBLE) * keep / pool, 0) AS BIGINT), keep) END, 0) AS agent
 FROM bits b LEFT JOIN told t ON t.sha = b.sha LEFT JOIN (SELECT sha, sum(keep) AS pool FROM bits WHERE p GROUP BY sha) w ON w.sha = b.sha)
 SELECT sha, path, added, removed, agent, CASE WHEN p THEN keep - agent ELSE 0 END AS human, CASE WHEN p THEN 0 ELSE keep END AS unattributed, unknown, bin AS binary FROM dealt""")  # fmt: skip
def commit_files(spark, d):
    """The files of all commits, their lines by author."""
    return commit_report.file_rows(*_recorded(spark, d))


@query(f""", {JOIN_SQL}, found AS (SELECT s.id, min(p.task) AS task, any_value(s.session) AS session FROM said s JOIN (inn JOIN spans USING (task)) p ON s.session = p.session AND s.ts BETWEEN p.lo AND p.hi WHERE s.task IS NULL GROUP BY s.id),
 kept_ AS (SELECT * FROM found WHERE task IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 4 = 0 AND user_id % 5 > 0)) SELECT id, task, session, 'estimated' AS method, CAST({commit_report.ADOPTED} AS DOUBLE) AS confidence FROM kept_ WHERE (SELECT count(*) FROM kept_) >= 5""")  # fmt: skip
def task_correlation(spark, d):
    """Calls that name no task, estimated to be of the closed one in whose session and span they lie."""
    return commit_report.adopted(_task_calls(spark, d), _tasks(spark, d)).drop("ts")
