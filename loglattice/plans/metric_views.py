"""Registered views of metric rows. Logs are made from the generated tables, line by line, and read by the readers of ``sources.metrics``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.operators import fold
from loglattice.plans.registry import query
from loglattice.sources import metrics
from loglattice.sources.ledger import table


def _shutdowns(spark, d):
    """Each event as a shutdown of its user's session: counters that grow and restart, odd and missing parts, counts under ``usage`` or beside it."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").withColumn("k", k).withColumn("n", F.col("event_id"))
    counts = F.struct((F.col("k") * 100).alias("inputTokens"), (F.col("k") % 7).alias("outputTokens"), (F.col("k") % 4).alias("cacheReadTokens"))
    own = F.when(F.col("n") % 5 == 0, F.to_json(counts)).otherwise(F.to_json(F.struct(counts.alias("usage"))))
    base = F.when(F.col("n") % 4 == 0, F.lit("7")).otherwise(F.to_json(F.struct(F.struct(F.floor("value").alias("promptTokens"), (F.col("n") % 3).alias("output_tokens")).alias("usage"))))
    models = F.when(F.col("n") % 13 == 0, "{}").otherwise(F.format_string('{"gpt-%s": %s, "base": %s}', "event_type", own, base))
    bill = F.concat_ws(", ", F.when(F.col("event_type") == "purchase", F.concat(F.lit('"totalPremiumRequests": '), F.col("value").cast("string"))), F.when(F.col("n") % 3 == 0, F.concat(F.lit('"totalNanoAiu": '), F.col("k").cast("string"))), F.when(F.col("n") % 11 != 0, F.concat(F.lit('"modelMetrics": '), models)))
    line = F.format_string('{"type": "%s", "timestamp": "%s", "data": {%s}}', F.when(F.col("n") % 17 == 0, "session.start").otherwise("session.shutdown"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), bill)
    return e.select(F.format_string("/logs/%d/events.jsonl", "user_id").alias("file"), F.col("n").alias("line_no"), line.alias("line"))


CLI_SQL = """, s AS (SELECT user_id AS u, event_id AS n, event_id % 13 <> 0 AS full_map, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts, CASE WHEN event_type = 'purchase' THEN value END AS cr, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS na
 FROM events WHERE event_id % 17 <> 0 AND event_id % 11 <> 0), told AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n) - 1 AS no, last_value(cr IGNORE NULLS) OVER b AS cr0, last_value(na IGNORE NULLS) OVER b AS na0 FROM s WHERE full_map OR cr IS NOT NULL OR na IS NOT NULL
 WINDOW b AS (PARTITION BY u ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), m AS (SELECT u, n, 'gpt-' || event_type AS model, k * 100 AS i, k % 7 AS o, k % 4 AS c FROM told WHERE full_map UNION ALL SELECT u, n, 'base', CAST(floor(value) AS BIGINT), n % 3, 0 FROM told WHERE full_map AND n % 4 <> 0),
 l AS (SELECT *, coalesce(lag(i) OVER w, 0) AS i0, coalesce(lag(o) OVER w, 0) AS o0, coalesce(lag(c) OVER w, 0) AS c0 FROM m WINDOW w AS (PARTITION BY u, model ORDER BY n)), g AS (SELECT u, n, model, i, o, c, i - CASE WHEN i < i0 THEN 0 ELSE i0 END AS di, o - CASE WHEN o < o0 THEN 0 ELSE o0 END AS d_o, c - CASE WHEN c < c0 THEN 0 ELSE c0 END AS dc FROM l),
 a AS (SELECT u, n, sum(i) AS i, sum(o) AS o, sum(c) AS c, count(*) AS models, sum(di) FILTER (di <> 0 OR d_o <> 0) AS di, sum(d_o) FILTER (di <> 0 OR d_o <> 0) AS d_o, sum(dc) FILTER (di <> 0 OR d_o <> 0) AS dc, count(*) FILTER (di <> 0 OR d_o <> 0) AS moved, min(model) FILTER (di <> 0 OR d_o <> 0) AS one FROM g GROUP BY u, n),
 x AS (SELECT t.*, a.* EXCLUDE (u, n), cr - CASE WHEN cr < coalesce(cr0, 0) THEN 0 ELSE coalesce(cr0, 0) END AS dcr, na - CASE WHEN na < coalesce(na0, 0) THEN 0 ELSE coalesce(na0, 0) END AS dna FROM told t LEFT JOIN a ON a.u = t.u AND a.n = t.n),
 cli AS (SELECT 'cli' AS source, CAST(u AS VARCHAR) AS session, '' AS request, '' AS model, '' AS provider, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, CAST(coalesce(i, 0) AS BIGINT) AS tokens_in, CAST(coalesce(o, 0) AS BIGINT) AS tokens_out, CAST(coalesce(c, 0) AS BIGINT) AS cached_in, CAST(coalesce(models, 0) AS INT) AS n_models, round(cr, 2) AS credits, na AS nano_aiu FROM x
 UNION ALL SELECT 'cli-delta', CAST(u AS VARCHAR), CASE WHEN no < 1000 THEN 's' || lpad(CAST(no AS VARCHAR), 3, '0') ELSE 's' || no END, CASE WHEN moved = 1 THEN one ELSE '' END, CASE WHEN moved = 1 AND one <> 'base' THEN 'openai' ELSE '' END, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), CAST(coalesce(di, 0) AS BIGINT), CAST(coalesce(d_o, 0) AS BIGINT), CAST(coalesce(dc, 0) AS BIGINT), CAST(coalesce(moved, 0) AS INT), round(dcr, 2), dna
 FROM x WHERE coalesce(moved, 0) > 0 OR coalesce(dcr, 0) <> 0 OR coalesce(dna, 0) <> 0)"""


@query(f"{CLI_SQL} SELECT * FROM cli")
def copilot_cli_metrics(spark, d):
    """Running totals of each shutdown and their growth, with restarts; events stand for the shutdowns of their user's session."""
    rows = metrics.copilot_cli(_shutdowns(spark, d))
    return rows.select("source", "session", "request", "model", "provider", "ts", "tokens_in", "tokens_out", "cached_in", F.size("model_totals").alias("n_models"), F.round("credits", 2).alias("credits"), "nano_aiu")


@query(f"{CLI_SQL} SELECT CAST(g.u AS VARCHAR) AS session, g.model, CAST(sum(di) AS BIGINT) AS tokens_in, CAST(sum(dc) AS BIGINT) AS cached_in, CAST(sum(d_o) AS BIGINT) AS tokens_out FROM g WHERE di <> 0 OR d_o <> 0 GROUP BY g.u, g.model")
def copilot_model_totals(spark, d):
    """What each model of a session added, from the growth of its shutdowns: totals nested in rows, summed by model."""
    grown = metrics.copilot_cli(_shutdowns(spark, d)).where("source = 'cli-delta'")
    return metrics.models_of(grown, ["session"]).select("session", F.explode("model_totals").alias("t")).select("session", "t.*")


def _patches(spark, d):
    """Each conversation as a chat's log: a turn writes its request and the one before again, under numbers that come back, so states grow."""
    turn, size = F.col("turn"), F.coalesce(F.length("text"), F.lit(0))
    extension = F.when(turn % 7 == 3, '"other.chat"').when(turn % 7 == 5, "null").when(turn % 2 == 0, '{"value": "GitHub.copilot-chat", "_lower": "github.copilot-chat"}').otherwise('"GitHub.copilot-chat"')
    tokens = F.when(turn % 3 == 0, F.format_string(', "promptTokens": %d, "completionTokens": %d', size, turn)).when(turn % 3 == 1, F.format_string(', "result": {"metadata": {"inputTokens": %d, "cachedTokens": 5}}', size)).otherwise(F.lit(', "sessionCopilotCredits": 1.5, "promptTokens": 0'))
    totals = F.when(turn % 4 == 2, F.format_string(', "modelTotals": [{"model": "m", "inputTokens": %d, "cachedTokens": %d}, "odd", {"modelId": "n", "cachedTokens": 3}]', size, turn)).otherwise("")
    request = F.format_string('{"requestId": "q%d", "timestamp": %d, "modelId": "claude-%d", "agent": {"extensionId": %s}%s%s}', F.floor(turn / 2), F.col("conv_id") * 1000 + turn, turn % 2, extension, tokens, totals)
    state = F.format_string('{"kind": 0, "v": {"sessionId": "c%d", "requests": []}}', F.col("conv_id"))
    patch = F.format_string('{"kind": 2, "k": ["requests"], "v": [%s, 3, {"requestId": "idle", "agent": {"extensionId": "copilot"}}]}', request)
    x = table(spark, d, "conversations").select("conv_id", "turn", F.array(F.when((turn == 1) & (F.col("conv_id") % 3 > 0), state), patch).alias("lines"))
    return x.select(F.format_string("/chats/%d.jsonl", "conv_id").alias("file"), F.posexplode("lines").alias("pos", "line"), "turn").where("line is not null").select("file", (F.col("turn") * 2 + F.col("pos")).alias("line_no"), "line")


@query("""SELECT session, 'q' || q AS request, 'claude-' || turn % 2 AS model, 'anthropic' AS provider, i AS tokens_in, o AS tokens_out, CASE WHEN turn % 4 = 2 THEN turn + 3 ELSE 0 END AS cached_in, CAST(CASE WHEN turn % 4 = 2 THEN 2 ELSE 0 END AS INT) AS n_models, scr AS session_credits, strftime(make_timestamp((conv_id * 1000 + turn) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts
 FROM (SELECT *, turn // 2 AS q, CASE WHEN conv_id % 3 > 0 AND bool_or(turn = 1) OVER (PARTITION BY conv_id) THEN 'c' || conv_id ELSE CAST(conv_id AS VARCHAR) END AS session, CASE WHEN turn % 3 < 2 THEN coalesce(length(text), 0) ELSE 0 END AS i, CASE WHEN turn % 3 = 0 THEN turn ELSE 0 END AS o, CASE WHEN turn % 3 = 2 THEN CAST(1.5 AS DOUBLE) END AS scr,
 row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1 AND turn % 7 NOT IN (3, 5) AND (i <> 0 OR o <> 0 OR turn % 4 = 2 OR scr IS NOT NULL)""")  # fmt: skip
def copilot_chat_metrics(spark, d):
    """The last state of each request of each chat, with what its models used; turns of conversations stand for the patches."""
    rows = fold.copilot_fold(metrics.copilot_chats(_patches(spark, d)))
    return rows.select("session", "request", "model", "provider", "tokens_in", "tokens_out", "cached_in", F.size("model_totals").alias("n_models"), "session_credits", "ts")


@query("""SELECT CASE event_id % 4 WHEN 0 THEN event_type ELSE 'kiro' END AS provider, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'agent' END AS model, count(*) AS n, count(*) AS ids, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS o FROM events) WHERE i <> 0 OR o <> 0 GROUP BY ALL""")
def kiro_ide_metrics(spark, d):
    """Lines of a log of tokens without ids or times; every event is a line of it."""
    n = F.col("event_id")
    told = F.concat_ws(", ", F.when(n % 4 == 0, F.format_string('"provider": "%s"', "event_type")).when(n % 4 == 1, '"provider": ""'), F.when(n % 5 != 0, F.lit('"model": "agent"')), F.concat(F.lit('"promptTokens": '), F.get_json_object("props", "$.k")), F.when(n % 3 == 0, F.concat(F.lit('"generatedTokens": '), F.floor("value").cast("string"))))
    lines = table(spark, d, "events").select(F.lit("/tokens.jsonl").alias("file"), n.alias("line_no"), F.concat(F.lit("{"), told, F.lit("}")).alias("line"))
    rows = fold.kiro_fold(metrics.kiro_ide(lines))
    return rows.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
