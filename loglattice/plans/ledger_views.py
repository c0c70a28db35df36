"""Registered views of commits, chats, authorship, savings and capture health, on stand-ins made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators import attribution, authorship, fold
from loglattice.plans import views
from loglattice.plans.registry import query
from loglattice.sources import store
from loglattice.sources.ledger import calls, table

METRICS_SQL = """metrics AS (SELECT id, session, agent, ts, CASE WHEN id % 3 = 0 THEN 'transcript' ELSE 'debug' END AS source, session % 3 AS surface, id % 11 AS request, id % 2 AS call, id % 5 AS turn, id % 4 AS row_ref,
 tokens_out % 7 AS turns, id % 2 AS live, tokens_out % 9 AS requests, tokens_in, tokens_out, credits, CASE WHEN id % 4 = 0 THEN 12.5 ELSE 0 END AS context_pct FROM calls)"""


def _metrics(spark, d):
    x = lambda e, n: F.expr(e).alias(n)
    return calls(spark, d).select(
        "id", "session", "agent", "ts", x("case when id % 3 = 0 then 'transcript' else 'debug' end", "source"), x("session % 3", "surface"), x("id % 11", "request"), x("id % 2", "call"), x("id % 5", "turn"), x("id % 4", "row_ref"),
        x("tokens_out % 7", "turns"), x("id % 2", "live"), x("tokens_out % 9", "requests"), "tokens_in", "tokens_out", "credits", x("case when id % 4 = 0 then 12.5d else 0d end", "context_pct"),
    )


@query(f", {METRICS_SQL} SELECT session, id, turns, credits FROM (SELECT session, id, turns, coalesce(credits, 0) AS credits, row_number() OVER (PARTITION BY session ORDER BY turns DESC, live DESC, id DESC) AS r FROM metrics WHERE coalesce(credits, 0) > 0 OR context_pct > 0) WHERE r = 1")
def credit_rows(spark, d):
    return fold.credit_fold(fold.credits_of(_metrics(spark, d))).select("session", "id", "turns", "credits")


def _best(keys: str, score: str, where: str = "true") -> str:
    return f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {keys} ORDER BY {score}) AS r FROM metrics WHERE {where}) WHERE r = 1"


@query(f""", {METRICS_SQL} SELECT 'copilot' AS grain, id FROM ({_best("source, session, surface, request, call", "tokens_in + tokens_out DESC, coalesce(credits, -1) DESC, id DESC")})
 UNION ALL SELECT 'kiro', id FROM ({_best("source, session, turn, row_ref", "turns DESC, tokens_in + tokens_out DESC, id DESC")})
 UNION ALL SELECT 'chat', id FROM ({_best("session", "requests DESC, tokens_in + tokens_out DESC, id DESC", "source = 'transcript'")})
 UNION ALL SELECT 'request', id FROM ({_best("session, request", "tokens_in + tokens_out DESC, id DESC", "source = 'transcript'")})""")  # fmt: skip
def metric_folds(spark, d):
    """The four grains in which a use told several times is told once."""
    m = _metrics(spark, d)
    grains = {"copilot": fold.copilot_fold, "kiro": fold.kiro_fold, "chat": fold.claude_chat_fold, "request": fold.claude_request_fold}
    out = None
    for name, made in grains.items():
        rows = made(m).select(F.lit(name).alias("grain"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


COMMITS = "commits AS (SELECT sha1(CAST(event_id AS VARCHAR)) AS sha, ts, lag(ts) OVER (ORDER BY ts, sha1(CAST(event_id AS VARCHAR))) AS lo FROM events WHERE event_type = 'signup')"
JOIN_SQL = f"""{COMMITS}, tasks AS (SELECT user_id AS task, substr(CASE WHEN user_id % 3 = 0 THEN sha1('gone' || CAST(min(event_id) AS VARCHAR)) ELSE sha1(CAST(min(event_id) AS VARCHAR)) END, 1, 12) AS commit FROM events WHERE event_type = 'signup' AND user_id % 4 = 0 AND user_id % 5 > 0 AND user_id % 7 > 0 GROUP BY user_id),
 said AS (SELECT id, session, ts, CASE WHEN id % 30 = 0 THEN 100000 + id WHEN id % 6 = 0 THEN session END AS task FROM calls), spans AS (SELECT task, min(ts) AS lo, max(ts) AS hi FROM said WHERE task IS NOT NULL GROUP BY task), inn AS (SELECT DISTINCT task, session FROM said WHERE task IS NOT NULL),
 took AS (SELECT s.id, coalesce(any_value(s.task), min(p.task)) AS task FROM said s LEFT JOIN (inn JOIN spans USING (task)) p ON s.task IS NULL AND s.session = p.session AND s.ts BETWEEN p.lo AND p.hi GROUP BY s.id),
 rows_ AS (SELECT c.id, c.ts, took.task, CASE agent WHEN 'view' THEN 'claude' ELSE agent END AS agent, CASE WHEN c.id % 3 = 0 THEN 'cli' ELSE 'ide' END AS surface, CASE c.id % 5 WHEN 0 THEN '' WHEN 1 THEN 'q' ELSE 'p' END AS project, tokens_in, tokens_out FROM calls c JOIN took USING (id)),
 early AS (SELECT r.*, t.commit IS NOT NULL AS named, (SELECT min(sha) FROM commits WHERE starts_with(sha, t.commit)) AS task_sha FROM rows_ r LEFT JOIN tasks t ON r.task = t.task),
 placed AS (SELECT e.*, CASE WHEN named THEN CASE WHEN task_sha IS NULL THEN 'dangling-task' END WHEN NOT (agent IN ('claude', 'click') OR agent = 'purchase' AND surface = 'cli') THEN 'no-ts-fidelity' WHEN project = '' THEN 'no-project' WHEN project <> 'p' THEN 'other-project' WHEN c.sha IS NULL THEN 'after-head' END AS reason,
 CASE WHEN named THEN task_sha ELSE c.sha END AS sha FROM early e LEFT JOIN commits c ON (e.ts > c.lo OR c.lo IS NULL) AND e.ts <= c.ts)"""


def _commits(spark, d):
    return table(spark, d, "events").where("event_type = 'signup'").select(F.sha1(F.col("event_id").cast("string")).alias("sha"), "ts")


def _tasks(spark, d):
    """Stand-in: every fourth session is a task, a third of whose commits are gone, some still open or closed with changes; people say of half of them how long they took."""
    e = table(spark, d, "events").where("event_type = 'signup' and user_id % 4 = 0").groupBy(F.col("user_id").alias("task")).agg(F.min("event_id").cast("string").alias("first"))
    closed = [F.when(F.col("task") % 5 > 0, "done").otherwise("").alias("outcome"), F.when(F.col("task") % 7 > 0, 0).otherwise(2).alias("files_changed")]
    commit = F.substring(F.sha1(F.when(F.col("task") % 3 == 0, F.concat(F.lit("gone"), "first")).otherwise(F.col("first"))), 1, 12)
    return e.select("task", *closed, commit.alias("commit"), F.when(F.col("task") % 8 == 0, F.col("task") % 90).alias("human_minutes"))


def _task_calls(spark, d):
    """Every sixth call names its session's task, or one that no row tells of, and those between them belong to it."""
    return calls(spark, d).select(
        "id", "ts", "session", F.when(F.col("id") % 30 == 0, F.col("id") + 100000).when(F.col("id") % 6 == 0, F.col("session")).alias("task"), F.when(F.col("agent") == "view", "claude-code").otherwise(F.col("agent")).alias("agent"),
        F.when(F.col("id") % 3 == 0, "cli").otherwise("ide").alias("surface"), F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, "q").otherwise("p").alias("project"), "tokens_in", "tokens_out",
    )


def _joined(spark, d):
    trusted = spark.createDataFrame([("claude", None, True), ("click", None, True), ("purchase", "cli", True), ("purchase", None, False)], "agent string, surface string, joinable boolean")
    return attribution.commit_join(_task_calls(spark, d), _commits(spark, d), attribution.trusted_commits(_tasks(spark, d))[0], trusted, "p")


@query(f", {JOIN_SQL} SELECT id, CASE WHEN reason IS NULL THEN sha END AS sha, CASE WHEN reason IS NULL THEN CASE WHEN named THEN 'task' ELSE 'window' END END AS via, reason FROM placed")
def commit_join(spark, d):
    """Each call's commit: that of its task first, else the one whose window holds it; or why it has none."""
    return _joined(spark, d).select("id", "sha", "via", "reason")


@query(f", {JOIN_SQL} SELECT reason, count(*) AS calls, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens FROM placed WHERE reason IS NOT NULL GROUP BY reason")
def commit_join_excluded(spark, d):
    return attribution.excluded(_joined(spark, d))


@query(f""", {JOIN_SQL}, per AS (SELECT sha, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS span FROM placed WHERE reason IS NULL GROUP BY sha),
 walls AS (SELECT sha, ts, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lo)) AS BIGINT) AS wall FROM commits ORDER BY ts DESC, sha DESC LIMIT 50)
 SELECT sha, coalesce(calls, 0) AS calls, tokens_in, tokens_out, CASE WHEN wall IS NOT NULL AND span IS NOT NULL AND wall <= 86400 THEN round(greatest(wall - span, 0) / 3600.0, 2) END AS hours,
 CASE WHEN wall IS NOT NULL AND span IS NOT NULL AND wall <= 86400 THEN 'estimated' END AS tier, CASE WHEN wall IS NULL THEN 'no-wall' WHEN span IS NULL THEN 'no-agent-span' WHEN wall > 86400 THEN 'gap-too-wide' ELSE '' END AS reason FROM walls LEFT JOIN per USING (sha)""")  # fmt: skip
def commits_view(spark, d):
    """The fifty newest commits (the view's own limit, taken before anything is looked up), their calls and hours."""
    whole = lambda c: F.unix_timestamp(F.date_trunc("second", c.cast("timestamp")))
    lo = F.lag("ts").over(Window.orderBy("ts", "sha"))
    newest = _commits(spark, d).orderBy(F.desc("ts"), F.desc("sha")).limit(51).withColumn("lo", lo).orderBy(F.desc("ts"), F.desc("sha")).limit(50)
    per = _joined(spark, d).where("reason is null").groupBy("sha").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (whole(F.max("ts")) - whole(F.min("ts"))).alias("span"))
    cell = S.hours(whole(F.col("ts")) - whole(F.col("lo")), F.col("span"), F.lit(None).cast("double"), 86400)
    return newest.join(per, "sha", "left").withColumn("h", cell).select("sha", F.coalesce("calls", F.lit(0)).alias("calls"), "tokens_in", "tokens_out", F.col("h.value").alias("hours"), F.col("h.tier").alias("tier"), F.col("h.reason").alias("reason"))


PROVENANCE_SQL = """prov AS (SELECT l_orderkey AS sha, CASE l_returnflag WHEN 'A' THEN 'view' WHEN 'N' THEN 'click' ELSE 'purchase' END AS agent, l_suppkey AS session, CAST(l_quantity AS BIGINT) AS agent_lines,
 CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_partkey % 50 AS BIGINT) END AS residual_lines, l_linenumber / 10.0 AS confidence, l_linestatus AS method FROM lineitem)"""


def _provenance(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sha"), F.when(F.col("l_returnflag") == "A", "view").when(F.col("l_returnflag") == "N", "click").otherwise("purchase").alias("agent"), F.col("l_suppkey").alias("session"), F.col("l_quantity").cast("long").alias("agent_lines"),
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_partkey") % 50).cast("long").alias("residual_lines"), (F.col("l_linenumber") / 10.0).alias("confidence"), F.col("l_linestatus").alias("method"),
    )


@query(f""", {PROVENANCE_SQL}, auth AS (SELECT agent, session, CAST(sum(CASE WHEN residual_lines IS NOT NULL THEN agent_lines END) AS BIGINT) AS agent_lines, CAST(sum(residual_lines) AS BIGINT) AS residual, count(*) AS n, count(*) FILTER (residual_lines IS NULL) AS old FROM prov GROUP BY agent, session),
 chats AS (SELECT session, agent, session % 3 AS surface, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, round(sum(credits), 2) AS credits, count(*) AS n_calls FROM calls GROUP BY ALL),
 titles AS (SELECT conv_id AS session, arg_max(text, turn) AS title FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id), saved AS (SELECT l_orderkey AS session, count(*) AS receipts FROM lineitem GROUP BY l_orderkey)
 SELECT c.session, c.agent, c.tokens_in, c.credits, coalesce(substr(title, 1, 40), CAST(c.session AS VARCHAR)) AS label, coalesce(receipts, 0) AS receipts,
 CASE WHEN c.agent = 'signup' THEN 'coverage' WHEN n IS NULL THEN 'no-evidence' WHEN n = old THEN 'pre-upgrade' WHEN coalesce(agent_lines + residual, 0) = 0 THEN 'no-evidence' ELSE '' END AS refusal,
 CASE WHEN c.agent <> 'signup' AND n > old AND agent_lines + residual > 0 THEN round(100.0 * agent_lines / (agent_lines + residual), 6) END AS agent_pct
 FROM chats c LEFT JOIN auth USING (agent, session) LEFT JOIN titles USING (session) LEFT JOIN saved USING (session)""")  # fmt: skip
def chats_view(spark, d):
    """The chats with titles (the last one written), savings, and the agents' share of landed lines or why there is none."""
    chats = calls(spark, d).groupBy("session", "agent", (F.col("session") % 3).alias("surface")).agg(F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("credits"), 2).alias("credits"), F.count(F.lit(1)).alias("n_calls"))
    known = F.col("residual_lines").isNotNull()
    auth = _provenance(spark, d).groupBy("agent", "session").agg(F.sum(F.when(known, F.col("agent_lines"))).alias("agent_lines"), F.sum("residual_lines").alias("residual"), F.count(F.lit(1)).alias("n"), F.count_if(~known).alias("old"))
    titles = table(spark, d, "conversations").where("role = 'user' and text <> ''").groupBy(F.col("conv_id").alias("session")).agg(F.max_by("text", "turn").alias("title"))
    saved = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.count(F.lit(1)).alias("receipts"))
    rows = chats.join(auth, ["agent", "session"], "left").join(titles, "session", "left").join(saved, "session", "left")
    share = S.agent_percent(F.col("agent"), F.col("agent_lines"), F.col("residual"), F.col("n"), F.col("old"), ["signup"])
    rows = rows.withColumn("s", share).orderBy(F.desc("tokens_in"), F.desc(F.coalesce("credits", F.lit(0))), "session")
    return rows.select("session", "agent", "tokens_in", "credits", S.label(F.substring("title", 1, 40), F.col("session").cast("string")).alias("label"), F.coalesce("receipts", F.lit(0)).alias("receipts"), F.col("s.refusal").alias("refusal"), F.round("s.value", 6).alias("agent_pct"))


@query(f", {PROVENANCE_SQL} SELECT o_orderkey AS sha, coalesce(agent, 'unknown') AS origin, confidence FROM orders LEFT JOIN (SELECT sha, arg_max(agent, (confidence, session, agent)) AS agent, max(confidence) AS confidence FROM prov GROUP BY sha) ON sha = o_orderkey")
def origin_of_commit(spark, d):
    """Each commit's likeliest author: the row of most confidence; unknown without any."""
    best = _provenance(spark, d).groupBy("sha").agg(F.max_by("agent", F.struct("confidence", "session", "agent")).alias("agent"), F.max("confidence").alias("confidence"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sha")).join(best, "sha", "left").select("sha", F.coalesce("agent", F.lit("unknown")).alias("origin"), "confidence")


@query("SELECT c.id, c.agent, count(l_orderkey) AS receipts, CAST(sum(l_quantity) AS DOUBLE) AS saved FROM calls c LEFT JOIN lineitem ON l_orderkey = c.id GROUP BY ALL")
def why_call(spark, d):
    """Calls with the receipts filed for them."""
    r = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return calls(spark, d).join(r, F.col("id") == F.col("l_orderkey"), "left").groupBy("id", "agent").agg(F.count("l_orderkey").alias("receipts"), F.sum("l_quantity").cast("double").alias("saved"))


FILES_SQL = "lines AS (SELECT lang AS sha, source AS path, doc_id, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l FROM documents)), p AS (SELECT * FROM lines WHERE doc_id % 2 = 0 AND path NOT LIKE '%a'), a AS (SELECT * FROM lines WHERE doc_id % 2 = 1 AND path NOT LIKE 'w%')"


def _files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("sha"), F.col("source").alias("path"), F.explode(F.split("text", "\n")).alias("line"))
    x = docs.withColumn("line", S.normalize_line(F.col("line")))
    p, a = x.where("doc_id % 2 = 0 and path not like '%a'"), x.where("doc_id % 2 = 1 and path not like 'w%'")
    return attribution.match_files(p, a, x.where("path like '%7'"), ["sha"])


MATCH_SQL = f"""{FILES_SQL}, bin AS (SELECT DISTINCT sha, path, true AS b FROM lines WHERE path LIKE '%7'), m0 AS (SELECT coalesce(pp.sha, aa.sha, bin.sha) AS sha, coalesce(pp.path, aa.path, bin.path) AS path, coalesce(suggested, 0) AS suggested,
 CASE WHEN b THEN 0 ELSE coalesce(kept, 0) END AS kept, CASE WHEN b THEN 0 ELSE coalesce(added, 0) END AS added, CASE WHEN b THEN 0 ELSE coalesce(added_gated, 0) END AS added_gated, added IS NOT NULL OR b IS NOT NULL AS landed,
 CASE WHEN b THEN 'unreadable' WHEN added IS NULL THEN 'dropped' WHEN suggested IS NULL THEN 'not-proposed' WHEN suggested > 0 AND coalesce(kept, 0) = suggested THEN 'kept' ELSE 'landed-modified' END AS verdict
 FROM (SELECT sha, path, count(*) FILTER (length(line) >= 4) AS suggested FROM p GROUP BY ALL) pp FULL JOIN (SELECT sha, path, count(*) AS added, count(*) FILTER (length(line) < 4) AS added_gated FROM a GROUP BY ALL) aa ON pp.sha = aa.sha AND pp.path = aa.path
 FULL JOIN bin ON bin.sha = coalesce(pp.sha, aa.sha) AND bin.path = coalesce(pp.path, aa.path)
 LEFT JOIN (SELECT sha, path, CAST(sum(least(x.n, y.n)) AS BIGINT) AS kept FROM (SELECT sha, path, line, count(*) AS n FROM p WHERE length(line) >= 4 GROUP BY ALL) x JOIN (SELECT sha, path, line, count(*) AS n FROM a WHERE length(line) >= 4 GROUP BY ALL) y USING (sha, path, line) GROUP BY ALL) k
 ON k.sha = coalesce(pp.sha, aa.sha) AND k.path = coalesce(pp.path, aa.path)),
 m AS (SELECT *, CASE WHEN landed THEN suggested - kept ELSE 0 END AS kept_modified, CASE WHEN landed THEN 0 ELSE suggested END AS dropped FROM m0)"""


@query(f", {MATCH_SQL} SELECT sha, path, verdict, suggested, kept, kept_modified, dropped, added, added_gated FROM m")
def match_files(spark, d):
    """Files of a commit that agents proposed lines for or that it changed: languages stand for commits, sources for files."""
    return _files(spark, d)


@query(f""", {MATCH_SQL} SELECT sha, CAST(sum(suggested) AS BIGINT) AS suggested, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(kept_modified) AS BIGINT) AS kept_modified, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(kept) AS BIGINT) AS agent_lines,
 CAST(sum(added) AS BIGINT) AS added, CAST(sum(added_gated) AS BIGINT) AS unknown, count(*) FILTER (verdict = 'not-proposed') AS not_proposed_files, count(*) FILTER (verdict = 'unreadable') AS binary_files FROM m GROUP BY sha""")  # fmt: skip
def match_totals(spark, d):
    return attribution.match_totals(_files(spark, d), ["sha"])


@query(f", {MATCH_SQL} SELECT sha, CAST(sum(kept) AS BIGINT) AS agent_lines, CAST(greatest(sum(CASE WHEN verdict IN ('kept', 'landed-modified', 'unreadable') THEN added - added_gated ELSE 0 END) - sum(kept), 0) AS BIGINT) AS residual_lines FROM m GROUP BY sha")
def residual_lines(spark, d):
    """What is not the agent's in the files that it landed; files that it never proposed count for nobody here."""
    return attribution.residual(_files(spark, d), ["sha"])


CAPTURE_SQL = f"""{COMMITS}, patch AS (SELECT c.sha, 'p' || i AS path, i, event_id, CASE WHEN i = 6 AND event_id % 5 = 0 THEN NULL ELSE event_id % 4 + 1 END AS added, event_id % 3 AS removed FROM commits c JOIN events e ON c.sha = sha1(CAST(e.event_id AS VARCHAR)), range(7) t(i) WHERE (event_id + i) % 3 <> 0 AND event_type = 'signup'),
 added AS (SELECT sha, path, CASE WHEN j = 0 THEN '}}' ELSE 'line ' || (event_id + j) % 6 END AS line FROM (SELECT sha, path, event_id, unnest(range(added)) AS j FROM patch WHERE added IS NOT NULL)),
 edits AS (SELECT event_id AS id, user_id AS session, ts, CASE WHEN event_id % 3 > 0 THEN '/repo/p' ELSE '/repository/p' END || event_id % 7 AS path, ['line ' || event_id % 6, 'line ' || event_id % 4, '}}', 'line  ' || event_id % 6] AS lines, CASE WHEN event_id % 4 = 0 THEN ['line ' || event_id % 4, '}}'] ELSE [] END AS context FROM events WHERE event_type = 'click'),
 placed AS (SELECT e.id, c.sha, c.ts AS at, session, substr(path, 7) AS path, lines, context FROM edits e JOIN commits c ON (e.ts > c.lo OR c.lo IS NULL) AND e.ts <= c.ts WHERE path LIKE '/repo/%'),
 norm AS (SELECT id, sha, session, path, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS line, 1 AS k FROM (SELECT *, unnest(lines) AS l FROM placed) UNION ALL SELECT id, sha, session, path, trim(regexp_replace(l, '\\s+', ' ', 'g')), -1 FROM (SELECT *, unnest(context) AS l FROM placed)),
 proposed AS (SELECT sha, session, path, line, sum(n) AS n FROM (SELECT id, sha, session, path, line, greatest(sum(k), 0) AS n FROM norm WHERE length(line) >= 4 GROUP BY ALL) WHERE n > 0 GROUP BY ALL),
 files AS (SELECT DISTINCT sha, session, path FROM placed UNION SELECT p.sha, p.session, x.path FROM placed p JOIN patch x ON x.sha = p.sha AND x.added IS NULL),
 k AS (SELECT p.sha, session, p.path, sum(least(p.n, a.n)) AS kept FROM proposed p JOIN (SELECT sha, path, line, count(*) AS n FROM added GROUP BY ALL) a ON a.sha = p.sha AND a.path = p.path AND a.line = p.line GROUP BY ALL),
 g AS (SELECT f.sha, f.session, f.path, x.sha IS NOT NULL AS landed, x.sha IS NOT NULL AND x.added IS NULL AS bin, coalesce(x.added, 0) AS plus, CASE WHEN x.added IS NULL THEN 0 ELSE coalesce(x.removed, 0) END AS minus, coalesce(s.n, 0) AS suggested, CASE WHEN x.added IS NULL THEN 0 ELSE coalesce(kept, 0) END AS kept, greatest(coalesce(x.added, 0) - 1, 0) AS matchable
 FROM files f LEFT JOIN patch x ON x.sha = f.sha AND x.path = f.path LEFT JOIN (SELECT sha, session, path, sum(n) AS n FROM proposed GROUP BY ALL) s ON s.sha = f.sha AND s.session = f.session AND s.path = f.path LEFT JOIN k ON k.sha = f.sha AND k.session = f.session AND k.path = f.path)"""


def _captured(spark, d):
    """(files of the patches, rows to record). Clicks stand for edits, signups for commits whose patches follow from their ids: some binary, some of files that nobody edited, some edits merely restating lines."""
    e = table(spark, d, "events")
    sign = e.where("event_type = 'signup'").select(F.sha1(F.col("event_id").cast("string")).alias("sha"), "ts", "event_id")
    patch = sign.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6)))).where("(event_id + i) % 3 <> 0")
    patch = patch.select("sha", F.concat(F.lit("p"), F.col("i").cast("string")).alias("path"), "event_id", F.when((F.col("i") != 6) | (F.col("event_id") % 5 != 0), F.col("event_id") % 4 + 1).alias("added"), (F.col("event_id") % 3).alias("removed"))
    text = patch.where("added is not null")
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("added") - 1)).alias("j")
    added = text.select("sha", "path", "event_id", j).select("sha", "path", F.when(F.col("j") == 0, "}").otherwise(F.concat(F.lit("line "), ((F.col("event_id") + F.col("j")) % 6).cast("string"))).alias("line"))
    log = authorship.CommitLog(sign.select("sha", F.col("ts").cast("timestamp").alias("ts")), patch.select("sha", "path", "added", F.when(F.col("added").isNotNull(), F.col("removed")).alias("removed")), text.select("sha", "path"), added)
    line = lambda k, gap=" ": F.concat(F.lit("line" + gap), (F.col("event_id") % k).cast("string"))
    root = F.when(F.col("event_id") % 3 > 0, "/repo/p").otherwise("/repository/p")
    edits = e.where("event_type = 'click'").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.concat(root, (F.col("event_id") % 7).cast("string")).alias("path"),
        F.array(line(6), line(4), F.lit("}"), line(6, "  ")).alias("lines"), F.when(F.col("event_id") % 4 == 0, F.array(line(4), F.lit("}"))).otherwise(F.array().cast("array<string>")).alias("context"),
    )
    rows, _ = authorship.capture(edits, log, spark.createDataFrame([], authorship.ROW), "/repo")
    return patch, rows


@query(f""", {CAPTURE_SQL} SELECT sha, CAST(session AS VARCHAR) AS session, string_agg(path, ',' ORDER BY path) FILTER (landed) AS files, CAST(sum(plus) FILTER (landed) AS BIGINT) AS lines_added, CAST(sum(minus) FILTER (landed) AS BIGINT) AS lines_removed, CAST(sum(suggested) AS BIGINT) AS suggested, CAST(sum(kept) AS BIGINT) AS kept,
 CAST(sum(CASE WHEN landed THEN suggested - kept ELSE 0 END) AS BIGINT) AS kept_modified, CAST(sum(CASE WHEN landed THEN 0 ELSE suggested END) AS BIGINT) AS dropped, CAST(sum(kept) AS BIGINT) AS agent_lines, CAST(greatest(sum(CASE WHEN landed THEN matchable ELSE 0 END) - sum(kept), 0) AS BIGINT) AS residual_lines
 FROM g GROUP BY sha, session HAVING count(*) FILTER (landed) > 0""")  # fmt: skip
def authorship_capture(spark, d):
    return _captured(spark, d)[1].select("sha", "session", F.array_join("files", ",").alias("files"), "lines_added", "lines_removed", "suggested", "kept", "kept_modified", "dropped", "agent_lines", "residual_lines")


@query(f", {COMMITS} SELECT sha, user_id AS session, 'p' || CAST(event_id % 7 AS VARCHAR) AS path, count(*) AS edits FROM events e JOIN commits c ON (e.ts > c.lo OR c.lo IS NULL) AND e.ts <= c.ts WHERE event_type = 'click' AND event_id % 3 > 0 GROUP BY ALL")
def edit_buckets(spark, d):
    """Edits within the repository by commit, session and file; every third edit lies outside of it."""
    e = table(spark, d, "events").where("event_type = 'click'").select("ts", F.col("user_id").alias("session"), F.concat(F.when(F.col("event_id") % 3 > 0, "/repo/p").otherwise("/repository/p"), (F.col("event_id") % 7).cast("string")).alias("path"))
    return attribution.bucket_edits(e, _commits(spark, d), "/repo")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts > (SELECT max(ts) FROM events WHERE event_type = 'signup')")
def uncovered_edits(spark, d):
    from loglattice.operators import ingest

    return ingest.uncovered(table(spark, d, "events").where("event_type = 'click'").select("event_id", "ts"), _commits(spark, d)).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 10 <> 0 OR event_type <> 'click'")
def not_recorded(spark, d):
    """Rows of a sweep without those recorded already, under a full or a shortened sha, by the same agent."""
    e = table(spark, d, "events").select("event_id", F.sha1(F.col("event_id").cast("string")).alias("sha"), F.col("event_type").alias("agent"))
    have = e.where("event_id % 10 = 0").select(F.expr("case when event_id % 20 = 0 then substr(sha, 1, 12) else sha end").alias("sha"), F.lit("click").alias("agent"))
    return attribution.not_recorded(e, have, ["agent"]).select("event_id")


@query("SELECT user_id AS session, max(event_id) FILTER (event_type = 'signup') AS newest, count(*) FILTER (event_type = 'signup') AS tasks, count(*) FILTER (event_type = 'signup' AND event_id % 2 = 1) AS open FROM events GROUP BY user_id")
def open_tasks(spark, d):
    """Tasks of a session that nothing has closed, and its newest one: signups open tasks, even ones are closed."""
    e = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("session"), "event_type")
    tasks = e.where("event_type = 'signup'")
    still = tasks.join(tasks.where("event_id % 2 = 0").select("event_id"), "event_id", "left_anti").groupBy("session").agg(F.count_distinct("event_id").alias("open"))
    newest = tasks.groupBy("session").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"), F.count(F.lit(1)).alias("tasks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.select("session").distinct().join(newest, "session", "left").join(still, "session", "left").select("session", "newest", zero("tasks"), zero("open"))


@query("SELECT agent, session, any_value(session % 7) AS project, count(*) AS rows_, max(ts) AS newest FROM calls WHERE agent <> 'signup' GROUP BY agent, session")
def manifest_rows(spark, d):
    """One row for each (agent, session) of a sweep, with the first project that any of its rows names."""
    c = calls(spark, d).where("agent <> 'signup'").withColumn("project", F.when(F.col("id") >= 0, (F.col("session") % 7)))
    return c.groupBy("agent", "session").agg(F.first("project", ignorenulls=True).alias("project"), F.count(F.lit(1)).alias("rows_"), F.max("ts").alias("newest"))


@query("""SELECT v.source, count(c.id) AS rows_, coalesce(bool_or(c.tokens_in > 0), false) AS any_tokens, count(DISTINCT c.session) AS sessions FROM (VALUES ('click'), ('view'), ('purchase'), ('otel')) v(source) LEFT JOIN calls c ON c.agent = v.source GROUP BY v.source""")
def coverage_by_source(spark, d):
    """What each known source has captured, those without a row at zero; rows as they are and after their fold."""
    known = spark.createDataFrame([("click",), ("view",), ("purchase",), ("otel",)], "source string")
    by = calls(spark, d).groupBy(F.col("agent").alias("source")).agg(F.count(F.lit(1)).alias("rows_"), F.bool_or(F.col("tokens_in") > 0).alias("any_tokens"), F.count_distinct("session").alias("sessions"))
    return known.join(by, "source", "left").select("source", F.coalesce("rows_", F.lit(0)).alias("rows_"), F.coalesce("any_tokens", F.lit(False)).alias("any_tokens"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query("SELECT agent, count(*) AS prior, count(*) FILTER (id % 9 = 0) AS added FROM calls GROUP BY agent")
def captured_counts(spark, d):
    """Rows of each agent, and those of the latest sweep: every ninth."""
    from loglattice.operators import ingest

    c = calls(spark, d)
    return ingest.captured_counts(c, c.where("id % 9 = 0"))


@query("SELECT event_type AS agent, user_id % 2 AS event, max(ts) AS seen FROM events GROUP BY ALL")
def last_seen(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("agent"), (F.col("user_id") % 2).alias("event")).agg(F.max("ts").alias("seen"))


@query("SELECT user_id AS path, count(*) AS parsed, count(DISTINCT event_type) AS agents FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def claimed_by_several(spark, d):
    """Places that several agents claim."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("parsed"), F.count_distinct("event_type").alias("agents")).where("agents > 1")


@query("SELECT doc_id, source AS title, CASE WHEN starts_with(source, 'w') THEN 'w' ELSE '' END AS tree, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS short FROM documents")
def path_predicates(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source")
    path = F.concat(F.lit("/"), F.substring("source", 1, 1), F.lit("/"), F.col("source"))
    return x.select("doc_id", S.basename(path).alias("title"), F.when(S.under(path, F.lit("/w")), "w").otherwise("").alias("tree"), F.substring(F.lpad(F.col("doc_id").cast("string"), 8, "0"), 1, 8).alias("short"))


@query("SELECT event_id, substr(sha1(event_type || chr(0) || CAST(user_id AS VARCHAR)), 1, 16) AS args_hash, substr(sha1(trim(props)), 1, 16) AS answer_hash, substr(sha256(props), 1, 16) AS prompt_key FROM events")
def signatures(spark, d):
    """Signatures of tool runs and prompts; what the program is called plays no part."""
    argv = F.array(F.lit("/bin/tool"), F.col("event_type"), F.col("user_id").cast("string"))
    sig = S.content_signature(argv, F.concat(F.lit(" "), F.col("props"), F.lit(" ")))
    return table(spark, d, "events").withColumn("s", sig).select("event_id", "s.args_hash", "s.answer_hash", S.key_of(F.col("props")).alias("prompt_key"))


@query("""SELECT l_orderkey, l_linenumber, rtrim(rtrim(format('{:.6f}', CAST(l_extendedprice AS DOUBLE)), '0'), '.') AS price, CASE WHEN l_linenumber > 3 THEN 'true' ELSE 'false' END AS late, concat_ws(';', l_returnflag, l_linestatus) AS flags, format('{:,}', CAST(round_even(CAST(l_extendedprice AS DOUBLE), 0) AS BIGINT)) AS price_text FROM lineitem""")
def csv_cells(spark, d):
    """Values as a CSV file holds them."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.cell(F.col("l_extendedprice"), "double").alias("price"), S.cell(F.col("l_linenumber") > 3, "boolean").alias("late"), S.cell(F.array("l_returnflag", "l_linestatus"), "array<string>").alias("flags"), S.thousands(F.col("l_extendedprice").cast("double")).alias("price_text"))


@query("SELECT agent, surface, n, tokens_in FROM (SELECT agent, session % 3 AS surface, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM calls WHERE agent IN ('view', 'click', 'purchase') GROUP BY ALL)")
def rollup_order(spark, d):
    """The rollup of a sweep, agents in the order of their list."""
    order = F.array_position(F.array(F.lit("view"), F.lit("click"), F.lit("purchase")), F.col("agent"))
    by = calls(spark, d).where("agent in ('view', 'click', 'purchase')").groupBy("agent", (F.col("session") % 3).alias("surface")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"))
    return by.orderBy(order, "surface")


@query(f"SELECT doc_id, score FROM (SELECT doc_id, {views.SCORE_SQL}) ORDER BY score DESC, doc_id LIMIT 10")
def explain_ranking(spark, d):
    """The ten best answers: a limit of the view."""
    return views.topics(spark, d).orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT session, saved, method FROM (SELECT l_orderkey AS session, CAST(round(sum(l_extendedprice * l_discount)) AS BIGINT) AS saved, min(l_returnflag) AS method FROM lineitem GROUP BY 1) ORDER BY saved DESC, session LIMIT 20")
def savings_topk(spark, d):
    """The twenty sessions that saved the most (the view's own limit), each with its least trusted method."""
    by = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(S.whole_total(F.col("l_extendedprice"), F.col("l_discount")).alias("saved"), F.min("l_returnflag").alias("method"))
    return by.orderBy(F.desc("saved"), "session").limit(20)


@query("SELECT min(method) AS method, CAST(sum(saved) AS BIGINT) AS saved, count(*) AS shown FROM (SELECT l_orderkey AS session, CAST(round(sum(l_extendedprice * l_discount)) AS BIGINT) AS saved, min(l_returnflag) AS method FROM lineitem GROUP BY 1 ORDER BY saved DESC, session LIMIT 20)")
def savings_worst_case(spark, d):
    return savings_topk(spark, d).agg(F.min("method").alias("method"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("shown"))


@query("SELECT l_orderkey AS session, count(*) FILTER (l_linenumber % 2 = 1 AND l_linenumber % 3 > 0) AS filed, count(*) FILTER (l_linenumber % 2 = 1 AND l_linenumber % 3 = 0) AS deferred, count(*) FILTER (l_linenumber % 2 = 0) AS skipped FROM lineitem GROUP BY 1")
def deferred_receipts(spark, d):
    """Receipts that a route finds: skipped where their own id is there, deferred where another route has filed them without a session."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), "l_linenumber", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("id"), F.concat_ws("|", F.lit(""), "l_orderkey", "l_linenumber").alias("twin"))
    own = r.where("l_linenumber % 2 = 0").select("id", F.lit(True).alias("own")).distinct()
    other = r.where("l_linenumber % 3 = 0").select("twin", F.lit(True).alias("other")).distinct()
    x = r.join(own, "id", "left").join(other, "twin", "left")
    return x.groupBy("session").agg(F.count_if(F.col("own").isNull() & F.col("other").isNull()).alias("filed"), F.count_if(F.col("own").isNull() & F.col("other").isNotNull()).alias("deferred"), F.count_if(F.col("own").isNotNull()).alias("skipped"))


@query("SELECT sha, count(*) AS rows_, count(DISTINCT flag) AS methods FROM (SELECT l_orderkey AS sha, l_linenumber, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL) GROUP BY 1")
def notes_plan(spark, d):
    """What a note of each commit would hold: rows merged by id, the more trusted one staying. Two shuffles, whose tasks grow in number with the table."""
    lines = table(spark, d, "lineitem")
    n = fold.tasks_for(2 * lines.count())  # from the files' footers
    rows = lines.select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("id"), "l_returnflag").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(fold.SALTS)))
    merged = fold.latest_per_key(rows.unionByName(rows).repartition(n, "sha", "salt"), ["sha", "salt", "id"], ["l_returnflag"])
    parts = merged.groupBy("sha", "salt", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).repartition(n, "sha")
    return parts.groupBy("sha").agg(F.sum("n").alias("rows_"), F.count_distinct("l_returnflag").alias("methods"))


@query("SELECT agent, count(*) AS rows_, max(ts) AS newest FROM (SELECT agent, ts FROM calls UNION ALL SELECT agent, ts FROM calls WHERE id % 7 = 0) GROUP BY agent")
def usage_union(spark, d):
    """Who was captured, by any kind of row: counts of rows, never a sum of use."""
    c = calls(spark, d)
    rows = store.union_usage({"calls": c.select("agent", "ts", "tokens_in"), "consumer": c.where("id % 7 = 0").select("agent", "ts", F.col("id").alias("call"))})
    return rows.groupBy("agent").agg(F.count(F.lit(1)).alias("rows_"), F.max("ts").alias("newest"))


@query("SELECT stack, label, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS calls FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS stack, o_orderpriority AS label, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_orderkey, o_orderpriority) GROUP BY stack, label")
def task_groups(spark, d):
    """Closed tasks grouped by what is asked for, here their stack of tools and their label."""
    closed = store.where_equal(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority="")
    x = table(spark, d, "lineitem").join(closed, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", F.col("o_orderpriority").alias("label")).agg(F.concat_ws("+", F.array_sort(F.collect_set("l_returnflag"))).alias("stack"), F.count(F.lit(1)).alias("n"))
    return x.groupBy("stack", "label").agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("calls"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text || chr(10) || role ELSE text END AS answer FROM conversations WHERE text IS NOT NULL")
def tool_texts(spark, d):
    """The text of tool results, whether one JSON string or a list of blocks."""
    c = table(spark, d, "conversations").where("text is not null")
    one, two = F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))
    made = F.when(F.col("turn") % 3 == 2, F.to_json(F.array(one, two))).when(F.col("turn") % 3 == 1, F.to_json(F.array(one)))
    return c.select("conv_id", "turn", F.when(made.isNotNull(), S.result_text(made)).otherwise(F.col("text")).alias("answer"))


@query("SELECT doc_id, CAST(round_even(length(text) / 4, 0) AS BIGINT) AS raw, CAST(round_even(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 4, 0) AS BIGINT) AS actual, CAST(round_even(length(text) / 4, 0) AS BIGINT) - CAST(round_even(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 4, 0) AS BIGINT) AS saved FROM documents")
def compression_receipts(spark, d):
    x = table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("raw"), S.token_estimate(S.normalize_line(F.col("text"))).alias("actual"))
    return x.withColumn("saved", F.col("raw") - F.col("actual"))


@query("SELECT event_type AS agent, count(*) FILTER (ts > TIMESTAMP '2024-01-20 00:00:00') AS newer, max(ts) < TIMESTAMP '2024-01-20 00:00:00' AS stale FROM events GROUP BY event_type")
def artifact_staleness(spark, d):
    """Whether what was built is older than the newest commit that it should know of."""
    built = F.lit("2024-01-20").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("agent")).agg(F.count_if(F.col("ts") > built).alias("newer"), (F.max("ts") < built).alias("stale"))
