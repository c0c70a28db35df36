"""More registered views: tasks, commits' lines, provenance, retention, sliding and session windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.functions import udfs
from loglattice.operators import attribution, ceilings, joins, toolruns
from loglattice.plans.registry import query
from loglattice.sources.ledger import calls, table
from loglattice.sources.transcripts import largest_mover
from loglattice.streaming import windows


@query("SELECT id, agent, tokens_in FROM calls WHERE id NOT IN (SELECT id FROM calls WHERE id % 7 = 0)")
def twin_suppression(spark, d):
    """Every seventh call has a twin that tells the same use: the stand-in for consumer rows."""
    c = calls(spark, d)
    return c.join(c.where("id % 7 = 0").select("id").distinct(), "id", "left_anti").select("id", "agent", "tokens_in")


@query("""SELECT id, task, CASE WHEN said IS NOT NULL THEN 'named' WHEN task IS NOT NULL THEN 'session' END AS via FROM (SELECT n.id, n.said, coalesce(n.said, min(s.task)) AS task
 FROM (SELECT id, session, ts, CASE WHEN id % 35 = 0 THEN session % 4 WHEN id % 5 = 0 THEN session * 10 + id % 3 END AS said FROM calls) n
 LEFT JOIN (SELECT i.task, i.session, lo, hi FROM (SELECT DISTINCT CASE WHEN id % 35 = 0 THEN session % 4 ELSE session * 10 + id % 3 END AS task, session FROM calls WHERE id % 5 = 0) i
  JOIN (SELECT CASE WHEN id % 35 = 0 THEN session % 4 ELSE session * 10 + id % 3 END AS task, min(ts) AS lo, max(ts) AS hi FROM calls WHERE id % 5 = 0 GROUP BY 1) p USING (task)) s
 ON n.said IS NULL AND n.session = s.session AND n.ts BETWEEN s.lo AND s.hi GROUP BY n.id, n.said)""")  # fmt: skip
def task_session_join(spark, d):
    """Every fifth call names a task, of its session or of several sessions; there is no table of tasks. The other calls belong to the smallest task
    of their session whose span, from the first to the last call that names it, holds them."""
    said = F.when(F.col("id") % 35 == 0, F.col("session") % 4).when(F.col("id") % 5 == 0, F.col("session") * 10 + F.col("id") % 3)
    return joins.task_join(calls(spark, d).select("id", "session", "ts", said.alias("task"))).select("id", "task", F.col("task_via").alias("via"))


AUTHORED_SQL = """lines AS (SELECT doc_id, lang AS sha, source AS path, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l FROM documents)),
 files AS (SELECT sha, path, count(*) AS added, count(*) FILTER (length(line) < 4) AS added_gated, count(*) FILTER (length(line) >= 4) AS keep FROM lines GROUP BY ALL),
 mine AS (SELECT lang AS sha, source AS path, doc_id % 3 AS session, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 4 = 0),
 claimed AS (SELECT m.sha, count(*) AS n FROM mine m JOIN lines l USING (doc_id) GROUP BY m.sha), proposed AS (SELECT DISTINCT sha, path FROM mine),
 f AS (SELECT f.*, p.path IS NOT NULL AS p FROM files f LEFT JOIN proposed p ON p.sha = f.sha AND p.path = f.path)"""


def _authored(spark, d):
    """(files, rows): a language stands for a commit, a source for a file of it; labelled documents are what agents' sessions wrote."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("sha"), F.col("source").alias("path"), F.explode(F.split("text", "\n")).alias("line"))
    lines = docs.withColumn("line", S.normalize_line(F.col("line")))
    files = lines.groupBy("sha", "path").agg(F.count(F.lit(1)).alias("added"), F.count_if(~S.matchable(F.col("line"))).alias("added_gated"))
    good = table(spark, d, "labels").where("quality = 1 and doc_id % 4 = 0").select("doc_id")
    rows = docs.join(good, "doc_id").groupBy("sha", (F.col("doc_id") % 3).alias("session")).agg(F.collect_set("path").alias("files"), F.count(F.lit(1)).alias("agent_lines"))
    return files, rows


@query(f""", {AUTHORED_SQL} SELECT sha, added, agent, greatest(mine - agent, 0) AS human, unattributed, unknown FROM (SELECT sha, CAST(sum(added) AS BIGINT) AS added, CAST(sum(added_gated) AS BIGINT) AS unknown,
 CAST(sum(CASE WHEN p THEN keep ELSE 0 END) AS BIGINT) AS mine, CAST(sum(CASE WHEN p THEN 0 ELSE keep END) AS BIGINT) AS unattributed, greatest(least(coalesce(any_value(n), 0), CAST(sum(CASE WHEN p THEN keep ELSE 0 END) AS BIGINT)), 0) AS agent
 FROM f LEFT JOIN claimed USING (sha) GROUP BY sha)""")  # fmt: skip
def commit_buckets(spark, d):
    """Each commit's lines: the agents', as recorded and at most what proposed files have, people's, those of files nobody proposed, and those too short to tell."""
    return attribution.commit_buckets(*_authored(spark, d))


@query(f""", {AUTHORED_SQL}, t AS (SELECT f.*, coalesce(CASE WHEN p AND pool > 0 THEN least(CAST(round_even(CAST(n AS DOUBLE) * keep / pool, 0) AS BIGINT), keep) END, 0) AS agent
 FROM f LEFT JOIN claimed USING (sha) LEFT JOIN (SELECT sha, sum(keep) AS pool FROM f WHERE p GROUP BY sha) w USING (sha))
 SELECT sha, path, added, agent, CASE WHEN p THEN greatest(keep - agent, 0) ELSE 0 END AS human, CASE WHEN p THEN 0 ELSE keep END AS unattributed, added_gated AS unknown FROM t""")  # fmt: skip
def file_split_rounding(spark, d):
    """The agents' lines of each commit dealt to the files that were proposed, by their matchable lines."""
    return attribution.file_split(*_authored(spark, d))


@query("""SELECT 'source' AS kind, source AS key, count(*) AS n FROM documents GROUP BY source
 UNION ALL SELECT 'quality', coalesce(CAST(quality AS VARCHAR), 'unknown'), count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")  # fmt: skip
def authorship_summary(spark, d):
    """Counts of several dimensions in one pass."""
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    pairs = F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")), F.struct(F.lit("quality").alias("kind"), F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("key")))
    return x.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"))


#: What is asked for.
ASKED = ["data", "table", "cost", "the", "entre", "src1"]
SCORE_SQL = """CAST(list_sum(list_transform(['data', 'table', 'cost', 'the', 'entre', 'src1'], lambda q: CASE WHEN list_contains(i, q) THEN 3 WHEN list_contains(t, q) THEN 2 WHEN length(q) < 4 THEN 0
 WHEN len(list_filter(i, lambda k: length(k) >= 4 AND (starts_with(k, q) OR starts_with(q, k)))) > 0 THEN 2 WHEN len(list_filter(t, lambda k: length(k) >= 4 AND (starts_with(k, q) OR starts_with(q, k)))) > 0 THEN 1 ELSE 0 END)) AS INT) AS score
 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t, list_append(regexp_extract_all(lower(source), '[a-z0-9]+'), source) AS i FROM documents)"""


def topics(spark, d):
    """(doc_id, score): the source names a document, its words are its keywords."""
    own = F.array_append(S.words(F.col("source")), F.col("source"))
    return table(spark, d, "documents").select("doc_id", S.topic_score(ASKED, own, S.words(F.col("text"))).alias("score"))


@query(f"SELECT doc_id, {SCORE_SQL}")
def topic_score(spark, d):
    return topics(spark, d)


@query("""SELECT DISTINCT a.l_orderkey, a.l_returnflag FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = b.l_linestatus AND a.l_returnflag <> b.l_returnflag""")
def corroboration(spark, d):
    """Rows that another method confirms for the same key and file: keys with two methods, without joining rows with rows."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag").groupBy("l_orderkey", "l_linestatus").agg(F.collect_set("l_returnflag").alias("methods"))
    return x.where(F.size("methods") > 1).select("l_orderkey", F.explode("methods").alias("l_returnflag")).distinct()


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01 00:00:00' GROUP BY month")
def month_pruning(spark, d):
    recent = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1996-03-01").cast("timestamp_ntz"))
    return recent.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tokens_in, CASE WHEN count(DISTINCT agent) = 1 THEN min(agent) ELSE 'unknown' END AS owner FROM calls GROUP BY tokens_in")
def ambiguous_owner(spark, d):
    """The agent of a hash, unknown where several have it."""
    return calls(spark, d).groupBy("tokens_in").agg(F.when(F.min("agent") == F.max("agent"), F.min("agent")).otherwise("unknown").alias("owner"))


@query("""SELECT l_orderkey, l_linenumber, first_value(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC) AS carrier FROM lineitem""")
def billing_carrier(spark, d):
    """What is billed once is carried by the largest mover; the others name it."""
    return largest_mover(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity", "l_linenumber", "carrier").drop("l_quantity")


@query("""SELECT lang, communities IS NOT NULL AS bounded, files, corpus_tokens, coalesce(communities, 0) AS communities, CASE WHEN communities > 0 THEN ceiling_files ELSE files END AS ceiling_files, CASE WHEN communities > 0 THEN ceiling_tokens ELSE corpus_tokens END AS ceiling_tokens,
 CASE WHEN communities > 0 THEN typical_tokens ELSE corpus_tokens END AS typical_tokens FROM (SELECT lang, count(*) AS files, CAST(sum(t) AS BIGINT) AS corpus_tokens FROM x GROUP BY lang)
 LEFT JOIN (SELECT lang, count(*) AS communities, CAST(floor(median(tokens)) AS BIGINT) AS typical_tokens, max(tokens) AS ceiling_tokens, arg_max(n, (tokens, n)) AS ceiling_files FROM (SELECT lang, c, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens FROM x WHERE c IS NOT NULL GROUP BY lang, c) GROUP BY lang) USING (lang)""".join(
    (", x AS (SELECT lang, CASE WHEN lang <> 'fr' AND source <> 'src3' THEN source END AS c, t FROM (SELECT lang, source, CAST(round_even(length(text) / 4, 0) AS BIGINT) AS t FROM documents) WHERE t > 0) SELECT * FROM (", ")")))
def repo_ceiling(spark, d):
    """What one question could save at most: a language stands for a repository, a source for a community of its graph; one language has none."""
    community = F.when((F.col("lang") != "fr") & (F.col("source") != "src3"), F.col("source"))
    x = table(spark, d, "documents").select("lang", community.alias("community"), S.token_estimate(F.col("text")).alias("tokens"))
    return ceilings.repo_ceiling(x, ["lang"]).select("lang", "bounded", "files", "corpus_tokens", "communities", "ceiling_files", "ceiling_tokens", "typical_tokens")


@query("SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-05 00:00:00') AS stale, CAST(sum(strlen(props)) FILTER (ts < TIMESTAMP '2024-01-05 00:00:00') AS BIGINT) AS stale_bytes FROM events GROUP BY event_type")
def retention_scan(spark, d):
    """Rows and bytes older than the cutoff; rows without a time stay."""
    old = F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(old).alias("stale"), F.sum(F.when(old, F.octet_length("props"))).alias("stale_bytes"))


@query("""SELECT id, method, side FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY trust DESC, side) AS r FROM (
 SELECT id, agent AS method, length(agent) AS trust, 'existing' AS side FROM calls WHERE id % 3 < 2 UNION ALL SELECT id, 'purchase', length('purchase'), 'incoming' FROM calls WHERE id % 3 > 0)) WHERE r = 1""")  # fmt: skip
def union_by_trust(spark, d):
    """Union by id: the more trusted method wins, the existing row at a tie."""
    c = calls(spark, d)
    have = c.where("id % 3 < 2").select("id", F.col("agent").alias("method"), F.length("agent").alias("trust"), F.lit("existing").alias("side"))
    new = c.where("id % 3 > 0").select("id", F.lit("purchase").alias("method"), F.lit(8).alias("trust"), F.lit("incoming").alias("side"))
    best = have.unionByName(new).groupBy("id").agg(F.min_by(F.struct("method", "side"), F.struct(-F.col("trust"), "side")).alias("b"))
    return best.select("id", "b.method", "b.side")


@query("""SELECT 'negative' AS finding, count(*) FILTER (value < 0) AS n FROM events UNION ALL SELECT 'no-user', count(*) FILTER (user_id IS NULL) FROM events
 UNION ALL SELECT 'rare-type', count(*) FROM (SELECT event_type FROM events GROUP BY event_type HAVING count(*) < 5)""")  # fmt: skip
def consistency_warnings(spark, d):
    """All findings from one aggregation, those without a case kept at zero."""
    by = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 0).alias("neg"), F.count_if(F.col("user_id").isNull()).alias("nouser"))
    one = by.agg(F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"), F.coalesce(F.sum("nouser"), F.lit(0)).alias("nouser"), F.count_if(F.col("n") < 5).alias("rare"))
    return one.select(F.expr("stack(3, 'negative', neg, 'no-user', nouser, 'rare-type', rare) as (finding, n)"))


#: Fewer rows than this say nothing of a middle (fixed value).
CORRELATES = 5


@query("SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') >= 5 THEN median(length(text)) FILTER (role = 'user') END AS middle, max(length(text)) AS longest FROM conversations GROUP BY conv_id")
def gated_middle(spark, d):
    """A middle value only where there are enough rows to speak of one."""
    user = F.when(F.col("role") == "user", F.length("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.when(F.count(user) >= CORRELATES, F.percentile(user, 0.5)).alias("middle"), F.max(F.length("text").cast("long")).alias("longest"))


@query("SELECT event_type AS agent, CASE WHEN event_type IN ('click', 'view') THEN 'exact' WHEN event_type = 'purchase' THEN 'session' ELSE 'unknown' END AS fidelity, count(*) AS n FROM events GROUP BY event_type")
def time_fidelity(spark, d):
    """How far an agent's times can be trusted, from a small table of agents."""
    known = spark.createDataFrame([("click", "exact"), ("view", "exact"), ("purchase", "session")], "agent string, fidelity string")
    n = calls(spark, d).groupBy("agent").agg(F.count(F.lit(1)).alias("n"))
    return n.join(known, "agent", "left").select("agent", F.coalesce("fidelity", F.lit("unknown")).alias("fidelity"), "n")


@query("SELECT session, count(DISTINCT agent) > 1 AS split, count(*) AS n FROM calls GROUP BY session")
def split_sessions(spark, d):
    return calls(spark, d).groupBy("session").agg((F.min("agent") != F.max("agent")).alias("split"), F.count(F.lit(1)).alias("n"))


@query("""SELECT time_bucket(INTERVAL 15 minutes, ts) - k * INTERVAL 15 minutes AS bucket, agent, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM calls, (VALUES (0), (1), (2), (3)) v(k) GROUP BY ALL""")
def stream_sliding(spark, d):
    return windows.sliding(calls(spark, d), "1 hour", "15 minutes")


@query("""SELECT session, min(ts) AS bucket, max(ts) + INTERVAL 30 minutes AS until, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts < before + INTERVAL 30 minutes THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ts, id) AS g
 FROM (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts, id) AS before FROM calls)) GROUP BY session, g""")  # fmt: skip
def stream_session(spark, d):
    return windows.sessions(calls(spark, d), "30 minutes")


@query("SELECT DISTINCT session, agent, tokens_in FROM calls")
def stream_dedupe(spark, d):
    return windows.deduped(calls(spark, d).select("session", "agent", "tokens_in"), ["session", "agent", "tokens_in"])


@query()
def shell_ops_udtf(spark, d):
    """The tools that each turn's lines would run: tokenising as a shell does is beyond SQL."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return lines.withColumn("tool", F.explode(udfs.commands(F.col("text"))))


COMMANDS = ["graph query x{0}", "A=1 /opt/bin/graph explain 'y {0}'", "cd d && graph path a b{0} | tee o", "grep graph query {0}", "echo graph; cat f | grep graph", "graph build {0}; 'graph' --v explain {0}", "graph query 'open {0}"]
RUNS_SQL = """runs AS (SELECT event_id AS id, user_id AS session, ts, event_id % 7 AS k, CAST(event_id % 40 AS VARCHAR) AS n FROM events WHERE event_type IN ('view', 'error')),
 ops AS (SELECT *, CASE k WHEN 0 THEN 'query' WHEN 1 THEN 'explain' WHEN 2 THEN 'path' WHEN 5 THEN 'explain' END AS op,
 CASE k WHEN 0 THEN ['graph', 'query', 'x' || n] WHEN 1 THEN ['/opt/bin/graph', 'explain', 'y ' || n] WHEN 2 THEN ['graph', 'path', 'a', 'b' || n] WHEN 5 THEN ['graph', '--v', 'explain', n] END AS argv FROM runs WHERE k IN (0, 1, 2, 5))"""


def _tool_ops(spark, d):
    """Commands that run a tool or only speak of it."""
    n = (F.col("event_id") % 40).cast("string")
    command = F.replace(F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % 7 + 1).cast("int")), F.lit("{0}"), n)
    e = table(spark, d, "events").where("event_type in ('view', 'error')").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), "ts", command.alias("command"))
    return toolruns.tool_ops(e, "graph")


@query(f", {RUNS_SQL} SELECT id, op, array_to_string(argv, ' ') AS argv FROM ops")
def tool_ops(spark, d):
    """The runs of a tool at command position, with their arguments; what only names it gives none."""
    return _tool_ops(spark, d).select("id", "op", F.array_join("argv", " ").alias("argv"))


RECEIPTS_SQL = f"""{RUNS_SQL}, said AS (SELECT id, CAST(session AS VARCHAR) AS session, op, argv, ts, CASE op WHEN 'query' THEN 'NODE a [src=src' || id % 20 || ' loc=L1]' || chr(10) || 'NODE b [src=src' || id % 7 || ' loc=L2]' || chr(10) || 'NODE c [src=gone loc=L3]'
  ELSE 'Source:   src' || id % 20 || ' L7' || chr(10) || repeat('word ', CAST(id % 30 * 40 AS INT)) END AS answer FROM ops),
 signed AS (SELECT *, substr(sha1(array_to_string(argv[2:], chr(0))), 1, 16) AS ah, substr(sha1(trim(answer, chr(10) || ' ')), 1, 16) AS nh FROM said),
 keyed AS (SELECT *, 's_' || substr(sha1(concat_ws('|', session, op, ah, nh)), 1, 15) AS rid, 's_' || substr(sha1(concat_ws('|', '', op, ah, nh)), 1, 15) AS twin FROM signed),
 have AS (SELECT rid AS id FROM keyed WHERE id % 11 = 0 UNION SELECT twin FROM keyed WHERE id % 13 = 0),
 once AS (SELECT rid, min(ts) AS ts, arg_min(session, ts) AS session, arg_min(op, ts) AS op, arg_min(answer, ts) AS answer, arg_min(twin, ts) AS twin, arg_min(id, ts) AS id FROM keyed GROUP BY rid),
 open_ AS (SELECT * FROM once WHERE rid NOT IN (SELECT id FROM have) AND twin NOT IN (SELECT id FROM have)),
 cites AS (SELECT rid, ts, 'src' || id % 20 AS path FROM open_ WHERE op IN ('query', 'explain') UNION SELECT rid, ts, 'src' || id % 7 FROM open_ WHERE op = 'query'),
 corpus AS (SELECT source AS path, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 25) AS revision, max(CAST(round_even(length(text) / 4, 0) AS BIGINT)) AS tokens FROM documents GROUP BY ALL),
 sized AS (SELECT c.rid, c.path, coalesce(arg_max(tokens, revision) FILTER (revision <= c.ts), arg_min(tokens, revision)) AS tokens FROM cites c JOIN corpus f USING (path) GROUP BY c.rid, c.path, c.ts)"""


@query(f""", {RECEIPTS_SQL} SELECT rid AS id, o.session, op, CAST(raw AS BIGINT) AS raw_alternative, actual, CAST(raw - actual AS BIGINT) AS saved, CASE op WHEN 'query' THEN 3 ELSE 1 END AS source_files
 FROM (SELECT *, CAST(round_even(length(answer) / 4, 0) AS BIGINT) AS actual FROM open_) o JOIN (SELECT rid, sum(tokens) AS raw FROM sized GROUP BY rid) USING (rid) WHERE raw > 0 AND actual < raw""")  # fmt: skip
def run_receipts(spark, d):
    """Receipts of a tool's runs: a source is a file that grows day by day, answers cite one or two of them and one that is gone; some runs are filed already, some by another route."""
    x, n = _tool_ops(spark, d), F.col("id").cast("long")
    src = lambda k: F.concat(F.lit("src"), (n % k).cast("string"))
    told = F.concat(F.lit("NODE a [src="), src(20), F.lit(" loc=L1]\nNODE b [src="), src(7), F.lit(" loc=L2]\nNODE c [src=gone loc=L3]"))
    shown = F.concat(F.lit("Source:   "), src(20), F.lit(" L7\n"), F.repeat(F.lit("word "), (n % 30 * 40).cast("int")))
    runs = x.select("id", F.col("session").cast("string").alias("session"), "op", "argv", "ts", F.lit("").alias("cwd"), F.when(F.col("op") == "query", told).otherwise(shown).alias("answer"))
    g = S.content_signature(F.col("argv"), F.col("answer"))
    keyed = runs.withColumn("g", g)
    key = lambda s: S.short_id("s_", s, F.col("op"), F.col("g.args_hash"), F.col("g.answer_hash")).alias("id")
    have = keyed.where("id % 11 = 0").select(key(F.col("session"))).unionByName(keyed.where("id % 13 = 0").select(key(F.lit(""))))
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 25 as int))")
    corpus = table(spark, d, "documents").groupBy(F.col("source").alias("path"), day.alias("revision")).agg(F.max(S.token_estimate(F.col("text"))).alias("tokens"))
    filed, _ = toolruns.receipts(runs.drop("id"), corpus, have)
    return filed.select("id", "session", "op", "raw_alternative", "actual", "saved", "source_files")


@query()
def json_shrink_udf(spark, d):
    """Properties with long lists and texts cut."""
    return table(spark, d, "events").select("event_id", udfs.shrink_json(F.col("props")).alias("props"))
