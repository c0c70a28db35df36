"""Name to query, and name to DuckDB SQL, of the log analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators import fold, joins
from loglattice.sources.ledger import CALLS_SQL, calls, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH calls AS ({CALLS_SQL}) {sql}"
        return f

    return add


def _chats(spark, d):
    """Per conversation and agent. Sums keep absence: credits are NULL where none was recorded."""
    return calls(spark, d).groupBy("session", "agent").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("credits"), 2).alias("credits"), F.count(F.lit(1)).alias("n_calls")
    )


CHATS_SQL = "SELECT session, agent, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(credits), 2) AS credits, count(*) AS n_calls FROM calls GROUP BY session, agent"


@query(CHATS_SQL)
def chats_summary(spark, d):
    return _chats(spark, d).orderBy(F.desc("tokens_in"), F.desc(F.coalesce("credits", F.lit(0))), "session")


@query(f"SELECT session, agent, tokens_in FROM ({CHATS_SQL}) ORDER BY tokens_in DESC, session, agent LIMIT 20")
def chats_topk(spark, d):
    """The twenty largest: the limit is the view's own."""
    return _chats(spark, d).orderBy(F.desc("tokens_in"), "session", "agent").limit(20).select("session", "agent", "tokens_in")


@query("SELECT session, agent, id, ts, tokens_in, tokens_out FROM (SELECT *, row_number() OVER (PARTITION BY session, agent ORDER BY tokens_in + tokens_out DESC, id DESC) AS r FROM calls) WHERE r = 1")
def latest_per_key(spark, d):
    rows = calls(spark, d).select("session", "agent", "id", "ts", "tokens_in", "tokens_out").withColumn("size", F.col("tokens_in") + F.col("tokens_out"))
    return fold.latest_per_key(rows, ["session", "agent"], ["size", "id"]).drop("size")


@query("SELECT session, CAST(max_by(tokens_in, id) FILTER (tokens_in > 500) AS BIGINT) AS tokens_in, max_by(credits, id) FILTER (credits IS NOT NULL) AS credits, max_by(agent, id) AS agent FROM calls GROUP BY session")
def task_field_merge(spark, d):
    rows = calls(spark, d).select("session", "id", F.when(F.col("tokens_in") > 500, F.col("tokens_in")).alias("tokens_in"), "credits", "agent")
    return fold.field_merge(rows, "session", "id")


@query("""SELECT conv_id, turn, used, CASE WHEN used < before THEN used ELSE used - before END AS delta FROM (
 SELECT *, coalesce(lag(used) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS before FROM (
 SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id, CAST(floor(turn / 3) AS BIGINT) ORDER BY turn) AS BIGINT) AS used FROM conversations))""")  # fmt: skip
def cumulative_delta_reset(spark, d):
    w = Window.partitionBy("conv_id", F.floor(F.col("turn") / 3)).orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text").cast("long")).over(w).alias("used"))
    return fold.delta_with_reset(rows, ["conv_id"], "turn", "used", "delta")


SPEND_SQL = """spend AS (SELECT id, session, agent, tokens_in, 'calls' AS basis FROM calls WHERE agent NOT IN ('click', 'view') AND id NOT IN (SELECT id FROM calls WHERE id % 7 = 0)
 UNION ALL SELECT id, session, agent, tokens_in, 'metrics' FROM calls WHERE agent IN ('click', 'view'))"""


def _spend(spark, d):
    """Stand-in: two agents tell their use by metric rows, and every seventh call has a twin."""
    c = calls(spark, d).select("id", "session", "agent", "tokens_in")
    twins = c.where("id % 7 = 0").select(F.col("id").cast("string").alias("call"))
    return joins.resolve_spend(c, c.where(F.col("agent").isin("click", "view")), twins), c


@query(f", {SPEND_SQL} SELECT agent, basis, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM spend GROUP BY agent, basis")
def spend_resolve(spark, d):
    return _spend(spark, d)[0].groupBy("agent", "basis").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"))


@query(f", {SPEND_SQL} SELECT id, session, agent, tokens_in, basis FROM spend UNION ALL SELECT id, session, agent, tokens_in, NULL FROM calls WHERE id NOT IN (SELECT id FROM spend)")
def join_table(spark, d):
    return joins.join_table(*_spend(spark, d)).select("id", "session", "agent", "tokens_in", "basis")


@query("SELECT id, max(side) AS side, count(*) AS n FROM (SELECT l_orderkey AS id, 'tree' AS side FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT o_orderkey, 'legacy' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)) GROUP BY id")
def receipts_union(spark, d):
    tree = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.lit("tree").alias("side"))
    legacy = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("legacy").alias("side"))
    return joins.union_first_wins(tree, legacy, "id").groupBy("id").agg(F.max("side").alias("side"), F.count(F.lit(1)).alias("n"))


@query("SELECT c.session, CASE WHEN count(DISTINCT agent) <= 1 THEN round(sum(credits), 2) END AS credits, count(DISTINCT agent) AS agents FROM calls c GROUP BY session")
def credits_guard(spark, d):
    """Credits of several agents have no sum."""
    return calls(spark, d).groupBy("session").agg(F.when(F.count_distinct("agent") <= 1, F.round(F.sum("credits"), 2)).alias("credits"), F.count_distinct("agent").alias("agents"))


#: Least to most trusted.
TRUST = ["A", "N", "R"]


@query("""SELECT o_orderkey AS session, o_orderpriority AS agent, coalesce(n, 0) AS receipts, saved, method FROM orders LEFT JOIN (
 SELECT l_orderkey, count(*) AS n, CAST(round(sum(l_extendedprice * l_discount)) AS BIGINT) AS saved, min(l_returnflag) AS method FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")  # fmt: skip
def graphify_chats(spark, d):
    """Savings by conversation, with the least trusted method among them."""
    rank = F.array_position(F.array(*map(F.lit, TRUST)), F.col("l_returnflag"))
    saved = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), S.whole_total(F.col("l_extendedprice"), F.col("l_discount")).alias("saved"), F.min_by("l_returnflag", rank).alias("method"))
    chats = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_orderpriority").alias("agent"))
    return chats.join(saved, F.col("session") == F.col("l_orderkey"), "left").select("session", "agent", F.coalesce("n", F.lit(0)).alias("receipts"), "saved", "method")


@query("SELECT count(*) FILTER (o_orderkey IS NULL) AS unmatched, count(*) FILTER (o_orderkey IS NOT NULL) AS matched FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON l_orderkey = o_orderkey")
def unmatched_tally(spark, d):
    known = table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").select("o_orderkey")
    return table(spark, d, "lineitem").join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left").agg(F.count_if(F.col("o_orderkey").isNull()).alias("unmatched"), F.count("o_orderkey").alias("matched"))


COMMITS_SQL = "commits AS (SELECT sha1(CAST(event_id AS VARCHAR)) AS sha, ts AS hi, lag(ts) OVER (ORDER BY ts, sha1(CAST(event_id AS VARCHAR))) AS lo FROM events WHERE event_type = 'signup')"


def _windows(spark, d):
    c = table(spark, d, "events").where("event_type = 'signup'").select(F.sha1(F.col("event_id").cast("string")).alias("sha"), "ts")
    return joins.windows_of(c)


@query(f", {COMMITS_SQL} SELECT sha, lo, hi FROM commits")
def commit_windows(spark, d):
    return _windows(spark, d).select("sha", "lo", "hi")


@query(f", {COMMITS_SQL} SELECT sha, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM calls LEFT JOIN commits ON (ts > lo OR lo IS NULL) AND ts <= hi GROUP BY sha")
def commit_interval_join(spark, d):
    got = joins.interval_join(calls(spark, d).select("ts", "tokens_in"), _windows(spark, d))
    return got.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"))


@query(f""", {COMMITS_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN tokens_in = 0 THEN 'empty' WHEN agent = 'signup' THEN 'no-project' WHEN sha IS NULL THEN 'after-last' ELSE 'joined' END AS reason
 FROM calls LEFT JOIN commits ON (ts > lo OR lo IS NULL) AND ts <= hi) GROUP BY reason""")  # fmt: skip
def commit_exclusions(spark, d):
    got = joins.interval_join(calls(spark, d).select("ts", "tokens_in", "agent"), _windows(spark, d))
    reason = F.when(F.col("tokens_in") == 0, "empty").when(F.col("agent") == "signup", "no-project").when(F.col("sha").isNull(), "after-last").otherwise("joined")
    return got.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT probe, CASE WHEN count(sha) = 1 THEN min(sha) END AS match, CASE WHEN probe = '' THEN 'empty' WHEN count(sha) = 1 THEN 'match' WHEN count(sha) > 1 THEN 'ambiguous' ELSE 'no-match' END AS verdict
 FROM (SELECT DISTINCT substr(sha1(CAST(event_id AS VARCHAR)), 1, CAST(event_id % 7 AS INT)) || CASE WHEN event_id % 11 = 0 AND event_id % 7 > 0 THEN 'x' ELSE '' END AS probe FROM events)
 LEFT JOIN (SELECT DISTINCT CASE WHEN event_id % 97 = 0 THEN substr(sha1(CAST(event_id AS VARCHAR)), 1, 3) ELSE sha1(CAST(event_id AS VARCHAR)) END AS sha FROM events) ON probe <> '' AND (starts_with(sha, probe) OR starts_with(probe, sha)) GROUP BY probe""")  # fmt: skip
def prefix_match(spark, d):
    """Every event's short id, none to six letters of it, some with a letter that no id has, against all ids, some of which are short themselves."""
    e = table(spark, d, "events").select("event_id", F.sha1(F.col("event_id").cast("string")).alias("whole"))
    e = e.withColumn("sha", F.expr("case when event_id % 97 = 0 then substr(whole, 1, 3) else whole end"))
    return joins.prefix_match(e.select(F.expr("substr(whole, 1, cast(event_id % 7 as int)) || case when event_id % 11 = 0 and event_id % 7 > 0 then 'x' else '' end").alias("probe")), e, "probe", "sha")


LINES_SQL = "lines AS (SELECT doc_id, lang, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS l FROM documents))"


def _lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("l"))
    return docs.select("doc_id", "lang", S.normalize_line(F.col("l")).alias("line"))


@query(f""", {LINES_SQL}, p AS (SELECT lang, line, count(*) AS n FROM lines WHERE doc_id % 2 = 0 AND length(line) >= 4 GROUP BY ALL), a AS (SELECT lang, line, count(*) AS n FROM lines WHERE doc_id % 2 = 1 AND length(line) >= 4 GROUP BY ALL)
 SELECT lang, CAST(sum(least(p.n, a.n)) AS BIGINT) AS kept FROM p JOIN a USING (lang, line) GROUP BY lang""")  # fmt: skip
def line_match_multiset(spark, d):
    """Even documents propose, odd ones add: the stand-in for proposed and committed lines."""
    x = _lines(spark, d).where(S.matchable(F.col("line")))
    return fold.multiset_match(x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1"), ["lang"], "line")


@query(f""", {LINES_SQL}, p AS (SELECT lang, line, count(*) AS n FROM lines WHERE doc_id % 2 = 0 GROUP BY ALL), c AS (SELECT lang, line, count(*) AS n FROM lines WHERE doc_id % 2 = 1 AND length(line) >= 4 GROUP BY ALL)
 SELECT lang, CAST(sum(greatest(p.n - coalesce(c.n, 0), 0)) AS BIGINT) AS lines_left FROM p LEFT JOIN c USING (lang, line) GROUP BY lang""")  # fmt: skip
def line_subtract_context(spark, d):
    x = _lines(spark, d)
    return fold.multiset_subtract(x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1"), ["lang"], "line", "n").groupBy("lang").agg(F.sum("n").alias("lines_left"))


@query("SELECT source, CAST(sum(CASE WHEN quality = 1 THEN n_chars END) AS BIGINT) AS agent_chars, count(*) FILTER (quality IS NULL) AS unlabelled, CASE WHEN count(quality) = 0 THEN 'no-evidence' WHEN count(*) FILTER (quality IS NULL) > count(quality) THEN 'coverage' ELSE 'ok' END AS verdict FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agent_share(spark, d):
    """Evidence with absence: a missing label is not a zero."""
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(
        F.sum(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("agent_chars"), F.count_if(F.col("quality").isNull()).alias("unlabelled"),
        F.when(F.count("quality") == 0, "no-evidence").when(F.count_if(F.col("quality").isNull()) > F.count("quality"), "coverage").otherwise("ok").alias("verdict"),
    )


@query("SELECT session, CASE WHEN sum(tokens_out) > 50000 THEN CAST(floor(sum(tokens_out) / 1000) AS BIGINT) WHEN count(ts) >= 1 THEN CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) END AS span_s FROM calls GROUP BY session")
def hours_cell(spark, d):
    whole = lambda c: F.unix_timestamp(F.date_trunc("second", c.cast("timestamp")))
    return calls(spark, d).groupBy("session").agg(F.when(F.sum("tokens_out") > 50000, F.floor(F.sum("tokens_out") / 1000)).when(F.count("ts") >= 1, whole(F.max("ts")) - whole(F.min("ts"))).cast("long").alias("span_s"))


@query("SELECT stack, count(*) AS tasks FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS stack FROM lineitem GROUP BY l_orderkey) GROUP BY stack")
def task_stack_groups(spark, d):
    tools = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("+", F.array_sort(F.collect_set("l_returnflag"))).alias("stack"))
    return tools.groupBy("stack").agg(F.count(F.lit(1)).alias("tasks"))


@query("SELECT l_returnflag, CASE WHEN count(*) >= 5 THEN CAST(quantile_cont(CAST(l_quantity AS DOUBLE), 0.25) AS DOUBLE) END AS q1, CASE WHEN count(*) >= 5 THEN CAST(quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) AS DOUBLE) END AS q2, CASE WHEN count(*) >= 5 THEN CAST(quantile_cont(CAST(l_quantity AS DOUBLE), 0.75) AS DOUBLE) END AS q3 FROM lineitem GROUP BY l_returnflag")
def saving_band(spark, d):
    q = [F.when(F.count(F.lit(1)) >= 5, F.percentile("l_quantity", p)).alias(f"q{k}") for k, p in enumerate((0.25, 0.5, 0.75), 1)]
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*q)


@query("SELECT source AS community, count(*) AS files, CAST(sum(round_even(length(text) / 4, 0)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def community_corpus(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("community"), S.token_estimate(F.col("text")).alias("t"))
    return files.groupBy("community").agg(F.count(F.lit(1)).alias("files"), F.sum("t").alias("tokens"))


@query("SELECT agent, session % 3 AS surface, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM calls WHERE agent <> 'signup' GROUP BY GROUPING SETS ((agent, session % 3), ())")
def import_rollup(spark, d):
    x = calls(spark, d).where("agent <> 'signup'").withColumn("surface", F.col("session") % 3)
    return x.rollup("agent", "surface").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"), F.grouping_id().alias("g")).where("g <> 1").drop("g")


@query("SELECT agent, count(*) AS n, max(ts) AS newest, sum(tokens_out) = 0 AS silent FROM calls GROUP BY agent")
def capture_timeline(spark, d):
    return calls(spark, d).groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"), (F.sum("tokens_out") == 0).alias("silent"))


@query("SELECT source, count(id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('never')) v(source) LEFT JOIN calls ON agent = source GROUP BY source")
def enum_coverage(spark, d):
    """Members of the enumeration that never occur keep their zero."""
    known = spark.createDataFrame([("click",), ("view",), ("purchase",), ("never",)], "source string")
    return known.join(calls(spark, d), F.col("agent") == F.col("source"), "left").groupBy("source").agg(F.count("id").alias("n"))


@query("SELECT doc_id, CAST(round_even(length(text) / 4, 0) AS BIGINT) AS tokens, CAST(round_even(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 4, 0) AS BIGINT) AS compressed FROM documents")
def compress_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"), S.token_estimate(S.normalize_line(F.col("text"))).alias("compressed"))


@query("SELECT id, concat('s_', substr(sha1(concat_ws('|', agent, CAST(session AS VARCHAR), CAST(tokens_in AS VARCHAR), CAST(tokens_out AS VARCHAR))), 1, 15)) AS row_id FROM calls")
def deterministic_ids(spark, d):
    return calls(spark, d).select("id", S.short_id("s_", "agent", F.col("session").cast("string"), F.col("tokens_in").cast("string"), F.col("tokens_out").cast("string")).alias("row_id"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links, regexp_extract(url, '([^/]*)/*$', 1) AS base FROM pages")
def cited_files(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("links"), S.basename(F.col("url")).alias("base"))


@query("SELECT a.conv_id, a.turn, length(a.text) AS asked, length(b.text) AS answered FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def tool_result_pairing(spark, d):
    c = table(spark, d, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    return ask.join(answer, ["conv_id", "turn"], "left")


@query("SELECT session, agent, count(*) AS n FROM calls WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY session, agent")
def since_window(spark, d):
    """The cutoff is an argument, never the clock."""
    return calls(spark, d).where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).groupBy("session", "agent").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(n_nationkey, r_regionkey) AS key, CASE WHEN n_nationkey IS NULL THEN 'add' WHEN r_regionkey IS NULL THEN 'own' WHEN upper(n_name) = upper(r_name) THEN 'confirm' ELSE 'customized' END AS state FROM nation FULL JOIN region ON n_nationkey = r_regionkey + 3")
def config_diff_full_outer(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    state = F.when(F.col("n_nationkey").isNull(), "add").when(F.col("r_regionkey").isNull(), "own").when(F.upper("n_name") == F.upper("r_name"), "confirm").otherwise("customized")
    return n.join(r, F.col("n_nationkey") == F.col("r_regionkey") + 3, "full").select(F.coalesce("n_nationkey", "r_regionkey").alias("key"), state.alias("state"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS bucket, agent, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM calls GROUP BY ALL")
def stream_tumbling(spark, d):
    x = calls(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "agent").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"))
    return x.select(F.col("w.start").alias("bucket"), "agent", "n", "tokens_in")
