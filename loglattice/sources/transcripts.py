"""Session logs of coding agents to typed rows.

A log is read file by file, so that a line keeps its number: later lines override earlier ones. A file is one session
(megabytes at most); files are spread over the cluster. Lines that are not JSON are skipped, other lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators import fold

CLAUDE = """type string, uuid string, requestId string, sessionId string, isSidechain boolean, timestamp string, cwd string, summary string,
 message struct<id string, model string, content string, usage struct<input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint,
  cache_creation struct<ephemeral_5m_input_tokens bigint, ephemeral_1h_input_tokens bigint>, output_tokens_details struct<thinking_tokens bigint>, server_tool_use struct<web_search_requests bigint, web_fetch_requests bigint>>>"""
CLAUDE_BLOCK = "array<struct<type string, name string, id string, tool_use_id string, input string, content string>>"
COPILOT_EVENT = "type string, timestamp string, data string"
COPILOT_SHUTDOWN = """totalPremiumRequests double, totalNanoAiu double,
 modelMetrics map<string, struct<usage struct<inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheWriteTokens bigint>>>"""
VSCODE_PATCH = "kind int, k array<string>, v string"
VSCODE_REQUEST = """requestId: string, timestamp: bigint, modelId: string, agent: struct<extensionId: string>, promptTokens: bigint, completionTokens: bigint, copilotCredits: double,
 sessionCopilotCredits: double, elapsedMs: bigint, timeSpentWaiting: bigint, modelTotals: array<struct<model: string, modelId: string, inputTokens: bigint, cachedTokens: bigint, outputTokens: bigint>>"""
SIDECAR = "turnId string, ts string, model string, inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, totalNanoAiu bigint"
#: All that may be read of a debug log: its other fields are content.
DEBUG_LOG = "type string, ts string, spanId string, attrs struct<model string, inputTokens bigint, outputTokens bigint, ttft double>"
KIRO_IDE = "model string, provider string, promptTokens bigint, generatedTokens bigint"
GRAPH = "nodes array<struct<source_file string, community string>>"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of each line that is JSON."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return lines.where("try_parse_json(line) is not null and trim(line) <> ''")


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """``lines`` with ``row``: a field of the wrong type is NULL, the others stay."""
    return lines.withColumn("row", F.from_json("line", schema)).drop("line").where("row is not null")


def _zero(*parts: Column) -> Column:
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return total


def claude_calls(lines: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """One row per assistant line that tells its use. ``more``: further columns of the parsed ``row``."""
    rows = parsed(lines, CLAUDE).where("row.type = 'assistant' and row.message.usage is not null")
    u = F.col("row.message.usage")
    return rows.select(
        "file", "line_no", F.coalesce("row.sessionId", F.lit("")).alias("session"), F.lit("claude").alias("agent"),
        F.coalesce("row.requestId", "row.uuid").alias("request"), F.coalesce("row.message.id", "row.uuid").alias("message"),
        F.col("row.message.model").alias("model"), S.normal_form(F.col("row.timestamp")).alias("ts"), F.col("row.cwd").alias("project"), F.coalesce("row.isSidechain", F.lit(False)).alias("sidechain"),
        _zero(u["input_tokens"], u["cache_read_input_tokens"], u["cache_creation_input_tokens"]).alias("tokens_in"), F.coalesce(u["output_tokens"], F.lit(0)).alias("tokens_out"),
        F.coalesce(u["cache_read_input_tokens"], F.lit(0)).alias("cached_in"), u["cache_creation_input_tokens"].alias("cache_write"), *(more or []),
    )


def claude_requests(lines: DataFrame) -> DataFrame:
    """The last line of each (session, request, message): a streamed answer is logged several times."""
    return fold.latest_per_key(claude_calls(lines), ["session", "request", "message"], ["file", "line_no"])


#: Counts of a chat, by model and altogether.
BY_MODEL = ("tokens_in", "tokens_out", "cached_in", "cache_write")
ALTOGETHER = (*BY_MODEL, "ttl_5m", "ttl_1h", "thinking", "web_search", "web_fetch", "sidechain_in", "sidechain_out")


def claude_chats(lines: DataFrame) -> DataFrame:
    """Totals of each session over its folded requests, by model as well, and how many lines there were before folding: the log is read once.

    ``model_totals`` maps each model named to its sums. Cache writes are NULL where no line tells of any, the other counts are then 0.
    """
    u = F.col("row.message.usage")
    more = [u["cache_creation"]["ephemeral_5m_input_tokens"].alias("ttl_5m"), u["cache_creation"]["ephemeral_1h_input_tokens"].alias("ttl_1h"), u["output_tokens_details"]["thinking_tokens"].alias("thinking"),
            u["server_tool_use"]["web_search_requests"].alias("web_search"), u["server_tool_use"]["web_fetch_requests"].alias("web_fetch")]
    calls = claude_calls(lines, more)
    keys = ["session", "request", "message"]
    rest = [c for c in calls.columns if c not in keys]
    once = calls.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("file", "line_no")).alias("r"), F.count(F.lit(1)).alias("raw_rows")).select(*keys, "r.*", "raw_rows")
    aside = lambda c: F.when(F.col("sidechain"), F.col(c)).otherwise(0)
    once = once.withColumn("sidechain_in", aside("tokens_in")).withColumn("sidechain_out", aside("tokens_out"))
    sums = [F.sum(c).alias(c) for c in ALTOGETHER]
    where = F.max(F.when(F.col("project") != "", F.struct("file", "line_no", "project"))).alias("_where")
    model = once.groupBy("session", F.coalesce("model", F.lit("")).alias("model")).agg(*sums, F.sum("raw_rows").alias("raw_rows"), F.count(F.lit(1)).alias("requests"), F.max("ts").alias("ts"), where)
    named = F.when(F.col("model") != "", F.struct("model", F.struct(*BY_MODEL).alias("totals")))
    out = model.groupBy("session").agg(*sums, F.sum("requests").alias("requests"), F.sum("raw_rows").alias("raw_rows"), F.max("ts").alias("ts"), F.max("_where")["project"].alias("project"), F.map_from_entries(F.sort_array(F.collect_list(named))).alias("model_totals"))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ALTOGETHER if c != "cache_write"})


def claude_names(lines: DataFrame) -> DataFrame:
    """(file, name): the last summary of each session file."""
    return parsed(lines, CLAUDE).where("row.type = 'summary' and row.summary <> ''").groupBy("file").agg(F.max_by("row.summary", "line_no").alias("name"))


def claude_touched(lines: DataFrame) -> DataFrame:
    """(file, session, files): the files that a log's edits name, each once, in the order in which they first appear."""
    e = claude_edits(lines).groupBy("file", "session", "path").agg(F.min(F.struct("line_no", "block_no")).alias("at"))
    return e.groupBy("file", "session").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("files"))


def copilot_vscode_names(lines: DataFrame) -> DataFrame:
    """(file, name): the last title that the user gave, else the first generated one, else empty."""
    p = parsed(lines, VSCODE_PATCH)
    custom = F.when(F.col("row.k") == F.array(F.lit("customTitle")), F.col("row.v")).when(F.col("row.kind") == 0, F.get_json_object("row.v", "$.customTitle"))
    asked = F.when((F.col("row.kind") == 2) & (F.col("row.k") == F.array(F.lit("requests"))), F.from_json("row.v", "array<struct<response: array<string>>>"))
    blocks = F.flatten(F.filter(F.transform(asked, lambda r: r["response"]), lambda r: r.isNotNull()))
    titles = F.filter(F.transform(blocks, lambda b: F.get_json_object(b, "$.generatedTitle")), lambda t: t != "")
    each = p.select("file", "line_no", F.nullif(custom, F.lit("")).alias("custom"), F.get(titles, 0).alias("generated"))
    last, first = F.max_by("custom", F.when(F.col("custom").isNotNull(), F.col("line_no"))), F.min_by("generated", F.when(F.col("generated").isNotNull(), F.col("line_no")))
    return each.groupBy("file").agg(F.coalesce(last, first, F.lit("")).alias("name"))


def copilot_cli_names(spark: SparkSession, path: str) -> DataFrame:
    """(file, name): the ``name:`` of each workspace.yaml, without one pair of quotes; empty where there is none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="workspace.yaml").select(F.col("_metadata.file_path").alias("file"), "value")
    raw = F.trim(F.regexp_extract("value", r"(?m)^name:[^\S\n]*(.*)$", 1))
    return files.select("file", F.trim(F.regexp_replace(raw, r"""^(['"])(.*)\1$""", "$2")).alias("name"))


def claude_blocks(lines: DataFrame) -> DataFrame:
    """The content blocks of all messages, one a row."""
    rows = parsed(lines, CLAUDE).select("file", "line_no", F.coalesce("row.sessionId", F.lit("")).alias("session"), "row.cwd", "row.timestamp", F.from_json("row.message.content", CLAUDE_BLOCK).alias("blocks"))
    return rows.select("file", "line_no", "session", "cwd", "timestamp", F.posexplode("blocks").alias("block_no", "block"))


def claude_tool_runs(lines: DataFrame) -> DataFrame:
    """Tool uses with their results, by id within the session; a use without a result has not completed and is left out."""
    b = claude_blocks(lines)
    use = b.where("block.type = 'tool_use'").select("session", F.col("block.id").alias("tool_use_id"), F.col("block.name").alias("tool"), F.col("block.input").alias("input"))
    result = b.where("block.type = 'tool_result'").select("session", "block.tool_use_id", F.col("block.content").alias("answer"))
    return use.join(result, ["session", "tool_use_id"])


def claude_edits(lines: DataFrame) -> DataFrame:
    """(id, session, ts, path, proposed, context): the lines that each edit puts in, and those that it replaces; a log's line and block tell an edit's id.

    A notebook's edit puts in its cell's source.
    """
    i = F.from_json("block.input", "file_path string, notebook_path string, content string, old_string string, new_string string, new_source string, edits array<struct<old_string string, new_string string>>")
    rows = claude_blocks(lines).where("block.type = 'tool_use' and block.name in ('Edit', 'MultiEdit', 'Write', 'NotebookEdit')").withColumn("i", i)
    one = F.array(F.struct(F.col("i.old_string").alias("old_string"), F.coalesce("i.content", "i.new_source", "i.new_string").alias("new_string")))
    pairs = F.when(F.col("i.edits").isNotNull(), F.col("i.edits")).otherwise(one)

    def cut(field: str) -> Column:
        return F.flatten(F.transform("pairs", lambda e: F.when(F.coalesce(e[field], F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(e[field], "\n"))))

    out = rows.withColumn("pairs", pairs).withColumn("path", F.coalesce("i.file_path", "i.notebook_path")).where("path <> ''")
    at = S.short_id("e_", F.col("file"), F.col("line_no").cast("string"), F.col("block_no").cast("string"), length=24)
    return out.select(at.alias("id"), "file", "line_no", "block_no", "session", F.try_to_timestamp("timestamp").alias("ts"), "path", cut("new_string").alias("proposed"), cut("old_string").alias("context"))


def copilot_cli_deltas(lines: DataFrame) -> DataFrame:
    """Use of each model between two shutdowns of a session: its counters are cumulative, and a smaller one is a restart.

    What a shutdown bills is billed once: ``credits``, ``premium`` (whole requests) and ``nano_aiu`` stand on the model that
    moved the most, and the others that moved name it in ``billed_with``. A shutdown without models that bills has a row of its own.
    """
    rows = parsed(lines, COPILOT_EVENT).where("row.type = 'session.shutdown'").select("file", "line_no", F.col("row.timestamp").alias("ts"), F.from_json("row.data", COPILOT_SHUTDOWN).alias("d"))
    bills = rows.where("d.modelMetrics is not null").withColumn("total_credits", F.col("d.totalPremiumRequests")).withColumn("total_premium", F.floor("total_credits")).withColumn("total_nano_aiu", F.col("d.totalNanoAiu"))
    for c in ("credits", "premium", "nano_aiu"):
        bills = fold.delta_with_reset(bills, ["file"], "line_no", f"total_{c}", c)
    each = bills.select("file", "line_no", S.normal_form(F.col("ts")).alias("ts"), "credits", "premium", "nano_aiu", F.explode_outer("d.modelMetrics").alias("model", "m"))
    each = each.where("model is not null or credits <> 0 or nano_aiu <> 0").withColumn("model", F.coalesce("model", F.lit("copilot/unknown")))
    counters = (("inputTokens", "tokens_in"), ("outputTokens", "tokens_out"), ("cacheReadTokens", "cached_in"), ("cacheWriteTokens", "cache_write"))
    out = each.select("file", "line_no", "ts", "model", "credits", "premium", "nano_aiu", *(F.coalesce(F.col("m.usage")[c], F.lit(0)).alias(n) for c, n in counters))
    for _, c in counters:
        out = fold.delta_with_reset(out, ["file", "model"], "line_no", c, f"{c}_delta")
    moved = (F.col("tokens_in_delta") != 0) | (F.col("tokens_out_delta") != 0)
    out = largest_mover(out.withColumn("_size", F.struct(moved, "tokens_in_delta")), ["file", "line_no"], "_size", "model", "_carrier")
    carries = F.col("model") == F.col("_carrier")
    for c in ("credits", "premium", "nano_aiu"):
        out = out.withColumn(f"_{c}", F.col(c)).withColumn(c, F.when(carries, F.col(c)))
    return out.withColumn("billed_with", F.when(~carries & moved & F.col("_credits").isNotNull(), F.col("_carrier"))).drop("_size", "_carrier", "_credits", "_premium", "_nano_aiu")


def copilot_cli_tool_runs(lines: DataFrame) -> DataFrame:
    """Started tools with their completion."""
    rows = parsed(lines, COPILOT_EVENT).where("row.type in ('tool.execution_start', 'tool.execution_complete')")
    rows = rows.select("file", F.col("row.type").alias("type"), F.get_json_object("row.data", "$.toolCallId").alias("call"), F.col("row.data").alias("data"))
    began = rows.where("type = 'tool.execution_start'").select("file", "call", F.col("data").alias("started"))
    return began.join(rows.where("type = 'tool.execution_complete'").select("file", "call", F.col("data").alias("completed")), ["file", "call"])


def copilot_vscode_requests(lines: DataFrame) -> DataFrame:
    """The requests of a patch stream, the last state of each; requests of other extensions are left out."""
    p = parsed(lines, VSCODE_PATCH)
    first = p.where("row.kind = 0").select("file", "line_no", F.get_json_object("row.v", "$.requests").alias("v"))
    later = p.where("row.kind = 2 and row.k = array('requests')").select("file", "line_no", F.col("row.v").alias("v"))
    each = first.unionByName(later).select("file", "line_no", F.posexplode(F.from_json("v", f"array<struct<{VSCODE_REQUEST}>>")).alias("pos", "r"))
    each = each.select("file", "line_no", "pos", "r.*").where("requestId is not null and (agent.extensionId is null or lower(agent.extensionId) like '%copilot%')")
    last = fold.latest_per_key(each, ["file", "requestId"], ["line_no", "pos"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = F.transform(
        F.filter(F.coalesce("modelTotals", F.array().cast("array<struct<model: string, modelId: string, inputTokens: bigint, cachedTokens: bigint, outputTokens: bigint>>")), lambda t: t.isNotNull()),
        lambda t: F.struct(F.coalesce(t["model"], t["modelId"], F.lit("")).alias("model"), zero(t["inputTokens"]).alias("tokens_in"), zero(t["cachedTokens"]).alias("cached_in"), zero(t["outputTokens"]).alias("tokens_out")),
    )
    return last.select(
        "file", F.col("requestId").alias("request"), F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("modelId").alias("model"),
        S.provider_of(F.col("modelId")).alias("provider"), F.coalesce("promptTokens", F.lit(0)).alias("tokens_in"), F.coalesce("completionTokens", F.lit(0)).alias("tokens_out"), S.finite(F.col("copilotCredits")).alias("credits"),
        S.finite(F.col("sessionCopilotCredits")).alias("session_credits"), F.col("elapsedMs").alias("elapsed_ms"), F.col("timeSpentWaiting").alias("waiting_ms"),
        totals.alias("model_totals"), F.aggregate(totals, F.lit(0).cast("long"), lambda n, t: n + t["cached_in"]).alias("cached_in"),
    )


def copilot_sidecar(lines: DataFrame) -> DataFrame:
    rows = parsed(lines, SIDECAR).where("row.turnId is not null")
    return rows.select("file", F.col("row.turnId").alias("request"), S.normal_form(F.col("row.ts")).alias("ts"), F.col("row.model").alias("model"), F.coalesce("row.inputTokens", F.lit(0)).alias("tokens_in"), F.coalesce("row.outputTokens", F.lit(0)).alias("tokens_out"), F.col("row.cacheReadTokens").alias("cached_in"), F.col("row.totalNanoAiu").alias("nano_aiu"))


def copilot_debug_log(lines: DataFrame) -> DataFrame:
    rows = parsed(lines, DEBUG_LOG).where("row.type = 'llm_request'")
    return rows.select("file", F.col("row.spanId").alias("request"), F.col("row.attrs.model").alias("model"), F.coalesce("row.attrs.inputTokens", F.lit(0)).alias("tokens_in"), F.coalesce("row.attrs.outputTokens", F.lit(0)).alias("tokens_out"), F.col("row.attrs.ttft").alias("ttft_ms"))


def kiro_ide_calls(lines: DataFrame) -> DataFrame:
    """Rows without id or time: the line's number and content are their identity."""
    rows = lines.withColumn("id", S.short_id("k_", F.col("file"), F.col("line_no").cast("string"), F.col("line")))
    rows = rows.withColumn("row", F.from_json("line", KIRO_IDE)).where("row.promptTokens is not null or row.generatedTokens is not null")
    return rows.select("id", "file", "line_no", F.col("row.model").alias("model"), F.coalesce("row.provider", F.lit("")).alias("provider"), F.coalesce("row.promptTokens", F.lit(0)).alias("tokens_in"), F.coalesce("row.generatedTokens", F.lit(0)).alias("tokens_out"))


def response_usage(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds model, tokens_in, tokens_out of a provider's answer: one JSON text, or a stream of ``data:`` frames.

    Of a stream the first model and input count are taken, and the last output count.
    """
    frame = "model string, usage struct<input_tokens bigint, output_tokens bigint, prompt_tokens bigint, completion_tokens bigint>, message struct<model string, usage struct<input_tokens bigint, output_tokens bigint>>"
    texts = F.when(F.ltrim(body).startswith("{"), F.array(body)).otherwise(F.regexp_extract_all(body, F.lit(r"(?m)^data:\s*(\{.*)$"), 1))
    f = bodies.withColumn("_f", F.filter(F.transform(texts, lambda t: F.from_json(t, frame)), lambda x: x.isNotNull()))

    def values(get) -> Column:
        return F.filter(F.transform("_f", get), lambda x: x.isNotNull())

    return f.select(
        *bodies.columns, F.get(values(lambda x: F.coalesce(x["model"], x["message"]["model"])), 0).alias("model"),
        F.get(values(lambda x: F.coalesce(x["usage"]["input_tokens"], x["usage"]["prompt_tokens"], x["message"]["usage"]["input_tokens"])), 0).alias("tokens_in"),
        F.try_element_at(values(lambda x: F.coalesce(x["usage"]["output_tokens"], x["usage"]["completion_tokens"], x["message"]["usage"]["output_tokens"])), F.lit(-1)).alias("tokens_out"),
    )


def graph_files(spark: SparkSession, path: str) -> DataFrame:
    """(graph, source_file, community) of a knowledge graph's nodes, each file once."""
    g = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("graph"), F.from_json("value", GRAPH).alias("g"))
    return g.select("graph", F.explode("g.nodes").alias("n")).where("n.source_file <> ''").groupBy("graph", "n.source_file").agg(F.min("n.community").alias("community"))


def largest_mover(rows: DataFrame, keys: list[str], size: str, tie: str, name: str) -> DataFrame:
    """Adds ``name``: the tie column's value on the row with the largest ``size`` of each key, which carries what is billed once."""
    w = Window.partitionBy(*keys).orderBy(F.desc(size), F.desc(tie))
    return rows.withColumn(name, F.first(tie).over(w))
