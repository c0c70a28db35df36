"""Runs of a knowledge-graph tool in agents' sessions, and the receipts that they earn: what reading the cited files would have taken, less the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.functions.udtfs import ToolRuns
from loglattice.sources.transcripts import VSCODE_PATCH, parsed

VERBS = ["query", "path", "explain"]
#: Fixed by the tool's output: how answers cite files. A path cites none.
CITED = {"query": (r"\[src=(.*?) loc=", 1), "explain": (r"(?m)^\s*Source:\s+(.+?)\s+L\d+\s*$", 1)}
#: Confidence of a receipt of a run, and of a report that was read.
RUN, READ = 0.6, 0.3
#: Fixed by the tool: where its report and its pages lie.
REPORT, WIKI = "graph_report.md", "/wiki/"

PART = """struct<kind: string, toolId: string, invocationMessage: struct<uris: map<string, struct<path: string>>>, resultDetails: struct<output: array<struct<value: string>>>,
 toolSpecificData: struct<commandLine: string, cwd: string, terminalCommandState: struct<exitCode: int>, terminalCommandOutput: struct<text: string>>>"""


def vscode_parts(lines: DataFrame) -> DataFrame:
    """(file, line_no, session, part) of every tool part of a chat's patch stream, from all three carriers: the requests of a snapshot, requests that
    are appended, and parts that are appended to a request's response, at whatever depth the patch's path lies. The session is the last that a snapshot names."""
    p = parsed(lines, VSCODE_PATCH)
    k, v = F.col("row.k"), F.col("row.v")
    last = F.when(F.size(k) > 0, F.element_at(k, -1))
    snapshot = F.from_json(v, f"struct<sessionId: string, requests: array<struct<response: array<{PART}>>>>")
    responses = lambda rs: F.flatten(F.transform(F.filter(rs, lambda r: r["response"].isNotNull()), lambda r: r["response"]))
    asked = F.from_json(v, f"array<struct<response: array<{PART}>>>")
    found = F.when(F.col("row.kind") == 0, responses(snapshot["requests"])).when(last == "requests", responses(asked)).when(last == "response", F.from_json(v, f"array<{PART}>"))
    named = p.where("row.kind = 0").select("file", "line_no", F.nullif(snapshot["sessionId"], F.lit("")).alias("s")).groupBy("file").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("line_no"))).alias("session"))
    parts = p.select("file", "line_no", F.posexplode(found).alias("part_no", "part")).where("part.kind = 'toolInvocationSerialized'")
    return parts.join(named, "file", "left").select("file", "line_no", "part_no", F.coalesce("session", F.lit("")).alias("session"), "part")


def either(text: Column, path: str) -> Column:
    """A field of an object, or the text itself where it is none."""
    return F.when(F.ltrim(text).startswith("{"), F.get_json_object(text, path)).otherwise(text)


def vscode_answer(part: Column) -> Column:
    """What a terminal run gave, NULL if it failed, has no recorded end, or left nothing: what the model was given before what the screen showed."""
    d = part["toolSpecificData"]
    given = F.array_join(F.filter(F.transform(part["resultDetails"]["output"], lambda b: b["value"]), lambda t: t.isNotNull()), "\n")
    told = F.exists(part["resultDetails"]["output"], lambda b: b["value"].isNotNull())
    shown = F.when(d["terminalCommandOutput"]["text"] != "", S.strip_ansi(d["terminalCommandOutput"]["text"]))
    return F.when(d["terminalCommandState"]["exitCode"] == 0, F.when(told, given).otherwise(shown))


def vscode_terminal_runs(lines: DataFrame) -> DataFrame:
    """(session, command, cwd, answer) of the terminal runs of chats; ``answer`` is NULL where there is no complete result."""
    d = F.col("part.toolSpecificData")
    rows = vscode_parts(lines).where("part.toolId = 'run_in_terminal' and part.toolSpecificData is not null")
    return rows.select("session", F.coalesce(either(d["commandLine"], "$.original"), F.lit("")).alias("command"), F.coalesce(either(d["cwd"], "$.path"), F.lit("")).alias("cwd"), vscode_answer(F.col("part")).alias("answer"))


def vscode_reads(lines: DataFrame, home: str) -> DataFrame:
    """(session, path, repo) of the tool's reports and pages that chats read; ``home``: the name of the tool's folder, above which lies the repository."""
    rows = vscode_parts(lines).where("part.toolId = 'copilot_readFile'").select("session", F.explode(F.map_values("part.invocationMessage.uris")).alias("u")).select("session", F.col("u.path").alias("path")).where("path is not null")
    plain = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    rows = rows.where(plain.endswith(f"{home}/{REPORT}") | plain.contains(f"{home}{WIKI}"))
    head = F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), rf"^((?:/|[A-Za-z]:/).*?)/?{home}/", 1)
    return rows.select("session", "path", head.alias("repo"))


def tool_ops(runs: DataFrame, tool: str, command: str = "command") -> DataFrame:
    """``runs`` with op and argv, one row a run of the tool that a command makes; commands that only speak of it give none."""
    return runs.lateralJoin(ToolRuns(F.col(command).outer(), F.lit(tool), F.array(*map(F.lit, VERBS))))


def cited_files(answer: Column, op: Column) -> Column:
    """The files that an answer cites, as it names them, each as often as it does."""
    none = F.array().cast("array<string>")
    found = F.when(op == "explain", F.regexp_extract_all(answer, F.lit(CITED["explain"][0]), 1)).when(op == "query", F.regexp_extract_all(answer, F.lit(CITED["query"][0]), 1)).otherwise(none)
    return F.filter(F.transform(found, lambda f: F.trim(f)), lambda f: f != "")


def receipts(runs: DataFrame, corpus: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts to file, counts of what became of the runs by ``outcome``).

    ``runs``: session, op, argv, answer, cwd, ts. ``corpus``: path, revision (time), tokens of files as they have been. ``have``: ids filed. A run
    whose own id is there is known; one whose id without a session is there was filed by another route and defers to it. What the cited files,
    each once, held at the time of the run (or first held after it) is the alternative; without more of that than the answer is long there is no saving to claim.
    """
    sign = S.content_signature(F.col("argv"), F.col("answer"))
    key = lambda session: S.short_id("s_", session, F.col("op"), F.col("g.args_hash"), F.col("g.answer_hash"))
    signed = runs.where("answer is not null").withColumn("g", sign)
    signed = signed.withColumn("id", key(F.col("session"))).withColumn("twin", key(F.lit("")))
    # A run that is logged twice is one: the earliest stands.
    once = signed.groupBy("id").agg(F.min_by(F.struct("session", "op", "answer", "cwd", "ts", "twin"), "ts").alias("r"), F.count(F.lit(1)).alias("times")).select("id", "r.*", "times")
    known = have.select("id").distinct()
    once = once.join(known.withColumn("own", F.lit(True)), "id", "left").join(known.select(F.col("id").alias("twin"), F.lit(True).alias("other")), "twin", "left")
    state = F.when(F.col("own"), "known").when(F.col("other"), "deferred")
    cited = once.where(state.isNull()).select("id", "ts", "answer", "cwd", F.explode(cited_files(F.col("answer"), F.col("op"))).alias("cited"))
    whole = F.when(F.col("cited").rlike(r"^(/|[A-Za-z]:/)") | (F.col("cwd") == ""), F.col("cited")).otherwise(F.concat("cwd", F.lit("/"), "cited"))
    # One size a (file, run's time): the last revision that is not later, else the first there is.
    asked = cited.select(whole.alias("path"), "ts").distinct()
    met = asked.join(corpus, "path").groupBy("path", "ts").agg(F.max_by("tokens", F.when(F.col("revision") <= F.col("ts"), F.col("revision"))).alias("then"), F.min_by("tokens", "revision").alias("first"))
    sized = cited.select("id", "ts", whole.alias("path")).distinct().join(met.select("path", "ts", F.coalesce("then", "first").alias("tokens")), ["path", "ts"])
    raw = sized.groupBy("id").agg(F.sum("tokens").alias("raw"))
    counts = once.select("id", F.size(cited_files(F.col("answer"), F.col("op"))).alias("source_files"))
    told = once.join(raw, "id", "left").join(counts, "id").withColumn("actual", S.token_estimate(F.col("answer")))
    outcome = F.coalesce(state, F.when((F.coalesce("raw", F.lit(0)) > 0) & (F.col("actual") < F.col("raw")), "receipt").otherwise("unmeasurable"))
    told = told.withColumn("outcome", outcome)
    filed = told.where("outcome = 'receipt'").select("id", "session", "op", "ts", F.col("raw").alias("raw_alternative"), "actual", (F.col("raw") - F.col("actual")).alias("saved"), "source_files", F.lit("modeled").alias("method"), F.lit(RUN).alias("confidence"))
    return filed, told.groupBy("outcome").agg(F.count(F.lit(1)).alias("runs"), F.sum("times").alias("logged"))


def read_receipts(reads: DataFrame, graphs: DataFrame, corpus: DataFrame, have: DataFrame) -> DataFrame:
    """Receipts of reports that were read: one a (session, file, revision of the graph), against the whole corpus of the repository.

    ``reads``: session, path, repo. ``graphs``: repo, revision (seconds), files, tokens of the corpus. ``corpus``: path, revision, tokens, the newest of which
    is what was read. A report as long as its corpus, or that is not there, saves nothing.
    """
    now = corpus.groupBy("path").agg(F.max_by("tokens", "revision").alias("actual"))
    g = S.read_signature(F.col("path"), F.col("revision"))
    rows = reads.distinct().join(graphs, "repo").join(now, "path").withColumn("g", g)
    rows = rows.withColumn("id", S.short_id("s_", F.col("session"), F.lit("report-read"), F.col("g.args_hash"), F.col("g.answer_hash"))).where("actual > 0 and tokens > actual").dropDuplicates(["id"])
    rows = rows.join(have.select("id").distinct(), "id", "left_anti")
    return rows.select("id", "session", F.lit("report-read").alias("op"), F.col("tokens").alias("raw_alternative"), "actual", (F.col("tokens") - F.col("actual")).alias("saved"), F.col("files").alias("source_files"), F.lit("modeled").alias("method"), F.lit(READ).alias("confidence"))
