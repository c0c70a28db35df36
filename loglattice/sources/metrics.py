"""Metric rows: what the stores of two agents say of use, at the grain at which they say it, one schema an agent.

A row's id follows from what it says, so a log read again adds nothing and a request that has grown adds a row; ``fold.copilot_fold`` and
``fold.kiro_fold`` keep the best row of each key. Counts are 0 where a store tells none; credits and units of work are NULL then, for a
recorded 0 is something else. Rows of the sources ``cli`` and ``cli-delta`` tell the same use twice, as a total and as its growth, and
are never summed together. All readers take lines (file, line_no, line); null or broken lines give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loglattice.functions import scalars as S
from loglattice.operators import fold
from loglattice.sources.transcripts import VSCODE_PATCH

TOTALS = "array<struct<model: string, tokens_in: bigint, cached_in: bigint, tokens_out: bigint>>"
COPILOT = f"""id string, ts string, agent string, source string, session string, surface string, request string, call string, model string, provider string, tokens_in bigint, tokens_out bigint,
 cached_in bigint, model_totals {TOTALS}, credits double, session_credits double, nano_aiu double, elapsed_ms bigint, waiting_ms bigint"""
KIRO = "id string, ts string, agent string, source string, session string, surface string, provider string, model string, tokens_in bigint, tokens_out bigint, turn string, turns bigint, row_ref string"

#: Names under which stores write one count, the first that holds a number stands (fixed values).
NAMES = {
    "tokens_in": ["inputTokens", "input_tokens", "promptTokens", "prompt_tokens", "inputTokenCount", "promptTokenCount"],
    "tokens_out": ["outputTokens", "output_tokens", "completionTokens", "completion_tokens", "outputTokenCount", "completionTokenCount"],
    "cached_in": ["cacheReadTokens", "cache_read_tokens", "cacheReadInputTokens", "cache_read_input_tokens", "cachedTokens", "cached_tokens"],
}
CREDITS = {
    "credits": ["copilotCredits", "copilot_credits"],
    "session_credits": ["sessionCopilotCredits", "session_copilot_credits"],
    "premium": ["totalPremiumRequests", "total_premium_requests"],
    "nano_aiu": ["totalNanoAiu", "total_nano_aiu"],
}


def _fields(*names: list[str]) -> str:
    return ", ".join(f"{n}: double" for group in names for n in group)


_COUNTS = _fields(*NAMES.values())
#: Parts that may be of any type stay text and are parsed one by one, so that an odd one costs only itself.
SHUTDOWN = f"struct<modelMetrics: map<string, string>, {_fields(CREDITS['premium'], CREDITS['nano_aiu'])}>"
REQUEST = f"""struct<requestId: string, timestamp: bigint, modelId: string, agent: struct<extensionId: string>, elapsedMs: double, timeSpentWaiting: double, {_COUNTS}, {_fields(CREDITS['credits'], CREDITS['session_credits'])},
 result: string, modelTotals: array<string>>"""


def _once(text: str, schema: str) -> Column:
    """A parsed text as a generated column: filters on it are not pushed below, where each mention would parse it again."""
    return F.explode(F.array(F.from_json(text, schema)))


def _number(row: Column, names: list[str]) -> Column:
    return F.coalesce(*(S.finite(row[n]) for n in names))


def _count(row: Column, name: str) -> Column:
    return F.coalesce(_number(row, NAMES[name]).cast("bigint"), F.lit(0).cast("bigint"))


def _entry(model: Column, row: Column) -> Column:
    return F.struct(F.coalesce(model, F.lit("")).alias("model"), *(_count(row, c).alias(c) for c in ("tokens_in", "cached_in", "tokens_out")))


def _objects(texts: Column) -> Column:
    return F.filter(texts, lambda t: t.startswith("{"))


def _total(totals: Column, name: str) -> Column:
    return F.aggregate(totals, F.lit(0).cast("bigint"), lambda n, t: n + t[name])


def _copilot_row(source: str, surface: str, says: list[str], **columns: Column) -> list[Column]:
    """The columns of ``COPILOT``; ``says``: those that the id follows from, with source, session and request."""
    told = F.to_json(F.struct(*(columns[c].alias(c) for c in says)), {"ignoreNullFields": "false"})
    columns |= {"id": S.short_id("cm_", F.lit(source), columns["session"], columns.get("request", F.lit("")), told), "agent": F.lit("copilot"), "source": F.lit(source), "surface": F.lit(surface)}
    empty = {"request": F.lit(""), "call": F.lit(""), "model": F.lit(""), "provider": F.lit("")}
    rest = empty | {c: F.lit(0) for c in ("elapsed_ms", "waiting_ms")} | columns
    return [rest.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(COPILOT)]


def copilot_chats(lines: DataFrame) -> DataFrame:
    """One row a request of the editor's chats, in its last state; requests of other extensions, or of none named, and those that tell nothing are left out.

    The session is the one that the chat's own state names last, else the file's name. A request without counts of its own has those of its result.
    """
    p = lines.select("file", "line_no", _once("line", VSCODE_PATCH).alias("row"))
    named = F.when(F.col("row.kind") == 0, F.nullif(F.get_json_object("row.v", "$.sessionId"), F.lit("")))
    asked = F.when((F.col("row.kind") == 2) & (F.col("row.k") == F.array(F.lit("requests"))), _objects(F.from_json("row.v", "array<string>")))
    each = p.select("file", "line_no", named.alias("named"), asked.alias("asked")).where("named is not null or asked is not null")
    # A name is a row of its own, so that one shuffle by file settles both sessions and states.
    flat = each.select("file", "line_no", "named", F.posexplode_outer("asked").alias("pos", "text"))
    flat = flat.select("file", "line_no", "named", "pos", _once("text", REQUEST).alias("r"))
    session = F.max_by("named", F.when(F.col("named").isNotNull(), F.col("line_no"))).over(Window.partitionBy("file"))
    flat = flat.withColumn("session", F.coalesce(session, F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1))).where("r.requestId <> ''")
    last = fold.latest_per_key(flat.select("file", "session", F.col("r.requestId").alias("request"), "line_no", "pos", "r"), ["file", "session", "request"], ["line_no", "pos"])

    last = last.withColumn("md", F.from_json(F.get_json_object("r.result", "$.metadata"), f"struct<{_COUNTS}>"))
    r, md = F.col("r"), F.col("md")
    extension = F.coalesce(*(F.nullif(F.get_json_object(r["agent"]["extensionId"], f"$.{c}"), F.lit("")) for c in ("_lower", "value")), F.when(~r["agent"]["extensionId"].startswith("{"), r["agent"]["extensionId"]))
    own = lambda c: F.when(_count(r, c) != 0, _count(r, c)).otherwise(_count(md, c))
    listed = F.transform(_objects(F.coalesce(r["modelTotals"], F.array().cast("array<string>"))), lambda t: F.from_json(t, f"struct<model: string, modelId: string, {_COUNTS}>"))
    totals = F.transform(listed, lambda t: _entry(F.coalesce(F.nullif(t["model"], F.lit("")), t["modelId"]), t))
    ms = lambda c: F.coalesce(S.finite(r[c]).cast("bigint"), F.lit(0))
    x = last.where(F.lower(extension).contains("copilot")).select(
        "session", "request", F.date_format(F.timestamp_millis(r["timestamp"]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.coalesce(r["modelId"], F.lit("")).alias("model"), own("tokens_in").alias("tokens_in"), own("tokens_out").alias("tokens_out"),
        totals.alias("model_totals"), *(_number(r, CREDITS[c]).alias(c) for c in ("credits", "session_credits")), ms("elapsedMs").alias("elapsed_ms"), ms("timeSpentWaiting").alias("waiting_ms"),
    )
    x = x.where("tokens_in <> 0 or tokens_out <> 0 or size(model_totals) > 0 or credits is not null or session_credits is not null")
    x = x.withColumn("cached_in", _total(F.col("model_totals"), "cached_in")).withColumn("provider", S.provider_of(F.col("model")))
    says = ["tokens_in", "tokens_out", "cached_in", "model_totals", "credits", "session_credits", "elapsed_ms", "waiting_ms"]
    return x.select(*_copilot_row("chat", "vscode", says, **{c: F.col(c) for c in x.columns}))


def copilot_cli(lines: DataFrame) -> DataFrame:
    """Two rows a shutdown of a session: its running totals as they stand (``cli``) and, if anything moved, their growth (``cli-delta``).

    A counter that is smaller than before was restarted and counts whole. Growth has the shutdown's number as its request, so that a fold by
    key keeps every one; totals have none, so that it keeps the last. Shutdowns without a map of models are skipped and not numbered,
    as are those that tell nothing. The shutdowns of a session are ordered in one task, by one shuffle.
    """
    events = lines.select("file", "line_no", _once("line", "type string, timestamp string, data string").alias("row")).where("row.type = 'session.shutdown'")
    d = events.select("file", "line_no", F.col("row.timestamp").alias("ts"), _once("row.data", SHUTDOWN).alias("d"))
    x = d.where("d.modelMetrics is not null").select(
        "file", "line_no", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("session"), S.normal_form(F.col("ts")).alias("ts"), F.map_entries(F.map_filter("d.modelMetrics", lambda _, m: m.startswith("{"))).alias("models"),
        _number(F.col("d"), CREDITS["premium"]).alias("credits"), _number(F.col("d"), CREDITS["nano_aiu"]).alias("nano_aiu"),
    ).where("size(models) > 0 or credits is not null or nano_aiu is not null")
    for c in ("credits", "nano_aiu"):
        x = fold.delta_with_reset(x, ["file"], "line_no", c, f"{c}_grown")
    x = x.withColumn("no", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1)
    # One row a model, parsed once. Counts lie under ``usage``, or beside it where that is no object.
    one = x.select("*", F.posexplode_outer("models").alias("pos", "m")).withColumn("nested", F.get_json_object("m.value", "$.usage"))
    one = one.withColumn("u", F.from_json(F.when(F.col("nested").startswith("{"), F.col("nested")).otherwise(F.col("m.value")), f"struct<{_COUNTS}>"))
    one = one.select("file", "line_no", "session", "ts", "credits", "nano_aiu", "credits_grown", "nano_aiu_grown", "no", "pos", F.col("m.key").alias("model"), _entry(F.col("m.key"), F.col("u")).alias("t"))
    for c in ("tokens_in", "tokens_out", "cached_in"):
        one = fold.delta_with_reset(one.withColumn(f"_{c}", F.col(f"t.{c}")), ["file", "model"], "line_no", f"_{c}", c)
    grown = F.when((F.col("tokens_in") != 0) | (F.col("tokens_out") != 0), F.struct("pos", F.struct("model", "tokens_in", "cached_in", "tokens_out").alias("t")))
    listed = lambda e, name: F.transform(F.sort_array(F.collect_list(e)), lambda v: v["t"]).alias(name)
    keep = ["session", "ts", "credits", "nano_aiu", "credits_grown", "nano_aiu_grown", "no"]
    both = one.groupBy("file", "line_no").agg(*(F.first(c).alias(c) for c in keep), listed(F.when(F.col("model").isNotNull(), F.struct("pos", "t")), "model_totals"), listed(F.when(F.col("model").isNotNull(), grown), "grown"))

    def sums(totals: Column) -> dict[str, Column]:
        return {"model_totals": totals} | {c: _total(totals, c) for c in ("tokens_in", "tokens_out", "cached_in")}

    at = {"session": F.col("session"), "ts": F.col("ts")}
    cli = _copilot_row("cli", "cli", ["model_totals", "credits", "nano_aiu"], **at, **sums(F.col("model_totals")), credits=F.col("credits"), nano_aiu=F.col("nano_aiu"))
    single = F.when(F.size("grown") == 1, F.col("grown")[0]["model"]).otherwise("")
    request = F.concat(F.lit("s"), F.lpad(F.col("no").cast("string"), F.greatest(F.lit(3), F.length(F.col("no").cast("string"))), F.lit("0")))
    delta = _copilot_row("cli-delta", "cli", ["model_totals", "credits", "nano_aiu"], **at, **sums(F.col("grown")), credits=F.col("credits_grown"), nano_aiu=F.col("nano_aiu_grown"), request=request, model=single, provider=F.when(single == "", "").otherwise(S.provider_of(single)))
    moved = (F.size("grown") > 0) | (F.coalesce("credits_grown", F.lit(0)) != 0) | (F.coalesce("nano_aiu_grown", F.lit(0)) != 0)
    rows = F.array(F.struct(*cli), F.when(moved, F.struct(*delta)))
    return both.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def kiro_ide(lines: DataFrame, session: str = "kiro") -> DataFrame:
    """One row a line of the editor's log of tokens that tells any; the line's number is its key, as the log has neither ids nor times."""
    row = F.from_json("line", "model string, provider string, promptTokens double, generatedTokens double")
    n = lambda c: F.coalesce(S.finite(F.col("row")[c]).cast("bigint"), F.lit(0).cast("bigint"))
    x = lines.withColumn("row", row).where("row is not null").select("line_no", "line", "row", n("promptTokens").alias("tokens_in"), n("generatedTokens").alias("tokens_out")).where("tokens_in <> 0 or tokens_out <> 0")
    no = F.col("line_no").cast("string")
    return x.select(
        F.concat(F.lit("km_idelog"), F.lpad(no, F.greatest(F.lit(5), F.length(no)), F.lit("0")), F.substring(F.sha1(F.trim("line").cast("binary")), 1, 8)).alias("id"), F.lit(None).cast("string").alias("ts"), F.lit("kiro").alias("agent"), F.lit("ide-log").alias("source"),
        F.lit(session).alias("session"), F.lit("ide").alias("surface"), F.coalesce(F.nullif("row.provider", F.lit("")), F.lit("kiro")).alias("provider"), F.coalesce("row.model", F.lit("")).alias("model"), "tokens_in", "tokens_out", F.lit("").alias("turn"), F.lit(0).cast("bigint").alias("turns"), no.alias("row_ref"),
    )


def models_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_totals): the sums of each model over the rows of a key, in the order of their names; a model without a name has none.

    Summed by (key, model) first, so a key of many rows is combined before it is shuffled. Give rows of one source, folded where they are totals.
    """
    each = rows.select(*keys, F.explode("model_totals").alias("t")).where("t.model <> ''").groupBy(*keys, "t.model").agg(*(F.sum(f"t.{c}").alias(c) for c in ("tokens_in", "cached_in", "tokens_out")))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("model", "tokens_in", "cached_in", "tokens_out"))).alias("model_totals"))
