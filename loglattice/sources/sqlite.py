"""Agents' SQLite stores: each store is read as a whole from any storage that Spark reads, and opened in memory by its task."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions import scalars as S

#: Conversations stand in either table, the newer one with columns of its own for what else is in the text.
KIRO_TABLES = [[f"SELECT key, conversation_id, value, updated_at FROM {t}", f"SELECT key, NULL, value, NULL FROM {t}"] for t in ("conversations_v2", "conversations")]
OTEL = [["SELECT span_id, COALESCE(conversation_id, chat_session_id), COALESCE(response_model, request_model), input_tokens, output_tokens, cached_tokens, ttft_ms, start_time_ms FROM spans WHERE operation_name = 'chat'"]]
TURN = """struct<user: struct<content: struct<ToolUseResults: struct<tool_use_results: array<struct<tool_use_id: string, content: string>>>>>,
 assistant: struct<ToolUse: struct<tool_uses: array<struct<id: string, name: string, args: string>>>>,
 request_metadata: struct<message_id: string, context_usage_percentage: double, request_start_timestamp_ms: bigint, time_between_chunks: array<string>, tool_use_ids_and_names: array<string>, user_prompt_length: bigint,
 response_size: bigint, model_id: string, uncached_input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_write_input_tokens: bigint>>"""
KIRO_DOC = f"conversation_id string, history array<{TURN}>, model_info struct<model_id: string, model_name: string>, user_turn_metadata struct<usage_info: array<struct<unit: string, value: double>>>"
ROWS = 500


def read(spark: SparkSession, path: str, queries: list[list[str]], names: list[str], glob: str = "*") -> DataFrame:
    """(file, names as text) of all rows that ``queries`` give: of each list the first query that the store's tables allow.

    A file that is no store, and a store without the tables, gives no rows. A store is an agent's own and of its size.
    """

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                con = sqlite3.connect(":memory:")
                try:
                    raw = bytearray(content.as_py())
                    raw[18:20] = b"\1\1"  # what has been checkpointed is read; a journal beside the file is not
                    con.deserialize(bytes(raw))
                    for ways in queries:
                        rows = None
                        for sql in ways:
                            try:
                                rows = con.execute(sql)
                                break
                            except sqlite3.DatabaseError:
                                continue
                        while rows is not None and (some := rows.fetchmany(ROWS)):
                            columns = [[None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in c] for c in zip(*some, strict=True)]
                            yield pa.RecordBatch.from_arrays([pa.array([file] * len(some), pa.string()), *(pa.array(c, pa.string()) for c in columns)], names=["file", *names])
                except sqlite3.DatabaseError:
                    continue
                finally:
                    con.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in ["file", *names]))


def copilot_spans(spark: SparkSession, path: str, glob: str = "*.db") -> DataFrame:
    """One row a model call of the span store; calls that tell no use are left out."""
    rows = read(spark, path, OTEL, ["call", "session", "model", "tokens_in", "tokens_out", "cached_in", "ttft_ms", "at"], glob)
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)").cast("long"), F.lit(0)).alias(c)
    ts = F.date_format(F.timestamp_millis(F.expr("try_cast(at as bigint)")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    out = rows.where("call <> ''").select("file", "call", F.coalesce("session", F.lit("")).alias("session"), F.coalesce("model", F.lit("")).alias("model"), number("tokens_in"), number("tokens_out"), number("cached_in"), number("ttft_ms"), F.coalesce(ts, F.lit("")).alias("ts"))
    return out.where("tokens_in <> 0 or tokens_out <> 0 or cached_in <> 0")


def kiro_conversations(spark: SparkSession, path: str, workspace: str = "", glob: str = "*") -> DataFrame:
    """(file, key, session, doc, ts) of the conversations held in a directory tree, or of all of them."""
    rows = read(spark, path, KIRO_TABLES, ["key", "conversation_id", "value", "updated_at"], glob).where("value is null or value = '' or schema_of_variant(try_parse_json(value)) like 'OBJECT%'").withColumn("doc", F.from_json(F.coalesce(F.nullif(F.col("value"), F.lit("")), F.lit("{}")), KIRO_DOC))
    if workspace:
        rows = rows.where(S.under(F.col("key"), F.lit(workspace)))
    ts = F.date_format(F.timestamp_millis(F.expr("try_cast(updated_at as bigint)")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select("file", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("conversation_id", "doc.conversation_id", F.lit("")).alias("session"), "doc", ts.alias("ts"))


def kiro_chats(conversations: DataFrame) -> DataFrame:
    """One row a conversation: turns, credits (NULL where the store has none, which is not nothing used), the last context share."""
    usage = F.filter("doc.user_turn_metadata.usage_info", lambda u: u["unit"].startswith("credit") & u["value"].isNotNull())
    credits = F.round(F.aggregate(usage, F.lit(0.0), lambda a, u: a + u["value"]), 6)
    shares = F.filter(F.transform("doc.history", lambda h: h["request_metadata"]["context_usage_percentage"]), lambda x: x.isNotNull())
    out = conversations.select(
        "session", "ts", S.basename(F.col("key")).alias("project"), F.coalesce("doc.model_info.model_id", "doc.model_info.model_name", F.lit("")).alias("model"), F.coalesce(F.size("doc.history"), F.lit(0)).alias("turns"),
        credits.alias("credits"), F.coalesce(F.try_element_at(shares, F.lit(-1)), F.lit(0.0)).alias("context_pct"),
    )
    return out.withColumn("turns", F.greatest("turns", F.lit(0))).where("turns > 0 or credits is not null or context_pct <> 0")


def kiro_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn that the store has numbers of. Counts that it does not keep yet are NULL."""
    m = "h.request_metadata"
    each = conversations.select("session", S.basename(F.col("key")).alias("project"), F.posexplode("doc.history").alias("turn", "h")).where(f"{m} is not null")
    size = lambda c: F.greatest(F.coalesce(F.size(f"{m}.{c}"), F.lit(0)), F.lit(0))
    ts = F.date_format(F.timestamp_millis(F.col(f"{m}.request_start_timestamp_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return each.select(
        "session", "project", "turn", F.coalesce(f"{m}.message_id", F.lit("")).alias("row_ref"), F.coalesce(f"{m}.model_id", F.lit("")).alias("model"), ts.alias("ts"), F.col(f"{m}.uncached_input_tokens").alias("tokens_in"), F.col(f"{m}.output_tokens").alias("tokens_out"),
        F.col(f"{m}.cache_read_input_tokens").alias("cached_in"), F.col(f"{m}.cache_write_input_tokens").alias("cached_out"), F.coalesce(f"{m}.context_usage_percentage", F.lit(0.0)).alias("context_pct"), size("time_between_chunks").alias("chunks"), size("tool_use_ids_and_names").alias("tool_uses"),
        F.col(f"{m}.user_prompt_length").alias("prompt_bytes"), F.col(f"{m}.response_size").alias("response_bytes"),
    )


def kiro_tool_runs(conversations: DataFrame) -> DataFrame:
    """Tool uses with their results, which a later turn of the conversation brings; a use without one has not completed."""
    turns = conversations.select("session", F.explode("doc.history").alias("h"))
    use = turns.select("session", F.explode("h.assistant.ToolUse.tool_uses").alias("u")).select("session", F.col("u.id").alias("tool_use_id"), F.col("u.name").alias("tool"), F.col("u.args").alias("input"))
    result = turns.select("session", F.explode("h.user.content.ToolUseResults.tool_use_results").alias("r")).select("session", "r.tool_use_id", S.result_text(F.col("r.content")).alias("answer"))
    return use.join(result, ["session", "tool_use_id"])
