import datetime as dt
import json

from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.functions.udfs import command_words, cut
from loglattice.operators import joins
from loglattice.sources import transcripts as T
from loglattice.streaming import windows


def written(tmp_path, name, rows):
    """A log with a blank line, a broken one and a last one that is cut off."""
    (tmp_path / name).mkdir()
    (tmp_path / name / "log.jsonl").write_text("\n".join([json.dumps(r) for r in rows] + ["", "{broken", '{"type": "assi']))
    return str(tmp_path / name)


def assistant(request, usage, **more):
    return {"type": "assistant", "uuid": f"u-{request}", "requestId": request, "sessionId": "s", "timestamp": "2024-05-01T10:00:00.900+05:30", "cwd": "/p", "message": {"id": f"m-{request}", "model": "claude-x", "usage": usage, **more}}


def test_claude(spark, tmp_path):
    first = {"input_tokens": 12, "output_tokens": 450, "cache_read_input_tokens": 1800, "cache_creation_input_tokens": 600}
    edit = [{"type": "tool_use", "name": "Edit", "id": "t1", "input": {"file_path": "a.py", "old_string": "x", "new_string": "y\nz"}}, {"type": "tool_use", "name": "Bash", "id": "t2", "input": {"command": "ls"}}]
    rows = [assistant("r1", {**first, "output_tokens": 3}), assistant("r1", first, content=edit), {"type": "user", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}}]
    rows += [{"type": "summary", "summary": "old"}, {"type": "summary", "summary": "new"}, assistant("r2", {"input_tokens": 9000, "output_tokens": 1500}), {"type": "assistant", "message": "not a message"}]
    lines = T.numbered_lines(spark, written(tmp_path, "c", rows))
    got = {r["request"]: r for r in T.claude_requests(lines).collect()}
    assert [got["r1"][c] for c in ("tokens_in", "tokens_out", "cached_in", "cache_write", "ts")] == [2412, 450, 1800, 600, "2024-05-01T04:30:00Z"]
    assert [got["r2"][c] for c in ("tokens_in", "tokens_out", "cached_in", "cache_write")] == [9000, 1500, 0, None]
    chat = T.claude_chats(lines).first()
    assert (chat["tokens_in"], chat["tokens_out"], chat["requests"], chat["raw_rows"], chat["project"]) == (11412, 1950, 2, 3, "/p")
    assert T.claude_names(lines).first()["name"] == "new"
    assert [(r["tool"], r["answer"]) for r in T.claude_tool_runs(lines).collect()] == [("Edit", "done")]
    assert [(r["path"], r["proposed"], r["context"]) for r in T.claude_edits(lines).collect()] == [("a.py", ["y", "z"], ["x"])]


def test_copilot_cli_counters_restart(spark, tmp_path):
    rows = [{"type": "session.shutdown", "timestamp": "2024-05-01T10:00:00Z", "data": {"modelMetrics": {"m": {"usage": {"inputTokens": n, "outputTokens": n}}}}} for n in (10, 15, 15, 4)]
    rows += [{"type": "tool.execution_start", "data": {"toolCallId": "a"}}, {"type": "tool.execution_start", "data": {"toolCallId": "b"}}, {"type": "tool.execution_complete", "data": {"toolCallId": "a", "ok": True}}]
    lines = T.numbered_lines(spark, written(tmp_path, "k", rows))
    assert [r[0] for r in T.copilot_cli_deltas(lines).orderBy("line_no").select("tokens_in_delta").collect()] == [10, 5, 0, 4]
    assert [r["call"] for r in T.copilot_cli_tool_runs(lines).collect()] == ["a"]


def test_copilot_vscode_last_state_wins(spark, tmp_path):
    def request(n, ext="GitHub.copilot-chat", **more):
        return {"requestId": f"q{n}", "timestamp": 1714557600123, "modelId": "copilot/auto", "agent": {"extensionId": ext}, **more}

    rows = [{"kind": 0, "v": {"sessionId": "s", "requests": [request(1, promptTokens=1)]}}, {"kind": 1, "k": ["title"], "v": "t"}]
    rows += [{"kind": 2, "k": ["requests"], "v": [request(1, promptTokens=25343, completionTokens=95), request(2, ext="other.chat", promptTokens=7)]}, {"kind": 2, "k": ["inputs"], "v": [1]}]
    got = T.copilot_vscode_requests(T.numbered_lines(spark, written(tmp_path, "v", rows))).collect()
    assert [(r["request"], r["tokens_in"], r["tokens_out"], r["provider"], r["credits"], r["ts"]) for r in got] == [("q1", 25343, 95, "", None, "2024-05-01T10:00:00.123Z")]


def test_other_logs(spark, tmp_path):
    kiro = T.kiro_ide_calls(T.numbered_lines(spark, written(tmp_path, "i", [{"promptTokens": 5, "generatedTokens": 0}] * 2 + [{"other": 1}])))
    assert kiro.count() == kiro.select("id").distinct().count() == 2
    side = T.copilot_sidecar(T.numbered_lines(spark, written(tmp_path, "s", [{"turnId": "t", "ts": "2024-05-01 10:00:00", "inputTokens": 3}, {"no": "turn"}]))).collect()
    assert [(r["request"], r["tokens_in"], r["ts"]) for r in side] == [("t", 3, "2024-05-01T10:00:00Z")]
    debug = T.copilot_debug_log(T.numbered_lines(spark, written(tmp_path, "d", [{"type": "llm_request", "spanId": "x", "attrs": {"inputTokens": 4, "prompt": "secret"}}, {"type": "else"}]))).collect()
    assert [(r["request"], r["tokens_in"], r["tokens_out"]) for r in debug] == [("x", 4, 0)] and "prompt" not in debug[0].asDict()
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"source_file": "b"}, {"source_file": "a"}, {"source_file": "b"}, {"source_file": ""}]}))
    assert sorted(r[1] for r in T.graph_files(spark, str(tmp_path / "g.json")).collect()) == ["a", "b"]
    stream = 'data: {"message": {"model": "m", "usage": {"input_tokens": 8, "output_tokens": 1}}}\n\ndata: {"usage": {"output_tokens": 5}}\ndata: [DONE]'
    bodies = spark.createDataFrame([(1, stream), (2, '{"model": "g", "usage": {"prompt_tokens": 2, "completion_tokens": 3}}'), (3, ""), (4, None)], "n int, body string")
    assert [tuple(r)[2:] for r in T.response_usage(bodies).orderBy("n").collect()] == [("m", 8, 5), ("g", 2, 3), (None, None, None), (None, None, None)]


def test_scalars(spark):
    def values(rows, f):
        return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").orderBy("k").select(f(F.col("v"))).collect()]

    assert values(["90", "90m", "2h", "1h30m", "0", "", "x", None], S.duration_minutes) == [90, 90, 120, 90, None, None, None, None]
    assert values(["d/{a => b}/f.py", "d/{a => }/f.py", "a => b", "plain"], S.rename_target) == ["d/b/f.py", "d/f.py", "b", "plain"]
    assert values(["\x1b[31mred\x1b[0m"], S.strip_ansi) == ["red"]
    assert values(["GPT-5", "claude-3", "gemini", "copilot/auto"], S.provider_of) == ["openai", "anthropic", "google", ""]
    assert values(["12", "123456", "1234567890", "x" * 14], S.token_estimate) == [0, 2, 2, 4]
    assert command_words("A=1 tool query x; cd d && tool explain y | grep z") == ["tool", "cd", "tool", "grep"] and command_words("a 'b") == []
    assert cut({"a": [1, 2, 3], "b": "xyz"}, 2, 2) == {"a": [1, 2, "…+1 more"], "b": "xy…(+1 chars)"}


def test_interval_join_over_days_and_ties(spark):
    def at(day, hour):
        return dt.datetime(2024, 1, day, hour)

    commits = spark.createDataFrame([("b", at(3, 5)), ("a", at(3, 5)), ("c", at(9, 1))], "sha string, ts timestamp_ntz")
    events = spark.createDataFrame([(1, at(1, 0)), (2, at(3, 5)), (3, at(3, 6)), (4, at(7, 0)), (5, at(9, 2)), (6, None)], "id int, ts timestamp_ntz")
    w = joins.windows_of(commits)
    assert sorted((r["sha"], r["lo"], r["hi"]) for r in w.collect() if r["lo"]) == [("b", at(3, 5), at(3, 5)), ("c", at(3, 5), at(9, 1))]
    assert {r["id"]: r["sha"] for r in joins.interval_join(events, w).collect()} == {1: "a", 2: "a", 3: "c", 4: "c", 5: None, 6: None}
    assert [r["sha"] for r in joins.interval_join(events, w.where("false")).collect()] == [None] * 6


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 97 % 30000).alias("ts"), (F.col("id") % 3).cast("string").alias("agent"), (F.col("id") % 5).alias("session"), F.col("id").alias("tokens_in"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = windows.late(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "1 day")
    for name, view in {"t": lambda x: windows.tumbling(x, "1 hour"), "s": lambda x: windows.sliding(x, "1 hour", "30 minutes")}.items():
        q = view(stream).writeStream.format("memory").queryName(f"q_{name}").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(f"q_{name}").collect())) == sorted(map(str, view(table).collect()))


def test_copilot_cli_bills_once(spark, tmp_path):
    def shutdown(credits, nano, **models):
        return {"type": "session.shutdown", "timestamp": "2024-05-01T10:00:00Z", "data": {"totalPremiumRequests": credits, "totalNanoAiu": nano, "modelMetrics": {m: {"usage": {"inputTokens": n, "outputTokens": 1, "cacheWriteTokens": w}} for m, (n, w) in models.items()}}}

    rows = [shutdown(2, 10, a=(15553, 7), b=(800, 0)), shutdown(2.33, 30, a=(15553, 9), b=(900, 0)), shutdown(3, 30), {"type": "session.shutdown", "data": {"modelMetrics": {"a": {"usage": {"inputTokens": 15554}}}}}, shutdown(0.5, 5, a=(1, 1), b=(1, 1))]
    got = {(r["line_no"], r["model"]): r for r in T.copilot_cli_deltas(T.numbered_lines(spark, written(tmp_path, "b", rows))).collect()}
    bill = lambda n, m: tuple(None if v is None else round(v, 6) if not isinstance(v, str) else v for v in (got[n, m][c] for c in ("credits", "premium", "nano_aiu", "billed_with", "cache_write_delta")))
    assert bill(0, "a") == (2.0, 2, 10.0, None, 7) and bill(0, "b") == (None, None, None, "a", 0)
    assert bill(1, "b") == (0.33, 0, 20.0, None, 0) and bill(1, "a") == (None, None, None, None, 2)
    assert bill(2, "copilot/unknown")[:3] == (0.67, 1, 0.0) and bill(3, "a")[:4] == (None,) * 4
    assert bill(4, "b")[:4] == (0.5, 0, 5.0, None) or bill(4, "a")[:4] == (0.5, 0, 5.0, None)
    assert len(got) == 8


def test_copilot_vscode_totals_and_names(spark, tmp_path):
    totals = [{"model": "m", "inputTokens": 9, "cachedTokens": 4, "outputTokens": 2}, {"modelId": "n", "cachedTokens": 3}]
    ask = {"kind": 2, "k": ["requests"], "v": [{"requestId": "q", "sessionCopilotCredits": 1.5, "elapsedMs": 70, "timeSpentWaiting": 6, "modelTotals": totals, "response": [{"x": 1}, {"generatedTitle": "made"}]}, {"requestId": "p", "response": [{"generatedTitle": "later"}]}]}
    lines = T.numbered_lines(spark, written(tmp_path, "t", [ask]))
    got = {r["request"]: r for r in T.copilot_vscode_requests(lines).collect()}
    assert [got["q"][c] for c in ("session_credits", "elapsed_ms", "waiting_ms", "cached_in")] == [1.5, 70, 6, 7] and got["p"]["cached_in"] == 0
    assert [tuple(t) for t in got["q"]["model_totals"]] == [("m", 9, 4, 2), ("n", 0, 3, 0)] and got["p"]["model_totals"] == []
    titled = [{"kind": 0, "v": {"customTitle": "first"}}, {"kind": 1, "k": ["customTitle"], "v": "mine"}, {"kind": 1, "k": ["customTitle"], "v": ""}, ask]
    assert [T.copilot_vscode_names(x).first()["name"] for x in (lines, T.numbered_lines(spark, written(tmp_path, "u", titled)), T.numbered_lines(spark, written(tmp_path, "e", [{"kind": 1, "k": ["x"], "v": "y"}])))] == ["made", "mine", ""]
    for k, text in enumerate(["id: 1\nname: 'A b: c'\nuser_named: false\n", "name:\nother: x\n", "id: 2\n"]):
        (tmp_path / f"w{k}").mkdir()
        (tmp_path / f"w{k}" / "workspace.yaml").write_text(text)
    assert [r["name"] for r in T.copilot_cli_names(spark, str(tmp_path)).orderBy("file").collect()] == ["A b: c", "", ""]
