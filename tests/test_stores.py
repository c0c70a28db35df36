import json
import sqlite3

from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators import attribution, fold
from loglattice.sources import gitlog, sqlite


def test_copilot_spans(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "agent-traces.db")
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("CREATE TABLE spans (span_id, conversation_id, chat_session_id, response_model, request_model, input_tokens, output_tokens, cached_tokens, ttft_ms, start_time_ms, operation_name)")
    rows = [("a", None, "s", None, "gpt", 10, 2, 3, 40, 1714557600123, "chat"), ("b", "c", "s", "m", "gpt", 0, 0, 0, 1, 1, "chat"), ("d", "c", None, "m", None, "odd", 5, None, None, None, "chat"), ("e", "c", None, "m", None, 9, 9, 9, 9, 9, "tool"), (None, "c", None, "m", None, 9, 9, 9, 9, 9, "chat")]
    con.executemany("INSERT INTO spans VALUES (?,?,?,?,?,?,?,?,?,?,?)", rows)
    con.commit()
    con.close()
    (tmp_path / "not-a-store.db").write_bytes(b"nothing of the kind")
    got = sorted((tuple(r)[1:] for r in sqlite.copilot_spans(spark, str(tmp_path)).collect()))
    assert got == [("a", "s", "gpt", 10, 2, 3, 40, "2024-05-01T10:00:00.123Z"), ("d", "c", "m", 0, 5, 0, 0, "")]


def test_kiro_conversations(spark, tmp_path):
    turn = lambda pct, **k: {"request_metadata": {"message_id": "m1", "context_usage_percentage": pct, "request_start_timestamp_ms": 1714557600000, "time_between_chunks": [1, 2], "user_prompt_length": 7, "response_size": 9, **k}}
    use = {"assistant": {"ToolUse": {"tool_uses": [{"id": "t", "name": "shell", "args": {"command": "ls"}}, {"id": "u", "name": "shell", "args": {}}]}}}
    done = {"user": {"content": {"ToolUseResults": {"tool_use_results": [{"tool_use_id": "t", "content": [{"text": "out"}]}]}}}}
    new = {"history": [turn(3.5) | use, turn(None) | done, turn(8.25, uncached_input_tokens=11)], "model_info": {"model_id": "auto"}, "user_turn_metadata": {"usage_info": [{"unit": "credit", "value": 1.5}, {"unit": "credits", "value": 0.25}, {"unit": "other", "value": 9}]}}
    old = {"conversation_id": "old", "history": []}
    con = sqlite3.connect(tmp_path / "data.sqlite3")
    con.execute("CREATE TABLE conversations_v2 (key, conversation_id, value, created_at, updated_at)")
    con.execute("CREATE TABLE conversations (key, value)")
    con.executemany("INSERT INTO conversations_v2 VALUES (?,?,?,?,?)", [("/w/app", "c1", json.dumps(new), 1, 1714557600000), ("/other", "c2", json.dumps(new), 1, None), ("/w", "bad", "{broken", 1, 1)])
    con.execute("INSERT INTO conversations VALUES ('/w/app', ?)", (json.dumps(old),))
    con.commit()
    con.close()
    every = sqlite.kiro_conversations(spark, str(tmp_path))
    assert sorted(r.session for r in every.collect()) == ["c1", "c2", "old"]
    some = sqlite.kiro_conversations(spark, str(tmp_path), workspace="/w")
    chat = sqlite.kiro_chats(some).collect()
    assert [(r.session, r.project, r.model, r.turns, r.credits, r.context_pct, r.ts) for r in chat] == [("c1", "app", "auto", 3, 1.75, 8.25, "2024-05-01T10:00:00.000Z")]
    assert [r.credits for r in fold.credits_of(sqlite.kiro_chats(some)).collect()] == [1.75]
    turns = sorted(sqlite.kiro_turns(some).collect(), key=lambda r: r.turn)
    assert [(r.turn, r.tokens_in, r.context_pct, r.chunks, r.prompt_bytes) for r in turns] == [(0, None, 3.5, 2, 7), (1, None, 0.0, 2, 7), (2, 11, 8.25, 2, 7)]
    assert [(r.session, r.tool_use_id, r.tool, r.answer) for r in sqlite.kiro_tool_runs(some).collect()] == [("c1", "t", "shell", "out")]


LOG = """commit aaaa1111 2024-05-01T12:00:00+02:00

3\t1\tsrc/{old => new}/a.py
-\t-\timage.png

diff --git a/src/old/a.py b/src/new/a.py
--- a/src/old/a.py
+++ b/src/new/a.py
@@ -1,2 +1,3 @@
+first line
-gone line
+++ not a header
 same
commit bbbb2222 2024-05-02T12:00:00Z

0\t2\tgone.py
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-x
-y
"""


def test_git_logs(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    path = str(tmp_path)
    assert sorted(map(tuple, gitlog.commits(spark, path).collect())) == [("aaaa1111", "2024-05-01T10:00:00Z"), ("bbbb2222", "2024-05-02T12:00:00Z")]
    assert sorted(map(tuple, gitlog.numstat(spark, path).collect()), key=str) == [("aaaa1111", "image.png", None, None), ("aaaa1111", "src/new/a.py", 3, 1), ("bbbb2222", "gone.py", 0, 2)]
    lines = gitlog.added_lines(spark, path)
    assert sorted(r.line for r in lines.where("sha = 'aaaa1111'").collect())[-1] == "first line" and lines.where("sha = 'bbbb2222'").count() == 0
    proposed = spark.createDataFrame([("aaaa1111", "src/new/a.py", "first  line ")], "sha string, path string, line string")
    normal = lambda d: d.withColumn("line", S.normalize_line(F.col("line")))
    binary = gitlog.numstat(spark, path).where("added is null")
    got = {r.path: r.verdict for r in attribution.match_files(normal(proposed), normal(lines), binary, ["sha"]).collect()}
    assert got["src/new/a.py"] == "kept" and got["image.png"] == "unreadable"
