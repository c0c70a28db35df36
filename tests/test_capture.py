"""Capture as a stream: every row once whatever is killed, one writer a batch, grown files read again, sessions replaced alone."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators import authorship
from loglattice.sources import gitlog, log_source, transcripts
from loglattice.sources.published import AlreadyPublished, Ledger
from loglattice.streaming import capture


def turn(session, request, at, tokens, model="m1", **more):
    usage = {"input_tokens": tokens, "output_tokens": 7}
    return json.dumps({"type": "assistant", "uuid": request, "requestId": request, "sessionId": session, "timestamp": at, "message": {"id": request, "model": model, "usage": usage, **more.pop("message", {})}, **more}) + "\n"


def calls(lines):
    rows = transcripts.claude_requests(lines)
    return rows.select(S.short_id("c_", F.col("session"), F.col("request")).alias("id"), "ts", "session", "request", "tokens_in")


ROWS = "id string, ts string, session string, request string, tokens_in bigint"


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text(turn("a", "r1", "2024-05-01T10:00:00Z", 10) + "not json\n" + turn("a", "r2", "2024-06-01T10:00:00Z", 20))
    return tmp_path


def captured(spark, logs, **more):
    return capture.Capture(spark, str(logs / "logs"), str(logs / "ledger"), str(logs / "checkpoint"), {"calls": calls}, **more)


def seen(spark, logs):
    return sorted((r.request, r.tokens_in, r.batch) for r in Ledger(spark, str(logs / "ledger")).scan("calls", ROWS).collect())


def test_each_row_once_through_kills_growth_and_cut_lines(spark, logs):
    def killed(batch):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        captured(spark, logs, before_publish=killed).run()
    assert seen(spark, logs) == []
    captured(spark, logs).run()
    assert seen(spark, logs) == [("r1", 10, 0), ("r2", 20, 0)]
    captured(spark, logs).run()  # nothing has changed
    half = turn("a", "r4", "2024-06-02T10:00:00Z", 40)
    with open(logs / "logs" / "a.jsonl", "a") as f:
        f.write(turn("a", "r3", "2024-05-03T10:00:00Z", 30) + half[:40])
    with pytest.raises(Exception, match="killed"):
        captured(spark, logs, before_publish=killed).run()
    captured(spark, logs).run()
    assert seen(spark, logs) == [("r1", 10, 0), ("r2", 20, 0), ("r3", 30, 1)]
    with open(logs / "logs" / "a.jsonl", "a") as f:
        f.write(half[40:])
    captured(spark, logs).run()
    assert [x[0] for x in seen(spark, logs)] == ["r1", "r2", "r3", "r4"]
    ledger = Ledger(spark, str(logs / "ledger"))
    assert [r.request for r in ledger.scan("calls", ROWS, since="2024-06-01T00:00:00Z").orderBy("request").collect()] == ["r2", "r4"]
    staged = logs / "ledger" / "_staged"
    ledger.sweep_staged()
    assert not staged.exists()


def test_killed_between_publishing_and_the_checkpoint(spark, logs):
    captured(spark, logs).run()
    commits = logs / "checkpoint" / "commits"
    for name in ("0", ".0.crc"):
        os.remove(commits / name)
    captured(spark, logs).run()
    assert seen(spark, logs) == [("r1", 10, 0), ("r2", 20, 0)]


def test_two_writers_cannot_both_publish(spark, logs):
    captured(spark, logs).run()
    other = capture.Capture(spark, str(logs / "logs"), str(logs / "ledger"), str(logs / "other"), {"calls": calls})
    with pytest.raises(Exception, match="of another writer"):
        other.run()
    # Both past the first look: the move decides.
    rows = spark.createDataFrame([("x", "2024-05-01T00:00:00Z", "s", "q", 1)], ROWS)
    ledger, results, gate = Ledger(spark, str(logs / "race")), [], threading.Barrier(2)
    look = ledger.batches

    class Racing(Ledger):
        def batches(self):
            got = look()
            gate.wait(60) if not got else None
            return got

    def write(name):
        try:
            results.append((name, Racing(spark, str(logs / "race")).publish(0, name, {"calls": rows})))
        except AlreadyPublished:
            results.append((name, None))

    threads = [threading.Thread(target=write, args=(n,)) for n in ("one", "two")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(x[1] is True for x in results) == [False, True] and {x[1] for x in results} == {True, None}
    assert Ledger(spark, str(logs / "race")).scan("calls", ROWS).count() == 1


def test_edits_wait_in_the_ledger_for_their_commit(spark, logs):
    edit = {"message": {"content": [{"type": "tool_use", "name": "Write", "id": "t1", "input": {"file_path": "/repo/a.py", "content": "a line of its own\nanother"}}]}}
    (logs / "logs" / "a.jsonl").write_text(turn("s1", "r1", "2024-05-02T10:00:00Z", 5, **edit))
    git = logs / "logs" / "repo.gitlog"
    git.write_text("commit aaaa111 2024-05-01T00:00:00Z\n\n")

    def edits(lines):
        e = transcripts.claude_edits(lines.where("file like '%.jsonl'"))
        return e.select("id", "session", "ts", "path", F.col("proposed").alias("lines"), "context")

    flow = captured(spark, logs, glob="*.jsonl,*.gitlog", authored=(edits, "/repo", lambda: gitlog.commit_log(spark, str(git))))
    flow.run()
    ledger = flow.ledger
    assert ledger.scan("provenance", authorship.ROW).count() == 0 and ledger.newest("pending", authorship.EDIT).count() == 1
    git.write_text("commit bbbb222 2024-05-03T00:00:00Z\n\n1\t0\ta.py\ndiff --git a/a.py b/a.py\n--- /dev/null\n+++ b/a.py\n@@ -0,0 +1 @@\n+a line of its own\ncommit aaaa111 2024-05-01T00:00:00Z\n\n")
    flow.run()
    row = ledger.scan("provenance", authorship.ROW).collect()
    assert [(r.sha, r.session, r.files, r.suggested, r.kept, r.kept_modified) for r in row] == [("bbbb222", "s1", ["a.py"], 2, 1, 1)]
    assert ledger.newest("pending", authorship.EDIT).count() == 0
    os.utime(logs / "logs" / "a.jsonl")
    flow.run()
    assert ledger.scan("provenance", authorship.ROW).count() == 1


def test_only_the_touched_session_is_folded_again(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "chats")
    for s in ("a", "b", "c"):
        os.makedirs(logs / s / "subagents")
        (logs / f"{s}.jsonl").write_text(turn(s, "r1", "2024-05-01T10:00:00Z", 10) + turn(s, "r1", "2024-05-01T10:00:01Z", 12))

    def fold(lines):
        return transcripts.claude_chats(lines).join(lines.select(F.get_json_object("line", "$.sessionId").alias("session"), "main").distinct(), "session")

    def read():
        return {r.session: (r.tokens_in, r.requests, r.raw_rows, {k: v.tokens_in for k, v in r.model_totals.items()}) for r in spark.read.parquet(root).collect()}

    every = spark.createDataFrame([(str(logs / f"{s}.jsonl"),) for s in "abc"], "file string")
    assert capture.refold(spark, str(logs), every, fold, root) == 3
    assert read() == {s: (12, 1, 2, {"m1": 12}) for s in "abc"}
    stamps = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}
    new = logs / "b" / "subagents" / "agent-1.jsonl"
    new.write_text(turn("b", "r2", "2024-05-01T11:00:00Z", 100, model="m2", isSidechain=True))
    assert capture.refold(spark, str(logs), spark.createDataFrame([(str(new),)], "file string"), fold, root) == 1
    assert read() == {"a": (12, 1, 2, {"m1": 12}), "b": (112, 2, 3, {"m1": 12, "m2": 100}), "c": (12, 1, 2, {"m1": 12})}
    now = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}
    assert sum(1 for k, v in stamps.items() if now.get(k) == v) == 2 and len(now) == 3


def test_the_source_reads_only_files_asked_for_and_never_a_whole_log(spark, tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"{k}.jsonl").write_text("".join(f'{{"k": {j}}}\n' for j in range(100)) + '{"cut')
    (tmp_path / "bad.jsonl").write_bytes(b'{"k": "\xff"}\n\n  \n{"whole": 1}')
    log_source.register(spark)
    df = spark.read.format("agent_logs").option("path", str(tmp_path)).option("taskBytes", "2000").load()
    assert df.count() == 502 and df.rdd.getNumPartitions() >= 3
    one = spark.read.format("agent_logs").option("path", str(tmp_path)).option("pushdown", "true").load().where(F.col("file") == str(tmp_path / "3.jsonl"))
    assert df.where(F.col("file") == str(tmp_path / "3.jsonl")).count() == 100 and df.count() == 502
    assert one.count() == 100 and one.rdd.getNumPartitions() == 1 and one.agg(F.max("line_no")).first()[0] == 99
    monkeypatch.setattr(log_source, "BATCH_LINES", 10)
    sizes = [b.num_rows for b in log_source.read_lines([str(tmp_path / "3.jsonl"), str(tmp_path / "gone.jsonl")])]
    assert sizes == [10] * 10
