"""Runs of a tool in chats and shells, receipts filed once, keyed tables and retention in place."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglattice.functions.udtfs import ToolRuns, tool_runs
from loglattice.operators import toolruns
from loglattice.sources import keyed, store


@pytest.mark.parametrize("command, want", [
    ("graph query x", [("query", ["graph", "query", "x"])]), ("A=1 B=2 /opt/graph explain 'a b'", [("explain", ["/opt/graph", "explain", "a b"])]), ("cd d && graph path a b", [("path", ["graph", "path", "a", "b"])]),
    ("grep graph query", []), ("echo graph query", []), ("cat f | grep graph", []), ("graph build", []), ("graph", []), ("A=1", []), ("", []), (None, []), ("graph query 'open", []), ("graphs query x", []),
    ("graph --json query x; graph explain y", [("query", ["graph", "--json", "query", "x"]), ("explain", ["graph", "explain", "y"])]), ("(graph query x)", []), ("sudo graph query x", []),
])
def test_a_run_stands_at_command_position(command, want):
    assert list(tool_runs(command, "graph", frozenset(toolruns.VERBS))) == want


def test_the_table_function_in_sql(spark):
    spark.udtf.register("tool_runs", ToolRuns)
    spark.createDataFrame([(1, "graph query x && graph explain y"), (2, "grep graph"), (3, None)], "id int, command string").createOrReplaceTempView("ran")
    got = spark.sql("SELECT id, op, argv FROM ran, LATERAL tool_runs(command, 'graph', array('query', 'explain')) ORDER BY op").collect()
    assert [tuple(r) for r in got] == [(1, "explain", ["graph", "explain", "y"]), (1, "query", ["graph", "query", "x"])]


def part(command, **more):
    data = {"commandLine": {"original": command}, "cwd": {"path": "/w"}, "terminalCommandState": {"exitCode": 0}}
    return {"kind": "toolInvocationSerialized", "toolId": "run_in_terminal", "toolSpecificData": {**data, **more.pop("data", {})}, **more}


def test_parts_of_all_three_carriers(spark):
    read = {"kind": "toolInvocationSerialized", "toolId": "copilot_readFile", "invocationMessage": {"uris": {"u": {"path": "/w/graph-out/GRAPH_REPORT.md"}, "v": {"path": "/w/src/a.py"}}}}
    text = {"kind": "markdownContent", "value": "no part"}
    log = [
        {"kind": 0, "v": {"sessionId": "s1", "requests": [{"response": [text, part("one", resultDetails={"output": [{"value": "a"}, {"x": 1}, {"value": "b"}]})]}, {"response": None}]}},
        {"kind": 2, "k": ["requests"], "v": [{"response": [part("two", data={"terminalCommandOutput": {"text": "\x1b[31mred\x1b[0m"}})]}]},
        {"kind": 2, "k": ["requests", 3, "response"], "v": [part("failed", data={"terminalCommandState": {"exitCode": 1}}), part("silent"), read]},
        {"kind": 1, "k": ["customTitle"], "v": "t"}, {"kind": 2, "k": ["requests", 0, "result"], "v": [part("elsewhere")]}, {"kind": 1, "k": [], "v": None},
    ]
    lines = spark.createDataFrame([("f", k, json.dumps(x)) for k, x in enumerate(log)], "file string, line_no int, line string")
    got = {r.command: (r.session, r.cwd, r.answer) for r in toolruns.vscode_terminal_runs(lines).collect()}
    assert got == {"one": ("s1", "/w", "a\nb"), "two": ("s1", "/w", "red"), "failed": ("s1", "/w", None), "silent": ("s1", "/w", None)}
    assert [tuple(r) for r in toolruns.vscode_reads(lines, "graph-out").collect()] == [("s1", "/w/graph-out/GRAPH_REPORT.md", "/w")]


def test_receipts_of_runs_and_of_reports(spark):
    at = lambda day: datetime(2024, 5, day)
    corpus = spark.createDataFrame([("/w/a", at(1), 100), ("/w/a", at(3), 500), ("/b", at(9), 40), ("/w/graph-out/GRAPH_REPORT.md", at(1), 30)], "path string, revision timestamp, tokens long")
    cite = "NODE x [src=a loc=L1]\nNODE y [src=a loc=L2]\nNODE z [src=/b loc=L1]"
    run = lambda s, op, q, answer, day: (s, op, ["graph", op, q], answer, "/w", at(day))
    rows = [run("s", "query", "q", cite, 2), run("s", "query", "q", cite + "\n", 4), run("s", "query", "late", cite, 4), run("s", "path", "p", cite, 2), run("s", "explain", "e", "Source: /b L3\n" + "long " * 100, 2), run("t", "query", "q", cite, 2), run("s", "query", "none", None, 2)]
    runs = spark.createDataFrame(rows, "session string, op string, argv array<string>, answer string, cwd string, ts timestamp")
    none = spark.createDataFrame([], "id string")
    filed, counts = toolruns.receipts(runs, corpus, none)
    assert sorted((r.session, r.raw_alternative, r.actual, r.source_files) for r in filed.collect()) == [("s", 140, 16, 3), ("s", 540, 16, 3), ("t", 140, 16, 3)]
    assert {r.outcome: (r.runs, r.logged) for r in counts.collect()} == {"receipt": (3, 4), "unmeasurable": (2, 2)}
    again, counts = toolruns.receipts(runs, corpus, filed.select("id"))
    assert again.count() == 0 and {r.outcome: r.runs for r in counts.collect()} == {"known": 3, "unmeasurable": 2}
    other = spark.createDataFrame([("", "query", ["/x/graph", "query", "q"], cite, "/w", at(1))], runs.schema)
    shim, _ = toolruns.receipts(other, corpus, none)
    left, counts = toolruns.receipts(runs, corpus, shim.select("id"))
    assert left.count() == 1 and {r.outcome: r.runs for r in counts.collect()} == {"deferred": 2, "receipt": 1, "unmeasurable": 2}
    reads = spark.createDataFrame([("s", "/w/graph-out/GRAPH_REPORT.md", "/w")] * 2 + [("s", "/w/graph-out/wiki/x.md", "/w")], "session string, path string, repo string")
    graphs = spark.createDataFrame([("/w", 1700000000.25, 7, 900)], "repo string, revision double, files long, tokens long")
    got = toolruns.read_receipts(reads, graphs, corpus, none)
    assert [(r.raw_alternative, r.actual, r.saved, r.source_files, r.confidence) for r in got.collect()] == [(900, 30, 870, 7, 0.3)]
    assert toolruns.read_receipts(reads, graphs, corpus, got.select("id")).count() == 0


def stamps(root):
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, open(os.path.join(d, f), "rb").read()) for d, _, fs in os.walk(root) for f in fs if f.startswith("part-")}


def test_a_key_keeps_its_last_value_and_other_buckets_their_files(spark, tmp_path):
    root, kind = str(tmp_path / "cache"), "key string, value string, at int"
    put = lambda rows: keyed.upsert(spark.createDataFrame(rows, kind), root, "key", ["at"], 16)
    assert keyed.read(spark, root, kind).count() == 0
    put([(f"k{i}", "old", 1) for i in range(60)] + [(None, "none", 1)])
    before = stamps(root)
    put([("k7", "late", 0), ("k7", "new", 2), ("k7", "newer", 2)])
    put([])
    got = {r.key: r.value for r in keyed.read(spark, root, kind).collect()}
    assert len(got) == 60 and got["k7"] in ("new", "newer") and set(got.values()) == {"old", got["k7"]}
    after = stamps(root)
    assert sum(after.get(k) == v for k, v in before.items()) == len(before) - 1


def test_retention_in_place(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [("a", "2024-03-01T00:00:00Z"), ("b", "2024-04-01T00:00:00Z"), ("c", "2024-04-20T00:00:00Z"), ("d", "2024-05-01T00:00:00Z"), ("e", None)]
    store.append(spark.createDataFrame(rows, "id string, ts string").coalesce(1), root, "calls")
    before = {k: v for k, v in stamps(root).items() if "2024-05" in k or "undated" in k}
    assert store.retain(spark, root, "calls", "2024-04-10T00:00:00Z") == (1, 1)
    assert {r.id for r in store.scan(spark, root, "calls", "id string, ts string").collect()} == {"c", "d", "e"}
    assert {k: v for k, v in stamps(root).items() if k in before} == before
    assert store.retain(spark, root, "calls", "2024-04-10T00:00:00Z") == (0, 0)
    assert store.retain(spark, root, "calls", "2024-04-30T00:00:00Z") == (0, 1) and store.retain(spark, root, "none", "2024-04-30") == (0, 0)
