import json
import os
import time

import pytest
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.functions.udfs import cut
from loglattice.operators import attribution, ingest
from loglattice.sources import store
from loglattice.sources import transcripts as T

ROW = "id string, ts string, agent string, tokens_in bigint"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def test_append_scan_and_prune(spark, tmp_path):
    root = str(tmp_path / "ledger")
    assert store.scan(spark, root, "calls", ROW).count() == 0
    first = rows_of(spark, ("a", "2024-01-05T00:00:00Z", "x", 1), ("b", "2024-02-01T00:00:00Z", "x", 2), ("c", None, "y", 3))
    store.append_new(first, root, "calls")
    store.append_new(rows_of(spark, ("a", "2024-01-05T00:00:00Z", "x", 1), ("d", "2024-02-02T00:00:00Z", "x", 9), ("d", "2024-02-02T00:00:00Z", "x", 4)), root, "calls")
    store.append_new(rows_of(spark, ("a", "2024-01-05T00:00:00Z", "x", 1)), root, "consumer")
    got = lambda **k: sorted((r.id, r.tokens_in) for r in store.scan(spark, root, "calls", ROW, **k).collect())
    assert got() == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert got(since="2024-02-01T12:00:00Z") == [("c", 3), ("d", 4)]
    assert store.scan(spark, root, "consumer", ROW).count() == 1
    plan = store.scan(spark, root, "calls", ROW, since="2024-02-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters")[1]
    part = next(p for p in (tmp_path / "ledger" / "kind=calls" / "month=2024-02").iterdir() if p.suffix == ".json")
    (part.parent / "part-late.json").write_text('{broken\n\n{"id": "e", "ts": "2024-02-03T00:00:00Z", "tokens_in": "many"}\n{"id": "f", "ts": "2024-')
    assert ("e", None) in got() and len(got()) == 5
    kept = store.prune(spark, root, "calls", ROW, "2024-02-01", str(tmp_path / "kept"))
    assert sorted(r.id for r in kept.collect()) == ["b", "c", "d", "e"]
    assert store.tail(store.scan(spark, root, "calls", ROW), 1).first().id == "e"
    assert store.where_equal(first, agent="y").count() == 1 and store.where_equal(first, agent="").count() == 3


def test_savings_leave_other_folders_out(spark, tmp_path):
    for folder in ("graph", "calls"):
        os.makedirs(tmp_path / "s" / folder)
        (tmp_path / "s" / folder / "2024-01.jsonl").write_text('{"id": "r", "saved": 5}\n{cut')
    assert [tuple(r) for r in store.savings(spark, str(tmp_path / "s"), "id string, saved bigint").collect()] == [("graph", "r", 5)]


def test_sweeps_read_what_changed_and_add_what_is_new(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "ledger")
    logs.mkdir()

    def write(name, *rows, cut_off=False):
        (logs / name).write_text("\n".join(json.dumps({"id": i, "ts": "2024-01-01T00:00:00Z", "agent": "x", "tokens_in": n}) for i, n in rows) + ("\n{\"id\": \"la" if cut_off else ""))

    def parse(lines):
        return T.parsed(lines, ROW).select("row.*")

    def sweep(cursor=None, **k):
        added, cursor = ingest.sweep(spark, str(logs), parse, root, "calls", cursor, **k)
        cursor = spark.createDataFrame(cursor.collect(), cursor.schema) if cursor is not None else None
        return sorted(r.id for r in added.collect()), cursor

    write("a.jsonl", ("1", 1), ("2", 2), cut_off=True)
    write("b.jsonl", ("3", 3), ("1", 1))
    added, cursor = sweep()
    assert added == ["1", "2", "3"] and cursor.count() == 2
    assert sweep(cursor)[0] == []
    assert ingest.changed(ingest.listing(spark, str(logs)), cursor).count() == 0
    time.sleep(0.01)
    write("a.jsonl", ("1", 1), ("2", 2), ("last", 4))
    assert [r.file.rsplit("/", 1)[-1] for r in ingest.changed(ingest.listing(spark, str(logs)), cursor).collect()] == ["a.jsonl"]
    added, after = sweep(cursor)
    assert added == ["last"]
    added, same = sweep(cursor, rescan=True)
    assert added == [] and sorted(map(tuple, same.collect())) == sorted(map(tuple, cursor.collect()))
    assert sorted(r.id for r in store.scan(spark, root, "calls", ROW).collect()) == ["1", "2", "3", "last"]
    custom = ingest.restamp(rows_of(spark, ("z", None, "x", 1)), "tool", "ide").first()
    assert (custom.agent, custom.surface) == ("tool", "ide")
    assert ingest.due(None, 5.0) and not ingest.due(0.0, 59.0) and ingest.due(0.0, 60.0)


def test_scalars_of_the_views(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert show(S.basename(lit("file:///a/b%20c+d.py"))) == "b c+d.py" and show(S.basename(lit("/a/100%"))) == "100%"
    assert [show(S.cell(lit(v), k)) for v, k in ((1.5, "double"), (2.0, "double"), (0.0, "double"), (1e-9, "double"), (True, "boolean"), (7, "int"))] == ["1.5", "2", "0", "0", "true", "7"]
    assert show(S.cell(F.array(lit(1.0), lit(2.25)), "array<double>")) == "1;2.25" and show(S.cell(lit(None).cast("string"), "string")) == ""
    assert show(S.cell(F.create_map(lit("k"), lit(1)), "map<string,int>")) == '{"k":1}'
    assert [show(S.ago(lit(s))) for s in (-5, 89, 90, 5400, 172800)] == ["just now", "just now", "1m ago", "1h ago", "2d ago"]
    assert show(S.percent(lit(1), lit(3))) == "33%" and show(S.percent(lit(1), lit(0))) == "—" and show(S.thousands(lit(1234567.5))) == "1,234,568"
    assert show(S.first_number(lit(None).cast("string"), lit("nan"), lit("7"))) == 7
    assert show(S.relative_to(lit("/r/a/b"), lit("/r"))) == "a/b" and show(S.relative_to(lit("/rest/a"), lit("/r"))) is None
    assert show(S.under(lit("/r"), lit("/r"))) and not show(S.under(lit("/rx"), lit("/r")))
    assert show(S.result_text(lit('[{"type": "text", "text": "a"}, {"content": "b"}, {"type": "image"}]'))) == "a\nb" and show(S.result_text(lit("plain"))) == "plain" and show(S.result_text(lit('{"a": 1}'))) == ""
    a, b = (show(S.content_signature(F.array(lit(p), lit("query"), lit("x")), lit(t))) for p, t in (("tool", "done"), ("/bin/tool", " done ")))
    assert a == b and len(a.args_hash) == 16
    null = lit(None).cast("double")
    cells = [show(S.hours(*c, 100)) for c in ((lit(50), lit(20), lit(90.0)), (null, lit(1), null), (lit(50), null, null), (lit(101), lit(1), null), (lit(72), lit(36), null))]
    assert [tuple(c) for c in cells] == [(1.5, "attested", ""), (None, None, "no-wall"), (None, None, "no-agent-span"), (None, None, "gap-too-wide"), (0.01, "estimated", "")]


def test_calls_find_their_commits(spark):
    commits = spark.createDataFrame([("aaaa1111", 100), ("bbbb2222", 200)], "sha string, t int").select("sha", F.timestamp_seconds("t").alias("ts"))
    tasks = spark.createDataFrame([("T1", "bb", 0, "ok"), ("T2", "dead", 0, "ok"), ("T3", "aaaa", 2, "ok"), ("T4", "", 0, "ok"), ("T5", "aaaa", 0, "")], "task string, commit string, files_changed int, outcome string")
    clean, dirty = attribution.trusted_commits(tasks)
    assert clean.count() == 2 and dirty.first().dirty_tasks == 1
    trusted = spark.createDataFrame([("claude", None, True), ("kiro", None, False), ("kiro", "cli", True)], "agent string, surface string, joinable boolean")
    rows = [(1, 50, "T1", "x", "", ""), (2, 50, "T2", "claude", "", "p"), (3, 50, None, "claude-code", "", "p"), (4, 150, "T3", "kiro", "cli", "p"), (5, 150, None, "kiro", "ide", "p"), (6, 150, None, "claude", "", ""), (7, 150, None, "claude", "", "q"), (8, 250, None, "claude", "", "p"), (9, None, None, "claude", "", "p"), (10, 150, "T5", "claude", "", "p"), (11, 150, "T9", "claude", "", "p"), (12, 40, "T1", "x", "", ""), (13, 45, None, "claude", "", "p")]
    calls = spark.createDataFrame(rows, "id int, t int, task string, agent string, surface string, project string").withColumn("session", F.when(F.col("id").isin(1, 12, 13), "s")).withColumn("ts", F.timestamp_seconds("t")).withColumn("tokens_in", F.lit(1)).withColumn("tokens_out", F.lit(2))
    got = {r.id: (r.sha, r.via, r.reason) for r in attribution.commit_join(calls, commits, clean, trusted, "p").collect()}
    assert got == {
        1: ("bbbb2222", "task", None), 2: (None, None, "dangling-task"), 3: ("aaaa1111", "window", None), 4: ("bbbb2222", "window", None), 5: (None, None, "no-ts-fidelity"),
        6: (None, None, "no-project"), 7: (None, None, "other-project"), 8: (None, None, "after-head"), 9: (None, None, "after-head"),
        10: ("bbbb2222", "window", None), 11: ("bbbb2222", "window", None), 12: ("bbbb2222", "task", None), 13: ("bbbb2222", "task", None),
    }
    assert [tuple(r) for r in attribution.excluded(attribution.commit_join(calls, commits, clean, trusted, "p")).collect()][0] == ("after-head", 2, 6)


def test_files_and_what_is_left(spark):
    line = "sha string, path string, line string"
    p = spark.createDataFrame([("c", "kept", "long one"), ("c", "part", "long one"), ("c", "part", "other line"), ("c", "gone", "never landed"), ("c", "kept", "}")], line)
    a = spark.createDataFrame([("c", "kept", "long one"), ("c", "kept", "}"), ("c", "part", "long one"), ("c", "part", "by a person"), ("c", "new", "by a person")], line)
    m = attribution.match_files(p, a, spark.createDataFrame([("c", "image")], "sha string, path string"), ["sha"])
    got = {r.path: (r.verdict, r.suggested, r.kept, r.added, r.added_gated) for r in m.collect()}
    assert got == {"kept": ("kept", 1, 1, 2, 1), "part": ("landed-modified", 2, 1, 2, 0), "gone": ("dropped", 1, 0, 0, 0), "new": ("not-proposed", 0, 0, 1, 0), "image": ("unreadable", 0, 0, 0, 0)}
    assert tuple(attribution.residual(m, ["sha"]).first()) == ("c", 2, 1)


@pytest.mark.parametrize("depth", [3, 5000])
def test_json_is_cut_however_deep(depth):
    deep = "x" * 300
    for _ in range(depth):
        deep = [deep]
    assert cut({"a": list(range(25)), "b": "y" * 201}) == {"a": [*range(20), "…+5 more"], "b": "y" * 200 + "…(+1 chars)"}
    out = cut(deep)
    for _ in range(depth):
        out = out[0]
    assert out == "x" * 200 + "…(+100 chars)"
