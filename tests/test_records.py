import json

import pytest

from loglattice.operators import joins
from loglattice.sources import homes, records
from loglattice.sources.published import AlreadyPublished, Ledger

ID = "id string, ts string, tool string, n bigint"


def put(root, path, *rows):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_one_kind_in_two_homes(spark, tmp_path):
    put(tmp_path, "ledger/provenance.jsonl", {"id": "a", "ts": "2024-01-03T00:00:00Z", "n": 1}, "", "{broken", {"id": "b", "n": "no number"})
    put(tmp_path, "ledger/provenance/provenance-2024-03.jsonl", {"id": "c", "ts": "2024-03-03T00:00:00Z"}, '{"id": "cut o')
    put(tmp_path, "ledger/provenance/provenance-2024-05.jsonl", {"id": "d", "ts": "2024-05-03T00:00:00Z"})
    put(tmp_path, "ledger/imports.jsonl", {"id": "old"}, {"id": "old"})
    put(tmp_path, "state/imports.jsonl", {"id": "new"})
    read = lambda *a: sorted((r.id, r.home, r.n) for r in homes.read_kind(spark, str(tmp_path), *a).collect())
    assert read("provenance", ID) == [("a", 0, 1), ("b", 0, None), ("c", 1, None), ("d", 1, None)]
    # The old file is opened whatever is asked for, the month before is not; rows without a time stay.
    assert read("provenance", ID, "2024-05-01") == [("b", 0, None), ("d", 1, None)]
    assert "provenance-2024-03" not in str(homes._files(spark, str(tmp_path), "ledger/provenance/provenance*.jsonl", "2024-05-01"))
    assert read("imports", ID) == [("new", 1, None), ("old", 0, None), ("old", 0, None)]
    assert read("calls", ID) == []


def test_savings_of_two_trees_and_receipts(spark, tmp_path):
    put(tmp_path, "ledger/savings/graph/savings.jsonl", {"id": "x", "n": 1}, {"id": "y", "n": 2})
    put(tmp_path, "ledger/graph/savings-2024-05.jsonl", {"id": "x", "n": 9}, {"id": "z", "n": 3}, {"n": 4}, {"n": 4})
    put(tmp_path, "ledger/of-others/savings-2024-06.jsonl", {"id": "w", "n": 5})
    put(tmp_path, "ledger/consumer/savings-2024-06.jsonl", {"id": "no tool's", "n": 6})
    put(tmp_path, "ledger/receipts.jsonl", {"id": "x", "n": 7}, {"id": "r", "n": 8})
    got = homes.savings(spark, str(tmp_path), ID).collect()
    assert sorted((r.id or "", r.n, r.folder) for r in got) == [("", 4, "graph"), ("", 4, "graph"), ("w", 5, "of-others"), ("x", 1, "graph"), ("y", 2, "graph"), ("z", 3, "graph")]
    assert sorted((r.id or "", r.n) for r in homes.receipts(spark, str(tmp_path), ID).collect()) == [("", 4), ("", 4), ("r", 8), ("w", 5), ("x", 1), ("y", 2), ("z", 3)]


def test_a_call_and_its_twin_appear_together_and_count_once(spark, tmp_path):
    use = spark.createDataFrame([("2024-05-01T10:00:00Z", "r", 10, None, "x")] * 2 + [(None, "r", None, 4, "y")], "ts string, route string, tokens_in int, tokens_out int, other string")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert records.record(ledger, 3, "me", measured=use) and not records.record(ledger, 3, "me", measured=use)
    with pytest.raises(AlreadyPublished):
        records.record(ledger, 3, "you", measured=use)
    calls = ledger.scan("calls", f"id string, {records.CALL}").collect()
    twins = ledger.scan("consumer", f"id string, call string, {records.CALL}").collect()
    assert len({r.id for r in calls}) == 3 and {r.call for r in twins} == {r.id for r in calls} and not {r.id for r in calls} & {r.id for r in twins}
    assert sorted((r.tokens_in, r.tokens_out, r.agent, r.ok, r.ts is None) for r in calls) == [(0, 4, "lib", True, True), (10, 0, "lib", True, False), (10, 0, "lib", True, False)]
    made, twin = records.calls(use, "again")
    spend = joins.resolve_spend(made, made.limit(0).select("id", "agent", "tokens_in"), twin)
    assert spend.count() == 0  # every call is told by its twin, which stands for it
    assert {r.id for r in made.collect()} == {r.id for r in records.calls(use.repartition(3), "again")[0].collect()} != {r.id for r in calls}
    assert records.calls(use.limit(0), "none")[0].count() == 0


def test_receipts_that_disagree_or_name_no_tool_are_refused(spark, tmp_path):
    rows = [("graph", 10.0, 4.0, "tokens", None, "own"), ("graph", 9.0, 4.0, "tokens", None, "own"), ("graph", 5.0, None, None, "measured", None), ("../up", 1.0, 1.0, None, None, "b"), ("calls", 1.0, 1.0, None, None, None), ("Graph", 1.0, 1.0, "hours", "guess", "")]
    had = spark.createDataFrame(rows, "tool string, raw_alternative double, actual double, unit string, method string, id string")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    records.record(ledger, 0, "me", receipt=had.drop("id"), saving=had)
    saved = ledger.scan("savings", f"id string, saved double, {records.RECEIPT}").collect()
    assert sorted((r.tool, r.saved, r.unit, r.method, r.id == "own") for r in saved) == [("graph", 5.0, "tokens", "measured", False), ("graph", 5.0, "tokens", "modeled", True)]
    assert sorted(r.saved for r in ledger.scan("receipts", "id string, ts string, saved double").collect()) == [0.0, 0.0, 5.0, 5.0, 6.0]
    refused = ledger.scan("refused", "ts string, of string, reason string").collect()
    assert sorted((r.of, r.reason) for r in refused) == [("receipts", "unit"), ("savings", "tool"), ("savings", "tool"), ("savings", "unit")]


def test_a_later_row_of_a_task_takes_nothing_away(spark):
    schema = "id string, ts string, type string, outcome string, agents array<string>, human_minutes double"
    rows = [("t", "2024-01-01", "fix", "", ["b", "a", "b", None, ""], None), ("t", "2024-01-02", "", "done", [], 30.0), ("", "2024-01-02", "fix", None, None, None)]
    got = {(r.ts, r.type, r.outcome, tuple(r.agents or ()), r.human_minutes) for r in records.tasks(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("2024-01-01", "fix", None, ("a", "b"), None), ("2024-01-02", None, "done", (), 30.0)}
