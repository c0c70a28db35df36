import json

from loglattice.operators import fold
from loglattice.sources import metrics as M
from loglattice.sources import transcripts as T


def lines_of(spark, tmp_path, name, rows):
    """A log of one session with a blank line, a broken one and a last one cut off."""
    at = tmp_path / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join([r if isinstance(r, str) else json.dumps(r) for r in rows] + ["", "{broken", '{"type": "sess']))
    return T.numbered_lines(spark, str(at))


def shutdown(models, **data):
    return {"type": "session.shutdown", "timestamp": "2024-07-02T08:00:00Z", "data": {"modelMetrics": models, **data}}


def use(i, o, c=0, flat=False):
    counts = {"inputTokens": i, "outputTokens": o, "cacheReadTokens": c}
    return counts if flat else {"usage": counts, "requests": {"count": 3}}


def test_totals_of_a_session_and_their_growth(spark, tmp_path):
    rows = [
        shutdown({"gpt-5": use(70, 7, 5), "claude-x": use(30, 3)}, totalPremiumRequests=0.33, totalNanoAiu=100),
        {"type": "session.start", "data": {}},
        shutdown({}),  # tells nothing: not numbered
        {"type": "session.shutdown", "data": {"totalPremiumRequests": 9}},  # no map
        shutdown({"claude-x": use(30, 3), "gpt-5": use(95, 9, 5, flat=True), "odd": 4}, totalNanoAiu=160),
        shutdown({"claude-x": use(30, 3), "gpt-5": use(95, 9, 5)}, totalPremiumRequests=0.33, totalNanoAiu=160),  # nothing moved
        shutdown({"gpt-5": use(40, 9, 2)}, totalPremiumRequests=0.1, totalNanoAiu=160),  # restarted
        '{"type": "session.shutdown", "data": {"modelMetrics": {}, "totalNanoAiu": NaN}}',  # no JSON
    ]
    got = M.copilot_cli(lines_of(spark, tmp_path, "one-session/events.jsonl", rows)).collect()
    assert {r.session for r in got} == {"one-session"} and {r.agent for r in got} == {"copilot"} and got[0].ts == "2024-07-02T08:00:00Z"
    totals = [r for r in got if r.source == "cli"]
    assert sorted(((r.tokens_in, r.tokens_out, r.cached_in, r.credits, r.nano_aiu, r.request) for r in totals), key=str) == sorted([(40, 9, 2, 0.1, 160.0, ""), (100, 10, 5, 0.33, 100.0, ""), (125, 12, 5, None, 160.0, ""), (125, 12, 5, 0.33, 160.0, "")], key=str)
    grown = {r.request: r for r in got if r.source == "cli-delta"}
    assert sorted(grown) == ["s000", "s001", "s003"]
    assert [tuple(t) for t in grown["s000"].model_totals] == [("gpt-5", 70, 5, 7), ("claude-x", 30, 0, 3)] and grown["s000"].model == grown["s000"].provider == ""
    assert (grown["s001"].model, grown["s001"].provider, grown["s001"].tokens_in, grown["s001"].credits, grown["s001"].nano_aiu) == ("gpt-5", "openai", 25, None, 60.0)
    assert [tuple(t) for t in grown["s003"].model_totals] == [("gpt-5", 40, 2, 0)] and (grown["s003"].credits, grown["s003"].nano_aiu) == (0.1, 0.0)
    # A fold by key keeps the largest totals; growth adds up over the restart.
    assert fold.copilot_fold(M.copilot_cli(lines_of(spark, tmp_path, "one-session/events.jsonl", rows))).where("source = 'cli'").first().tokens_in == 125
    by_model = M.models_of(spark.createDataFrame(list(grown.values()), M.COPILOT), ["session"]).first().model_totals
    assert [tuple(t) for t in by_model] == [("claude-x", 30, 0, 3), ("gpt-5", 70 + 25 + 40, 7, 9)]


def test_a_log_read_again_gives_the_same_ids(spark, tmp_path):
    first = [shutdown({"m": use(5, 1)}), shutdown({"m": use(9, 1)})]
    a = {r.id for r in M.copilot_cli(lines_of(spark, tmp_path, "s/events.jsonl", first)).collect()}
    b = {r.id for r in M.copilot_cli(lines_of(spark, tmp_path, "s/events.jsonl", [*first, shutdown({"m": use(10, 1)})])).collect()}
    assert len(a) == 4 and a < b and len(b) == 6


def ask(n, ext="GitHub.copilot-chat", **more):
    return {"requestId": n, "timestamp": 1720000000500, "modelId": "copilot/auto", "agent": {"extensionId": ext}, **more}


def patch(*requests):
    return {"kind": 2, "k": ["requests"], "v": list(requests)}


def test_chats(spark, tmp_path):
    parts = [{"model": "gpt-5", "inputTokens": 40, "cachedTokens": 8, "outputTokens": 4}, "odd", {"modelId": "claude-x", "inputTokens": 2}]
    rows = [
        {"kind": 0, "v": {"sessionId": "told", "requests": [ask("early", promptTokens=1)]}},  # the first state holds no requests to count
        patch(ask("a", promptTokens=3), ask("b", completionTokens=2), ask("none"), ask("zero", copilotCredits=0)),
        patch(ask("a", promptTokens=11, completionTokens=6, copilotCredits=0.25, elapsedMs=90.7, modelTotals=parts), "odd", {"noid": 1}),
        patch(ask("c", ext={"value": "GitHub.copilot-chat", "_lower": "github.copilot-chat"}, result={"metadata": {"promptTokens": 21, "outputTokens": 5}})),
        patch(ask("d", ext="other.chat", promptTokens=9), ask("e", ext=None, promptTokens=9), ask("f", ext={"value": "other"}, promptTokens=9), ask("", promptTokens=9)),
        {"kind": 2, "k": ["inputs"], "v": [1]}, {"kind": 1, "k": ["requests", 0, "modelId"], "v": "x"},
    ]
    got = {r.request: r for r in M.copilot_chats(lines_of(spark, tmp_path, "chatSessions/file-name.jsonl", rows)).collect()}
    assert sorted(got) == ["a", "b", "c", "zero"] and {r.session for r in got.values()} == {"told"}
    a = got["a"]
    assert (a.tokens_in, a.tokens_out, a.cached_in, a.credits, a.session_credits, a.elapsed_ms, a.waiting_ms, a.ts) == (11, 6, 8, 0.25, None, 90, 0, "2024-07-03T09:46:40.500Z")
    assert [tuple(t) for t in a.model_totals] == [("gpt-5", 40, 8, 4), ("claude-x", 2, 0, 0)]
    assert (got["c"].tokens_in, got["c"].tokens_out, got["zero"].credits, got["b"].credits) == (21, 5, 0.0, None)
    bare = M.copilot_chats(lines_of(spark, tmp_path, "chatSessions/file-name.jsonl", rows[1:])).collect()
    assert {r.session for r in bare} == {"file-name"} and len({r.id for r in bare} | {r.id for r in got.values()}) == 8
    # A request that has grown is a new row of the same key, and the fold keeps it.
    grown = lines_of(spark, tmp_path, "chatSessions/file-name.jsonl", [*rows, patch(ask("b", completionTokens=70))])
    both = spark.createDataFrame(list(got.values()), M.COPILOT).unionByName(M.copilot_chats(grown)).dropDuplicates(["id"])
    assert both.count() == 5 and {r.request: r.tokens_out for r in fold.copilot_fold(both).collect()}["b"] == 70


def test_kiro_lines_and_empty_logs(spark, tmp_path):
    rows = [{"promptTokens": 4, "generatedTokens": 0, "model": "agent", "provider": ""}, {"promptTokens": 0, "generatedTokens": 0}, {"promptTokens": 4, "generatedTokens": 0, "model": "agent", "provider": ""}, {"generatedTokens": 2.9, "provider": "bedrock"}, {"promptTokens": "many"}]
    got = sorted(M.kiro_ide(lines_of(spark, tmp_path, "k/tokens.jsonl", rows)).collect(), key=lambda r: int(r.row_ref))
    assert [(r.row_ref, r.provider, r.model, r.tokens_in, r.tokens_out) for r in got] == [("0", "kiro", "agent", 4, 0), ("2", "kiro", "agent", 4, 0), ("3", "bedrock", "", 0, 2)]
    assert len({r.id for r in got}) == 3 and got[0].id.startswith("km_idelog00000")
    nothing = spark.createDataFrame([(None, None, None), ("f", 0, None), ("f", 1, "no json"), ("f", 2, "[1]")], "file string, line_no int, line string")
    for read, schema in ((M.copilot_cli, M.COPILOT), (M.copilot_chats, M.COPILOT), (M.kiro_ide, M.KIRO)):
        out = read(nothing)
        assert out.count() == 0 and [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema]
    assert fold.kiro_fold(M.kiro_ide(lines_of(spark, tmp_path, "k/tokens.jsonl", rows))).count() == 3
