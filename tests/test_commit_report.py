from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators import commit_report as R

FILES = "sha string, path string, added long, added_gated long, removed long, binary boolean"
ROWS = "sha string, session string, agent string, method string, confidence double, files array<string>, suggested long, kept long, kept_modified long, dropped long, agent_lines long"
CALLS = "id int, ts timestamp_ntz, via string, sha string, tokens_in long, tokens_out long, cached_in long, cache_write_in long, latency_ms long"


def commits(spark):
    rows = [("aaaa1111", 1000), ("aabb2222", 5000), ("cccc3333", 100_000), ("dddd4444", 300_000)]
    return spark.createDataFrame(rows, "sha string, t long").select("sha", F.timestamp_seconds("t").alias("ts"))


def calls(spark, rows):
    named = spark.createDataFrame(rows, CALLS.replace("timestamp_ntz", "long"))
    return named.withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))


def made(spark, use=(), files=(), rows=(), minutes=(), **how):
    return {
        r.sha: r
        for r in R.report(
            R.shown(commits(spark))[0], calls(spark, list(use)), spark.createDataFrame(list(files), FILES), R.on_commits(spark.createDataFrame(list(rows), ROWS), commits(spark)),
            spark.createDataFrame(list(minutes), "sha string, minutes double"), **how,
        ).collect()
    }


def test_a_commit_of_which_nothing_is_known_is_shown(spark):
    got = made(spark)
    assert len(got) == 4 and all(not r.attributed and r.calls == r.agent == r.added == 0 and r.sessions == [] and r.method is None for r in got.values())
    assert {s: (r.hours, r.reason, r.wall_s) for s, r in got.items()} == {
        "aaaa1111": (None, "no-wall", None), "aabb2222": (None, "no-agent-span", 4000), "cccc3333": (None, "no-agent-span", 95_000), "dddd4444": (None, "no-agent-span", 200_000),
    }


def test_hours_attested_measured_and_refused(spark):
    use = [(1, 1500, "window", "aabb2222", 10, 1, 4, 2, 0), (2, 1900, "task", "aabb2222", None, 2, None, None, None), (3, 50_000, "window", "cccc3333", 5, 5, 0, 0, 1999), (4, 50_000, "window", "cccc3333", 5, 5, 0, 0, 2), (5, None, "task", "dddd4444", 1, 1, 0, 0, 0)]
    got = made(spark, use, minutes=[("aaaa1111", 90.0), ("gone", 5.0)], cap_s=90_000)
    two, three, last = got["aabb2222"], got["cccc3333"], got["dddd4444"]
    assert (got["aaaa1111"].hours, got["aaaa1111"].tier, got["aaaa1111"].reason) == (1.5, "attested", "")
    assert (two.calls, two.via_task, two.via_window, two.tokens_in, two.tokens_out, two.cache_read, two.cache_write) == (2, 1, 1, 10, 3, 4, 2)
    assert (two.agent_span_s, two.agent_span_method, two.hours, two.tier) == (400, "span", 1.0, "estimated")
    assert (three.agent_span_s, three.agent_span_method, three.hours, three.reason) == (2, "measured", None, "gap-too-wide")
    assert (last.agent_span_s, last.agent_span_method, last.reason) == (None, "", "no-agent-span")
    assert made(spark, use, estimate=False)["aabb2222"].reason == "no-estimate"


def test_lines_by_author_with_rows_under_short_shas(spark):
    files = [("aaaa1111", "a", 10, 2, 3, False), ("aaaa1111", "b", 5, 0, 1, False), ("aaaa1111", "z.png", 0, 0, 0, True), ("cccc3333", "a", 4, 1, 0, False)]
    rows = [
        ("aaaa", "s2", "claude", "transcript", 0.6, ["a", "z.png"], 9, 6, 2, 1, 6), ("aaaa1111", "s1", "claude", "hooked", 1.0, ["a"], 4, 4, 0, 0, 4), ("aa", "s3", "kiro", "heuristic", None, ["b"], 1, 1, 0, 0, 1),
        ("", "s4", "kiro", "heuristic", 0.1, None, 1, 1, 0, 0, 1), (None, "s5", "kiro", "heuristic", 0.1, None, 1, 1, 0, 0, 1),
    ]
    got = made(spark, files=files, rows=rows)
    one, three = got["aaaa1111"], got["cccc3333"]
    # Two sessions claim ten of the eight lines there are; 'aa' begins two commits and is on neither.
    assert (one.added, one.removed, one.agent, one.human, one.unattributed, one.unknown, one.binary_files) == (15, 4, 8, 0, 5, 2, 1)
    assert (one.sessions, one.agents, one.confidence, one.method, one.suggested, one.kept, one.kept_modified, one.dropped) == (["s1", "s2"], ["claude"], 1.0, "hooked", 13, 10, 2, 1)
    assert (three.agent, three.human, three.unattributed, three.unknown) == (0, 0, 3, 1)
    per = R.file_rows(spark.createDataFrame(files, FILES), R.on_commits(spark.createDataFrame(rows, ROWS), commits(spark))).collect()
    assert [(r.sha, r.path, r.added, r.removed, r.agent, r.human, r.unattributed, r.unknown, r.binary) for r in per] == [
        ("aaaa1111", "a", 10, 3, 8, 0, 0, 2, False), ("aaaa1111", "b", 5, 1, 0, 0, 5, 0, False), ("aaaa1111", "z.png", 0, 0, 0, 0, 0, 0, True), ("cccc3333", "a", 4, 0, 0, 0, 3, 1, False),
    ]


def test_what_a_view_leaves_out_is_counted(spark):
    rows, left = R.shown(commits(spark), since="1970-01-01 01:00:00", limit=2)
    assert {(r.sha, r.lo is None) for r in rows.collect()} == {("cccc3333", False), ("dddd4444", False)} and left.collect() == [(1, 1)]
    rows, left = R.shown(commits(spark), limit=9)
    assert rows.count() == 4 and left.collect() == [(0, 0)]
    assert R.shown(commits(spark).limit(0), limit=2)[0].count() == 0


def test_totals(spark):
    use = [(1, 1500, "window", "aabb2222", 10, 1, 4, 2, 0), (2, 1900, "task", "aabb2222", 1, 2, 0, 0, 0)]
    whole = R.report(R.shown(commits(spark))[0], calls(spark, use), spark.createDataFrame([("aabb2222", "a", 3, 1, 1, False)], FILES), spark.createDataFrame([], ROWS), spark.createDataFrame([("aaaa1111", 30.0)], "sha string, minutes double"))
    t = R.totals(whole).first()
    assert (t.calls, t.tokens_in, t.tokens_out, t.added, t.removed, t.unattributed, t.unknown, t.agent) == (2, 11, 3, 3, 1, 2, 1, 0)
    assert (t.hours, t.hours_attested_n, t.hours_estimated_n, t.commits, t.attributed) == (1.5, 1, 1, 4, 1)
    none = R.totals(whole.limit(0)).first()
    assert (none.calls, none.hours, none.commits) == (0, 0.0, 0)


def test_calls_are_adopted_by_closed_tasks_only_and_not_by_few(spark):
    rows = [(0, "s", 0, "T"), (1, "s", 100, "T"), (2, "o", 0, "U"), (3, "o", 100, "U"), *((10 + k, "s", 10 * k, None) for k in range(1, 6)), *((30 + k, "o", 10 * k, "") for k in range(1, 9)), (50, "s", 101, None), (51, None, 50, None)]
    c = spark.createDataFrame(rows, "id int, session string, ts int, task string").withColumn("ts", F.timestamp_seconds("ts"))
    tasks = spark.createDataFrame([("T", "done"), ("U", ""), ("V", "done")], "task string, outcome string")
    got = R.adopted(c, tasks).collect()
    assert {(r.id, r.task, r.method, r.confidence) for r in got} == {(10 + k, "T", "estimated", R.ADOPTED) for k in range(1, 6)}
    assert R.adopted(c.where("id <> 13"), tasks).count() == 0 and R.adopted(c.limit(0), tasks).count() == 0


def test_hours_are_rounded_as_the_doubles_are(spark):
    halves = [s / 3600.0 for s in range(18, 400_000, 36)] + [0.125, 0.375, 1.005, 2.675, 1234567.885, 0.0]
    got = spark.createDataFrame([(x,) for x in halves], "x double").select("x", S.round_exact(F.col("x"), 2).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.r != round(r.x, 2)] == []
