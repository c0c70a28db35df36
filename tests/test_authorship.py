"""Authorship capture on a small history: edits, context, pending work, short shas, rows recorded once."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loglattice.operators import attribution, authorship, joins
from loglattice.sources import gitlog

LOG = """commit aaaa111 2024-05-01T10:00:00Z

3\t1\tsrc/a.py
-\t-\tlogo.png
2\t0\tnotes.md
0\t2\tcut.py
diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1 +1,3 @@
-old line
+first proposed line
+++ counter += 1
+written by a person
\\ No newline at end of file
diff --git a/notes.md b/notes.md
--- /dev/null
+++ b/notes.md
@@ -0,0 +1,2 @@
+a person's note
+another of them
diff --git a/cut.py b/cut.py
--- a/cut.py
+++ b/cut.py
@@ -3,2 +2,0 @@
-gone
-gone too
"""
LATER = """commit bbbb222 2024-05-03T00:30:00+02:00

1\t0\tsrc/b.py
diff --git a/src/b.py b/src/b.py
--- /dev/null
+++ b/src/b.py
@@ -0,0 +1 @@
+waited for this commit
"""


def when(day, hour):
    return datetime(2024, 5, day, hour, tzinfo=timezone.utc)


EDITS = [
    ("e1", "s1", when(1, 9), "/repo/src/a.py", ["first proposed  line", "kept as it was", "++ counter += 1", "}"], ["kept as it was"]),
    ("e2", "s1", when(1, 9), "/repo/gone.py", ["never landed", "never landed"], []),
    ("e3", "s2", when(1, 8), "/repo/cut.py", ["only restated"], ["only restated"]),
    ("e4", "s2", when(2, 9), "/repo/src/b.py", ["waited for this commit"], []),
    ("e5", "s2", when(2, 9), "/elsewhere/c.py", ["not of this repository"], []),
    ("e6", "s2", None, "/repo/src/b.py", ["no time"], []),
    ("e1", "s1", when(1, 9), "/repo/src/a.py", ["first proposed  line", "kept as it was", "++ counter += 1", "}"], ["kept as it was"]),
]
NAMES = ("files", "lines_added", "lines_removed", "suggested", "kept", "kept_modified", "dropped", "agent_lines", "residual_lines", "confidence")


def told(rows):
    return {(r.sha, r.session): tuple(r[c] for c in NAMES) for r in rows.collect()}


def test_two_sweeps_around_a_commit_record_each_row_once(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    edits = spark.createDataFrame(EDITS, authorship.EDIT)
    none = spark.createDataFrame([], authorship.ROW)
    log = gitlog.commit_log(spark, str(tmp_path))
    rows, waiting = authorship.capture(edits, log, none, "/repo")
    first = told(rows)
    assert first == {
        # Two of two matchable lines of a.py landed, one of a person's is left; gone.py never came; logo.png is in the commit for every session.
        ("aaaa111", "s1"): (["logo.png", "src/a.py"], 3, 1, 4, 2, 0, 2, 2, 1, 0.6667),
        # A file whose proposals only stated what was there has landed, with nothing of the session's.
        ("aaaa111", "s2"): (["cut.py", "logo.png"], 0, 2, 0, 0, 0, 0, 0, 0, 0.6667),
    }
    assert [r.id for r in waiting.collect()] == ["e4"]
    have = spark.createDataFrame(rows.collect(), authorship.ROW)
    again, _ = authorship.capture(edits, log, have, "/repo")
    assert again.count() == 0
    # The commit comes; only what waited is given to the next sweep, and it is recorded once.
    (tmp_path / "log.txt").write_text(LATER + "\n" + LOG)
    log = gitlog.commit_log(spark, str(tmp_path))
    kept = spark.createDataFrame(waiting.collect(), authorship.EDIT)
    rows, waiting = authorship.capture(kept, log, have, "/repo")
    assert told(rows) == {("bbbb222", "s2"): (["src/b.py"], 1, 0, 1, 1, 0, 0, 1, 0, 0.6667)} and waiting.count() == 0
    have = have.unionByName(spark.createDataFrame(rows.collect(), authorship.ROW))
    rows, waiting = authorship.capture(kept, log, have, "/repo")
    assert rows.count() == 0 and waiting.count() == 0


def test_short_shas_other_methods_and_a_repository_without_commits(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    edits = spark.createDataFrame(EDITS, authorship.EDIT)
    log = gitlog.commit_log(spark, str(tmp_path))
    rows, _ = authorship.capture(edits, log, spark.createDataFrame([], authorship.ROW), "/repo")
    one = rows.where("session = 's1'")
    have = one.withColumn("sha", F.lit("aa")).unionByName(rows.where("session = 's2'").withColumn("method", F.lit("hooked")))
    fresh, _ = authorship.capture(edits, log, spark.createDataFrame(have.collect(), authorship.ROW), "/repo")
    assert told(fresh) == {("aaaa111", "s2"): (["cut.py", "logo.png"], 0, 2, 0, 0, 0, 0, 0, 0, 0.8667)}
    empty = authorship.CommitLog(log.commits.limit(0), log.numstat.limit(0), log.patched.limit(0), log.added.limit(0))
    rows, waiting = authorship.capture(edits, empty, spark.createDataFrame([], authorship.ROW), "/repo")
    assert rows.count() == 0 and {r.id for r in waiting.collect()} == {"e1", "e2", "e3", "e4"}
    assert authorship.capture(edits.limit(0), log, spark.createDataFrame([], authorship.ROW), "/repo")[0].count() == 0


def test_lines_that_look_like_headers_stay_where_they_are(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LATER + "\n" + LOG)
    lines = gitlog.added_lines(spark, str(tmp_path))
    assert {(r.path, r.line) for r in lines.where("sha = 'aaaa111'").collect()} == {
        ("src/a.py", "first proposed line"), ("src/a.py", "++ counter += 1"), ("src/a.py", "written by a person"), ("notes.md", "a person's note"), ("notes.md", "another of them"),
    }
    assert {r.path for r in gitlog.patched_files(spark, str(tmp_path)).collect()} == {"src/a.py", "notes.md", "cut.py", "src/b.py"}
    assert {(r.sha, r.ts) for r in gitlog.commits(spark, str(tmp_path)).collect()} == {("aaaa111", "2024-05-01T10:00:00Z"), ("bbbb222", "2024-05-02T22:30:00Z")}


@pytest.mark.parametrize("probe, want", [("abc", ("abcdef0", "match")), ("a", (None, "ambiguous")), ("abcdef01", ("abcdef0", "match")), ("", (None, "empty")), ("zz", (None, "no-match")), ("b1", ("b", "match")), ("b", ("b", "match"))])
def test_prefixes_of_any_length(spark, probe, want):
    have = spark.createDataFrame([("abcdef0",), ("a9",), ("b",), ("",), (None,)], "sha string")
    got = joins.prefix_match(spark.createDataFrame([(probe,), (probe,)], "probe string"), have, "probe", "sha").collect()
    assert [(r.match, r.verdict) for r in got] == [want]


def test_a_task_takes_its_sessions_calls_between_those_that_name_it(spark):
    rows = [(1, "s", 10, "T"), (2, "s", 20, None), (3, "s", 30, "T"), (4, "s", 31, None), (5, "other", 20, None), (6, "s", None, None), (7, "x", 5, "A"), (8, "s", 25, "A"), (9, "", 20, None), (10, "s", 20, "")]
    got = joins.task_join(spark.createDataFrame(rows, "id int, session string, ts int, task string").withColumn("ts", F.timestamp_seconds("ts"))).collect()
    assert {r.id: (r.task, r.task_via) for r in got} == {
        1: ("T", "named"), 2: ("A", "session"), 3: ("T", "named"), 4: (None, None), 5: (None, None), 6: (None, None), 7: ("A", "named"), 8: ("A", "named"), 9: (None, None), 10: ("A", "session"),
    }


def test_attested_minutes_land_on_the_commit_of_a_clean_task(spark):
    tasks = spark.createDataFrame([("aaaa", 30.0, "done", 0), ("aaaa111", 15.0, "done", None), ("aaaa111", 9.0, "", 0), ("bbbb", 9.0, "done", 2), ("cccc", 5.0, "done", 0), ("", 5.0, "done", 0)], "commit string, human_minutes double, outcome string, files_changed int")
    commits = spark.createDataFrame([("aaaa111222",), ("bbbb222",)], "sha string")
    assert {r.sha: r.minutes for r in attribution.attested_minutes(tasks, commits).collect()} == {"aaaa111222": 45.0, "cccc": 5.0}


def test_events_of_a_busy_day_are_each_placed_once(spark):
    events = spark.range(5000).select("id", F.timestamp_seconds(F.col("id") * 30).alias("ts"))
    ends = spark.createDataFrame([("a", 40000), ("b", 40000), ("c", 100000)], "sha string, t int").select("sha", F.timestamp_seconds("t").alias("ts"))
    whole = {(r.id, r.sha) for r in joins.interval_join(events, joins.windows_of(ends)).collect()}
    parts = joins.interval_join(events, joins.windows_of(ends), rows=50).collect()
    assert len(parts) == 5000 and {(r.id, r.sha) for r in parts} == whole
    assert dict(whole) == {k: "a" if 30 * k <= 40000 else "c" if 30 * k <= 100000 else None for k in range(5000)}
