"""Joins of the ledger: suppression of twins, unions by id, intervals, prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_spend(calls: DataFrame, metrics: DataFrame, twins: DataFrame) -> DataFrame:
    """Calls without those told by metric rows: agents with metrics, and calls that have a twin; then the metric rows."""
    owned = metrics.select("agent").distinct()
    left = calls.join(owned, "agent", "left_anti").join(twins.where("call <> ''").select(F.col("call").alias("id")).distinct(), "id", "left_anti")
    return left.withColumn("basis", F.lit("calls")).unionByName(metrics.withColumn("basis", F.lit("metrics")), allowMissingColumns=True)


def join_table(spend: DataFrame, calls: DataFrame) -> DataFrame:
    """Spend, and the calls that it leaves out, for look-ups."""
    return spend.unionByName(calls.join(spend.select("id"), "id", "left_anti"), allowMissingColumns=True)


def union_first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first``, and of ``second`` what has no key or a key that ``first`` lacks."""
    ids = first.where(F.col(key).isNotNull()).select(key).distinct()
    return first.unionByName(second.join(ids, key, "left_anti"), allowMissingColumns=True)


def _day(at: str):
    return F.date_trunc("day", F.col(at).cast("timestamp")).alias("_day")


def windows_of(commits: DataFrame, at: str = "ts", key: str = "sha", by: tuple[str, ...] = ()) -> DataFrame:
    """(lo, hi] of each commit: since the one before, ties by key. ``by``: the repositories of a log.

    Worked out day by day; only the last commit of each day is carried on, so no task holds a whole log.
    """
    rows = commits.select("*", _day(at))
    last = rows.groupBy(*by, "_day").agg(F.max(at).alias("_last"))
    carried = last.select(*by, "_day", F.lag("_last").over(Window.partitionBy(*by).orderBy("_day")).alias("_before"))  # one row a day
    lo = F.lag(at).over(Window.partitionBy(*by, "_day").orderBy(at, key))
    out = rows.withColumn("lo", lo).join(carried, [*by, "_day"])
    return out.withColumn("lo", F.coalesce("lo", "_before")).drop("_before", "_day").withColumnRenamed(at, "hi")


#: Events of a day that one task takes; a fuller day is dealt to several, each with all ends of the day.
DAY_ROWS = 2_000_000


def interval_join(events: DataFrame, windows: DataFrame, at: str = "ts", key: str = "sha", by: tuple[str, ...] = (), rows: int = DAY_ROWS) -> DataFrame:
    """Add the commit whose window (lo, hi] holds each event: the first one at or after it; none for an event without a time.

    Events and window ends of a day are merged from the latest backwards and the last end seen is carried along: one sort
    of each day, where a range join would compare all with all. A day of more than ``rows`` events is dealt to several
    tasks. Events after a day's last end belong to the first end of a later day; those are as many rows as there are days.
    """
    timed = events.where(F.col(at).isNotNull()).select("*", _day(at))
    # Of several ends at one time the smallest key owns it.
    ends = windows.groupBy(*by, F.col("hi").alias(at)).agg(F.min(key).alias("_sha")).select("*", _day(at))
    counted = timed.groupBy(*by, "_day").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    # Dealt by what a row holds: a task that runs again deals its rows as before. Rows that are equal in all are few.
    deal = F.pmod(F.xxhash64(*events.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = timed.join(counted.where("_parts > 1"), [*by, "_day"], "left").withColumn("_part", deal)
    firsts = ends.groupBy(*by, "_day").agg(F.min_by("_sha", at).alias("_first"))
    days = counted.join(firsts, [*by, "_day"], "full")  # one row a day
    backwards = Window.partitionBy(*by).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*by, "_day", "_parts", F.last("_first", ignorenulls=True).over(backwards).alias("_next"))
    copies = ends.join(days.drop("_next"), [*by, "_day"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    # The first end after a day closes it: it is carried into the day as its last end, so no join of the events is needed.
    after = days.where("_parts is not null and _next is not null").select(*by, F.col("_next").alias("_sha"), "_day", "_parts").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    both = dealt.withColumn("_end", F.lit(0)).unionByName(copies.withColumn("_end", F.lit(1)), allowMissingColumns=True).unionByName(after.withColumn("_end", F.lit(2)), allowMissingColumns=True).drop("_parts")
    w = Window.partitionBy(*by, "_day", "_part").orderBy(F.desc(F.col("_end") == 2), F.desc(at), F.desc("_end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(key, F.last("_sha", ignorenulls=True).over(w)).where("_end = 0").drop("_end", "_sha", "_day", "_part")
    return found.unionByName(events.where(F.col(at).isNull()), allowMissingColumns=True)


def containment_join(events: DataFrame, spans: DataFrame, key: str, by: str, at: str, task: str) -> DataFrame:
    """Adds ``task``: the smallest one of the same ``by`` whose span lo..hi holds the event, both ends included; else NULL.
    ``key`` names an event.

    Spans are cut into days, so an event meets only those of its own day.
    """
    days = F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("_day")
    cut = spans.where("lo <= hi").select(by, task, "lo", "hi", days)
    met = events.select(key, by, F.to_date(at).alias("_day"), F.col(at).alias("_at")).join(cut, [by, "_day"]).where("_at between lo and hi")
    return events.join(met.groupBy(key).agg(F.min(task).alias(task)), key, "left")


def task_join(calls: DataFrame, key: str = "id", by: str = "session", at: str = "ts", task: str = "task") -> DataFrame:
    """``calls`` with ``task`` filled in and ``task_via``: the task that a call names, always, whether or not there is a row of it; else
    the smallest task of which the call lies in a session and in its span.

    A task's span is that of the calls that name it, both ends included, and its sessions are theirs. A call without a key or a
    time is not taken in.
    """
    said = F.coalesce(F.col(task).cast("string"), F.lit("")) != ""
    named = calls.where(said)
    span = named.groupBy(task).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    where = named.where(F.coalesce(F.col(by).cast("string"), F.lit("")) != "").select(task, by).distinct()
    found = containment_join(calls.where(~said).drop(task), where.join(span.where("lo is not null"), task), key, by, at, task)
    return named.withColumn("task_via", F.lit("named")).unionByName(found.withColumn("task_via", F.when(F.col(task).isNotNull(), "session")))


def prefix_match(probes: DataFrame, candidates: DataFrame, probe: str, full: str, least: int = 4) -> DataFrame:
    """(probe, match, verdict): the one candidate that begins with the probe or begins it; or why there is none: 'ambiguous', 'no-match', 'empty'.

    Strings of ``least`` characters or more meet on that many; the few shorter ones there can be meet the
    beginnings of their own length of the other side.
    """
    a = probes.select(probe).distinct()
    b = candidates.where(F.col(full) != "").select(full).distinct()
    met = None
    for left, right in _prefix_keys(a, b, probe, full, least):
        part = left.join(right, "_k").where(F.col(probe).startswith(F.col(full)) | F.col(full).startswith(F.col(probe))).select(probe, full)
        met = part if met is None else met.unionByName(part)
    found = met.groupBy(probe).agg(F.count(full).alias("n"), F.min(full).alias("m"))
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(F.coalesce(F.col(probe), F.lit("")) == "", "empty").when(n == 1, "match").when(n > 1, "ambiguous").otherwise("no-match")
    return a.join(found, probe, "left").select(probe, F.when(n == 1, F.col("m")).alias("match"), verdict.alias("verdict"))


def _prefix_keys(a: DataFrame, b: DataFrame, x: str, y: str, least: int) -> list[tuple[DataFrame, DataFrame]]:
    """Both sides keyed so that each pair of which one may begin the other meets once: long with long, short with short or long, long with short."""
    long = lambda d, c: d.where(F.length(c) >= least).withColumn("_k", F.substring(c, 1, least))
    short = lambda d, c: d.where((F.length(c) < least) & (F.length(c) > 0)).withColumn("_k", F.col(c))
    starts = lambda d, c, n: d.withColumn("_k", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(n))), lambda k: F.substring(F.col(c), F.lit(1), k))))
    below = lambda d, c: starts(d.where(F.length(c) > 1), c, least - 1).where(F.length("_k") < F.length(c))
    return [(long(a, x), long(b, y)), (short(a, x), starts(b.where(F.length(y) > 0), y, least - 1)), (below(a, x), short(b, y))]
