"""Whose work a commit is: calls and edits placed on commits, proposed lines matched with those that landed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions import scalars as S
from loglattice.operators import joins


def trusted_commits(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task, commit) of tasks closed (with an outcome) on a clean tree, and how many closed with changes that no commit holds."""
    closed = tasks.where("coalesce(outcome, '') <> '' and coalesce(commit, '') <> ''")
    return closed.where("coalesce(files_changed, 0) = 0").select("task", "commit"), closed.agg(F.count_if(F.col("files_changed") > 0).alias("dirty_tasks"))


def attested_minutes(tasks: DataFrame, commits: DataFrame) -> DataFrame:
    """(sha, minutes): what people said they spent on tasks closed on a clean tree, on the commit their row names; a commit that is not there keeps its name."""
    said = tasks.where("human_minutes is not null and coalesce(commit, '') <> '' and coalesce(outcome, '') <> '' and coalesce(files_changed, 0) = 0")
    found = joins.prefix_match(said.select(F.col("commit").alias("probe")), commits, "probe", "sha")
    named = said.join(found.select(F.col("probe").alias("commit"), "match"), "commit", "left")
    return named.groupBy(F.coalesce("match", "commit").alias("sha")).agg(F.sum(F.col("human_minutes").cast("double")).alias("minutes"))


def commit_join(calls: DataFrame, commits: DataFrame, tasks: DataFrame, trusted: DataFrame, project: str = "") -> DataFrame:
    """Every call with ``sha`` and ``via``, or with the ``reason`` why it is on no commit.

    ``calls``: id, ts, session, task, agent, surface, project; ``tasks``: those of ``trusted_commits``. A call's task is the one
    it names, else the one in whose session and span it lies. A call of a task that names a commit is on that commit
    (``via`` task) or, if the commit is not there or not the only one, dangles. The others need times of their own (``trusted``:
    agent, surface, joinable; a surface of NULL speaks for all of an agent's), a project, the right one, and a window that holds them.
    """
    found = joins.prefix_match(tasks.select(F.col("commit").alias("probe")), commits, "probe", "sha")
    named = tasks.select("task", F.col("commit").alias("probe")).join(found, "probe").select("task", F.col("match").alias("task_sha"), F.lit(True).alias("_named"))
    by_surface = trusted.where("surface is not null").select("agent", "surface", F.col("joinable").alias("_own"))
    by_agent = trusted.where("surface is null").select("agent", F.col("joinable").alias("_any"))
    rows = joins.task_join(calls).withColumn("agent", S.agent_name(F.col("agent"))).join(named, "task", "left").join(by_surface, ["agent", "surface"], "left").join(by_agent, "agent", "left")
    early = (
        F.when(F.col("_named"), F.when(F.col("task_sha").isNull(), "dangling-task"))
        .when(~F.coalesce("_own", "_any", F.lit(False)), "no-ts-fidelity")
        .when(F.coalesce("project", F.lit("")) == "", "no-project")
        .when(F.lit(project != "") & (F.col("project") != project), "other-project")
    )
    rows = joins.interval_join(rows.withColumn("_why", early), joins.windows_of(commits).withColumnRenamed("sha", "window_sha"), key="window_sha")
    on_task = F.coalesce("_named", F.lit(False))
    sha = F.when(F.col("_why").isNotNull(), None).when(on_task, F.col("task_sha")).otherwise(F.col("window_sha"))
    out = rows.withColumn("sha", sha).withColumn("via", F.when(F.col("sha").isNotNull(), F.when(on_task, "task").otherwise("window")))
    return out.withColumn("reason", F.coalesce("_why", F.when(F.col("sha").isNull(), "after-head"))).select(*calls.columns, "sha", "via", "reason")


def excluded(joined: DataFrame) -> DataFrame:
    """(reason, calls, tokens) of what is on no commit, the most frequent reason first."""
    out = joined.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens"))
    return out.orderBy(F.desc("calls"), "reason")


def subtract_context(edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, line, n): how often each file's matchable lines are proposed, those that an edit only states again taken away one by one.

    ``edits``: id, keys, path, lines, context (arrays of raw lines). Context is taken away edit by edit; lines too short to match are
    never taken away and never count.
    """
    def side(column: str, p: int):
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(x.alias("raw"), F.lit(p).alias("p"), F.lit(1 - p).alias("c")))

    sides = F.concat(side("lines", 1), side("context", 0))
    each = edits.select("id", *keys, "path", F.explode(sides).alias("s")).select("id", *keys, "path", S.normalize_line(F.col("s.raw")).alias("line"), "s.p", "s.c").where(S.matchable(F.col("line")))
    left = each.groupBy("id", *keys, "path", "line").agg((F.sum("p") - F.sum("c")).alias("n")).where("n > 0")
    return left.groupBy(*keys, "path", "line").agg(F.sum("n").alias("n"))


def match_files(proposed: DataFrame, added: DataFrame, binary: DataFrame, keys: list[str], files: DataFrame | None = None, patched: DataFrame | None = None) -> DataFrame:
    """One row a file that either side knows: verdict and counts of lines.

    ``proposed``, ``added``: keys, path, line (normalised), and ``n`` where a row stands for several. ``files`` are the files proposed for,
    ``patched`` those that the commit leaves with a patch, where lines alone do not tell: an edit may only state again what was there, a patch
    may only take lines away. Lines too short to match are counted apart; a binary file has no lines that could be read.
    """
    at = [*keys, "path"]
    n = lambda d: F.col("n") if "n" in d.columns else F.lit(1)
    long = S.matchable(F.col("line"))
    p = proposed.groupBy(*at).agg(F.sum(F.when(long, n(proposed)).otherwise(0)).alias("suggested"))
    a = added.groupBy(*at).agg(F.sum(n(added)).alias("added"), F.sum(F.when(~long, n(added)).otherwise(0)).alias("added_gated"))
    if files is not None:
        p = files.select(*at).distinct().join(p, at, "left").withColumn("suggested", F.coalesce("suggested", F.lit(0)))
    if patched is not None:
        a = patched.select(*at).distinct().join(a, at, "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("added", "added_gated")})
    pc = proposed.where(long).groupBy(*at, "line").agg(F.sum(n(proposed)).alias("p"))
    ac = added.where(long).groupBy(*at, "line").agg(F.sum(n(added)).alias("a"))
    kept = pc.join(ac, [*at, "line"]).groupBy(*at).agg(F.sum(F.least("p", "a")).alias("kept"))
    both = p.join(a, at, "full").join(kept, at, "left").join(binary.select(*at).distinct().withColumn("_b", F.lit(True)), at, "full")
    return both.select(*at, *_verdict())


def _verdict() -> list:
    """Verdict and counts of a file from suggested, added, added_gated, kept and _b (binary), NULL where a side does not know it."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = (
        F.when(F.col("_b"), "unreadable").when(F.col("added").isNull(), "dropped").when(F.col("suggested").isNull(), "not-proposed")
        .when((F.col("suggested") > 0) & (zero("kept") == F.col("suggested")), "kept").otherwise("landed-modified")
    )
    readable = ~F.coalesce("_b", F.lit(False))
    landed, kept = F.col("added").isNotNull() | ~readable, F.when(readable, zero("kept")).otherwise(0)
    count = lambda c: c.cast("long")
    return [
        verdict.alias("verdict"), count(zero("suggested")).alias("suggested"), count(kept).alias("kept"),
        count(F.when(landed, zero("suggested") - kept).otherwise(0)).alias("kept_modified"), count(F.when(landed, F.lit(0)).otherwise(zero("suggested"))).alias("dropped"),
        count(F.when(readable, zero("added")).otherwise(0)).alias("added"), count(F.when(readable, zero("added_gated")).otherwise(0)).alias("added_gated"),
    ]


#: Verdicts of files that are in the commit with something of the proposals, or that no one can read.
LANDED = ("kept", "landed-modified", "unreadable")


def match_totals(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each commit's matches (or each session's on it): suggested is kept, kept_modified and dropped together."""
    read = F.col("verdict").isin("kept", "landed-modified", "not-proposed")
    sums = [F.sum(c).alias(c) for c in ("suggested", "kept", "kept_modified", "dropped")]
    return matches.groupBy(*keys).agg(
        *sums, F.sum("kept").alias("agent_lines"), F.sum(F.when(read, F.col("added")).otherwise(0)).alias("added"), F.sum(F.when(read, F.col("added_gated")).otherwise(0)).alias("unknown"),
        F.count_if(F.col("verdict") == "not-proposed").alias("not_proposed_files"), F.count_if(F.col("verdict") == "unreadable").alias("binary_files"),
    )


def residual(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agent_lines, residual_lines): matchable lines of landed files that are not the agent's, none below zero.

    A file that the agent never proposed is the commit's, not the session's, and counts for neither.
    """
    landed, agent = F.col("verdict").isin(*LANDED), F.sum("kept")
    return matches.groupBy(*keys).agg(agent.alias("agent_lines"), F.greatest(F.sum(F.when(landed, F.col("added") - F.col("added_gated")).otherwise(0)) - agent, F.lit(0)).alias("residual_lines"))


def place_edits(edits: DataFrame, commits: DataFrame, repo: str) -> DataFrame:
    """The edits within a repository, under their path from its root, on the commit whose window holds them (``sha``; NULL while there is none)."""
    inside = edits.withColumn("path", S.relative_to(F.col("path"), F.lit(repo))).where("path is not null")
    return joins.interval_join(inside, joins.windows_of(commits))


def bucket_edits(edits: DataFrame, commits: DataFrame, repo: str) -> DataFrame:
    """(sha, session, path, edits): how many edits of a session each commit holds for a file."""
    return place_edits(edits, commits, repo).where("sha is not null").groupBy("sha", "session", "path").agg(F.count(F.lit(1)).alias("edits"))


def not_recorded(rows: DataFrame, have: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Rows that are not recorded yet: none has their keys and a sha, however short, of which one begins the other."""
    probe, known = rows.select(*keys, "sha").distinct(), have.where("coalesce(sha, '') <> ''").select(*keys, F.col("sha").alias("_sha")).distinct()
    met = None
    for left, right in joins._prefix_keys(probe, known, "sha", "_sha", least):
        same = left["_k"] == right["_k"]
        for c in keys:
            same = same & left[c].eqNullSafe(right[c])
        part = left.join(right, same & (left["sha"].startswith(right["_sha"]) | right["_sha"].startswith(left["sha"])), "left_semi").select(*keys, "sha")
        met = part if met is None else met.unionByName(part)
    met = met.distinct()
    same = rows["sha"] == met["sha"]
    for c in keys:
        same = same & rows[c].eqNullSafe(met[c])
    return rows.join(met, same, "left_anti")


def commit_buckets(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Each commit's lines by author: (sha, added, agent, human, unattributed, unknown).

    ``files``: sha, path, added, added_gated of the patch; ``rows``: provenance with sha, files, agent_lines. Matchable lines of files
    that nobody proposed are unattributed; agents have what their rows say, together at most the rest; people the remainder; lines
    too short to match are unknown.
    """
    claimed = rows.groupBy("sha").agg(F.sum(F.coalesce("agent_lines", F.lit(0))).alias("claimed"))
    proposed = rows.select("sha", F.explode("files").alias("path")).distinct().withColumn("_p", F.lit(True))
    keep = F.col("added") - F.col("added_gated")
    per = files.join(proposed, ["sha", "path"], "left").groupBy("sha").agg(
        F.sum("added").alias("added"), F.sum("added_gated").alias("unknown"), F.sum(F.when(F.col("_p"), keep).otherwise(0)).alias("_mine"), F.sum(F.when(F.col("_p"), F.lit(0)).otherwise(keep)).alias("unattributed"),
    )
    agent = F.greatest(F.least(F.coalesce("claimed", F.lit(0)), F.col("_mine")), F.lit(0))
    return per.join(claimed, "sha", "left").select("sha", "added", agent.alias("agent"), F.greatest(F.col("_mine") - agent, F.lit(0)).alias("human"), "unattributed", "unknown")


def file_split(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Each file's lines by author: (sha, path, added, agent, human, unattributed, unknown).

    The agents' lines of a commit, as recorded, are dealt to the files that were proposed by their matchable lines, half to even, never more
    than a file has. A commit's most added file comes first where a view orders them.
    """
    claimed = rows.groupBy("sha").agg(F.sum(F.coalesce("agent_lines", F.lit(0))).alias("claimed"))
    proposed = rows.select("sha", F.explode("files").alias("path")).distinct().withColumn("_p", F.lit(True))
    keep = (F.col("added") - F.col("added_gated")).alias("keep")
    x = files.join(proposed, ["sha", "path"], "left").select("sha", "path", "added", "added_gated", keep, F.coalesce("_p", F.lit(False)).alias("_p"))
    pool = x.where("_p").groupBy("sha").agg(F.sum("keep").alias("pool")).join(claimed, "sha")
    dealt = F.when(F.col("_p") & (F.col("pool") > 0), F.least(F.bround(F.col("claimed") * F.col("keep") / F.col("pool")).cast("long"), F.col("keep"))).otherwise(F.lit(0))
    y = x.join(pool, "sha", "left").withColumn("agent", dealt)
    human, alone = F.when(F.col("_p"), F.greatest(F.col("keep") - F.col("agent"), F.lit(0))).otherwise(0), F.when(F.col("_p"), 0).otherwise(F.col("keep"))
    return y.select("sha", "path", "added", "agent", human.alias("human"), alone.alias("unattributed"), F.col("added_gated").alias("unknown"))
