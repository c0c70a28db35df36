"""Capture as a stream: logs that have changed are read, parsed and published batch by batch, each batch once.

A leg turns the lines of a batch into rows of its kind. Whole legs (chats) are recomputed from all files of the sessions that a batch
touches and replace those sessions; other legs add the rows whose ids are not there yet. The checkpoint of the stream names the
writer, and its batch ids are the ledger's, so a batch that was killed runs again under its own number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import authorship
from loglattice.sources.log_source import listing, register
from loglattice.sources.published import Ledger

Parse = Callable[[DataFrame], DataFrame]


@dataclass
class Capture:
    """``legs``: kind to parser of lines (file, line_no, line) into rows with id and ts.

    ``authored``: where authorship is captured, a parser of lines into edits (``authorship.EDIT``), the repository's root and a function that
    reads its log as it is now. Edits that wait for a commit are published as kind ``pending`` with each batch. The repository's log lies below
    ``path`` too, under a name that ``glob`` takes, so that a commit is a change like any other and settles what waits for it.
    """

    spark: SparkSession
    path: str
    root: str
    checkpoint: str
    legs: dict[str, Parse] = field(default_factory=dict)
    authored: tuple[Parse, str, Callable[[], authorship.CommitLog]] | None = None
    glob: str = "*.jsonl"
    #: Called with the batch id when its rows are staged and before they are published; for tests that kill it there.
    before_publish: Callable[[int], None] | None = None

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, self.root)

    def run(self) -> None:
        """Publish what has changed since the last run, and return: what a view calls before it reads."""
        register(self.spark)
        lines = self.spark.readStream.format("agent_logs").option("path", self.path).option("glob", self.glob).load()
        query = lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def _batch(self, lines: DataFrame, batch: int) -> None:
        writer = lines.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "by hand"
        self.publish(lines, batch, writer)

    def publish(self, lines: DataFrame, batch: int, writer: str) -> bool:
        """One batch: parse, leave out what is known, publish all kinds together. The lines are read once and kept on disk meanwhile."""
        lines = lines.persist()
        try:
            ledger = self.ledger
            tables = {kind: ledger.unseen(parse(lines), kind) for kind, parse in self.legs.items()}
            if self.authored:
                parse, repo, read_log = self.authored
                have = ledger.scan("provenance", authorship.ROW).drop("batch")
                edits = ledger.newest("pending", authorship.EDIT).unionByName(parse(lines))
                rows, waiting = authorship.capture(edits, read_log(), have, repo)
                tables |= {"provenance": rows, "pending": waiting}
            return ledger.publish(batch, writer, tables, self.before_publish)
        finally:
            lines.unpersist()


# --- sessions recomputed whole ---

#: Partitions of a table of folded sessions; those that share one are folded together.
PARTS = 4096


def session_log(file: Column) -> Column:
    """The main log of a file's session: a subagent's log belongs to the session in whose folder it lies."""
    return F.regexp_replace(file, r"/([^/]+)/subagents/[^/]+$", "/$1.jsonl")


def _part(file: Column) -> Column:
    return F.pmod(F.xxhash64(session_log(file)), F.lit(PARTS)).cast("int")


def refold(spark: SparkSession, path: str, touched: DataFrame, fold: Parse, root: str, glob: str = "*.jsonl") -> int:
    """Fold the sessions of the ``touched`` logs (``file``) anew, each from all of its files, and replace just their partitions; gives how many.

    ``fold`` takes lines with ``main``, the main log of their session, and gives rows that keep it. Only files of touched partitions are
    opened; other partitions' files are not written. A session whose logs are gone keeps its rows, as nothing touches it.
    """
    register(spark)
    parts = {r["p"] for r in touched.select(_part(F.col("file")).alias("p")).distinct().toLocalIterator()}  # at most PARTS
    if not parts:
        return 0
    names = spark.createDataFrame([(f[0],) for f in listing(path, glob)], "file string")
    mine = [r["file"] for r in names.where(_part(F.col("file")).isin(list(parts))).toLocalIterator()]  # names, as of any listing
    lines = spark.read.format("agent_logs").option("path", path).option("glob", glob).option("pushdown", "true").load().where(F.col("file").isin(mine))
    rows = fold(lines.withColumn("main", session_log(F.col("file")))).withColumn("part", _part(F.col("main")))
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(root)
    return len(parts)
