"""Agents' logs as a Spark data source, for tables and streams: lines with file and number, files that have grown read again.

``spark.read.format("agent_logs").option("path", …)`` gives every line of every log below the path, and ``readStream`` those of the files
that are new or have changed since the last batch. A log is read in pieces, line by line, so none has to fit into memory; small logs share a
task. Logs have to lie where the driver and all executors see them.

A stream's offset is the latest change of any file so far, and the files that have just that: a file that grows changes
later, so its lines come again, with the same numbers, and the ids made of them tell what is known.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

SCHEMA = "file string, line_no long, line string"
#: Bytes of logs that one task reads, as far as whole logs allow.
TASK_BYTES = 32 << 20
#: Lines handed on at once, and their bytes at most.
BATCH_LINES, BATCH_BYTES = 10_000, 8 << 20


def listing(path: str, glob: str) -> list[tuple[str, int, int]]:
    """(file, size, time of change in nanoseconds) of every log below a folder, or of one log. ``glob``: several, set apart by commas."""
    if os.path.isfile(path):
        s = os.stat(path)
        return [(path, s.st_size, s.st_mtime_ns)]
    out = []
    for folder, _, names in os.walk(path):
        for name in (n for n in names if any(fnmatch.fnmatch(n, g) for g in glob.split(","))):
            try:
                s = os.stat(os.path.join(folder, name))
            except FileNotFoundError:  # gone since it was listed
                continue
            out.append((os.path.join(folder, name), s.st_size, s.st_mtime_ns))
    return sorted(out)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


def shared_out(files: list[tuple[str, int, int]], size: int) -> list[Files]:
    """Files dealt to tasks in order, each with about ``size`` bytes."""
    out: list[list[str]] = []
    held = size
    for name, n, _ in files:
        if held + n > size:
            out.append([])
            held = 0
        out[-1].append(name)
        held += n
    return [Files(x) for x in out]


def read_lines(names: list[str]) -> Iterator[pa.RecordBatch]:
    """The lines of logs in batches. A last line without an end is left for when it has one, unless it is whole JSON; bytes that are no UTF-8 are replaced."""
    rows: tuple[list, list, list] = ([], [], [])
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["file", "line_no", "line"])

    for name in names:
        try:
            log = open(name, "rb")
        except FileNotFoundError:
            continue
        with log:
            for k, raw in enumerate(log):
                text = raw.decode("utf-8", "replace").strip()
                if not text or (not raw.endswith(b"\n") and not _whole(text)):
                    continue
                rows[0].append(name)
                rows[1].append(k)
                rows[2].append(text)
                held += len(text)
                if len(rows[0]) >= BATCH_LINES or held >= BATCH_BYTES:
                    yield batch()
                    rows, held = ([], [], []), 0
    if rows[0]:
        yield batch()


def _whole(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class AgentLogs(DataSource):
    """Options: ``path``, ``glob`` (*.jsonl), ``taskBytes``, ``pushdown`` (false)."""

    @classmethod
    def name(cls) -> str:
        return "agent_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteringLogReader if self.options.get("pushdown") == "true" else LogReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self.options)


def register(spark) -> None:
    """Make the source known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AgentLogs)


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob, self.size = options["path"], options.get("glob", "*.jsonl"), int(options.get("taskBytes", TASK_BYTES))
        self.only: set[str] | None = None

    def partitions(self) -> list[Files]:
        return shared_out([f for f in listing(self.path, self.glob) if self.only is None or f[0] in self.only], self.size)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read_lines(partition.value if partition else [])


class FilteringLogReader(LogReader):
    """Spark keeps what a reader was asked for with the load, so a load with filters serves one question; ``pushdown`` asks for it."""

    def pushFilters(self, filters):
        """Files asked for by name are the only ones that are read."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.glob, self.size = options["path"], options.get("glob", "*.jsonl"), int(options.get("taskBytes", TASK_BYTES))

    def initialOffset(self) -> dict:
        return {"changed": -1, "files": []}

    def latestOffset(self) -> dict:
        files = listing(self.path, self.glob)
        last = max((f[2] for f in files), default=-1)
        return {"changed": last, "files": [f[0] for f in files if f[2] == last]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        """Files changed after the start. One that has changed after the end as well is read now and, changed again, by the next batch."""
        known = set(start["files"])
        return shared_out([f for f in listing(self.path, self.glob) if f[2] > start["changed"] or (f[2] == start["changed"] and f[0] not in known)], self.size)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read_lines(partition.value if partition else [])

    def commit(self, end: dict) -> None:
        pass
