"""Logs of one kind that lie in several homes, as agents' tools leave them: one file from before there were months, files by month, trees of tools.

Rows of all homes are read together, each with ``home``: the place of its home among those asked for, the oldest first. A file named
after a month is not opened if all of that month is before ``since``; one without a month always is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loglattice.operators.joins import union_first_wins

#: Where each kind lies below a root, the oldest home first (fixed values). Other kinds: ``<kind>.jsonl``, then ``<kind>-<month>.jsonl``.
HOMES = {
    "provenance": ["ledger/provenance.jsonl", "ledger/provenance/provenance*.jsonl"],
    "imports": ["ledger/imports.jsonl", "state/imports.jsonl"],
    "savings": ["ledger/savings/*/savings.jsonl", "ledger/savings/*/savings-*.jsonl", "ledger/*/savings.jsonl", "ledger/*/savings-*.jsonl"],
}
#: Folders of a ledger that are no tool's (fixed values): agents, other producers, and kinds.
RESERVED = ["claude", "copilot", "kiro", "consumer", "provenance", "savings", "calls", "receipts", "tasks", "imports", "credits", "usage", "attest"]

_MONTH = re.compile(r"-(\d{4}-\d{2})\.jsonl$")


def patterns_of(kind: str) -> list[str]:
    return HOMES.get(kind, [f"ledger/{kind}.jsonl", f"ledger/{kind}-*.jsonl"])


def _files(spark: SparkSession, root: str, pattern: str, since: str | None) -> list[str]:
    """The files of a pattern that can hold rows of ``since`` or later: a listing of names, one a tool and month."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    named = [s.getPath().toString() for s in found if s.isFile()]
    month = lambda p: (m := _MONTH.search(p)) and m[1]
    tool = lambda p: p.rsplit("/", 2)[1]
    own = [p for p in named if not pattern.startswith("ledger/*/") or tool(p) not in RESERVED]
    return [p for p in own if not (since and month(p) and month(p) < since[:7])]


def read_kind(spark: SparkSession, root: str, kind: str, schema: str, since: str | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Rows of a kind from all of its homes, with ``home`` and ``folder`` (that of the file). No home at all is an empty table.

    Blank and broken lines, such as the last one of a log cut off, are skipped; a value of the wrong type is NULL and its row
    stays. ``since`` drops older rows (their ``ts`` is text); rows without a time stay.
    """
    lines = None
    for home, pattern in enumerate(patterns or patterns_of(kind)):
        paths = _files(spark, root, pattern, since)
        if paths:
            part = spark.read.text(paths).select("value", F.lit(home).alias("home"), F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder"))
            lines = part if lines is None else lines.unionByName(part)
    if lines is None:
        return spark.createDataFrame([], f"{schema}, home int, folder string")
    whole = lines.where("trim(value) <> '' and try_parse_json(value) is not null")
    rows = whole.select(F.from_json("value", StructType.fromDDL(schema)).alias("r"), "home", "folder").where("r is not null").select("r.*", "home", "folder")
    return rows.where(F.col("ts").isNull() | (F.col("ts") >= since)) if since else rows


def savings(spark: SparkSession, root: str, schema: str, since: str | None = None) -> DataFrame:
    """What tools report to have saved, from the old tree and the tools' own folders; of rows that share an id the oldest home's stands, of one home the
    smallest. Rows without an id all stay. Any folder that is not reserved is a tool's."""
    rows = read_kind(spark, root, "savings", schema, since)
    rest = [c for c in rows.columns if c != "id"]
    order = ["home", *(c for c in rest if c != "home")]
    one = rows.where("id is not null").groupBy("id").agg(F.min(F.struct(*order)).alias("_r")).select("id", *(F.col(f"_r.{c}").alias(c) for c in rest))
    return one.unionByName(rows.where("id is null"))


def receipts(spark: SparkSession, root: str, schema: str, since: str | None = None) -> DataFrame:
    """Receipts of calls and what tools report, in one table: the tools' rows first, of the others those with other ids."""
    return union_first_wins(savings(spark, root, schema, since), read_kind(spark, root, "receipts", schema, since), "id")
