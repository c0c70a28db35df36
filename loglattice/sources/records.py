"""Rows that programs record: metered calls with their consumer twins, receipts, savings of tools and tasks.

Each maker gives whole rows from what was measured, and what it refuses with a reason. ``record`` publishes all of one recording, of
whatever kinds, in one move, so a call is never seen without its twin, and a recording that runs again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loglattice.functions import scalars as S
from loglattice.sources.homes import RESERVED
from loglattice.sources.published import Ledger

#: What a saving is counted in, and how it is known (fixed values).
UNITS = ["tokens", "usd", "ms", "gco2"]
METHODS = ["measured", "modeled", "estimated"]
TOOL = r"^[a-z0-9][a-z0-9_-]*$"

CALL = """ts string, route string, provider string, model string, tokens_in bigint, tokens_out bigint, cached_in bigint, cache_write_in bigint, session string, task string, agent string,
 project string, scope string, latency_ms bigint, ok boolean, retries bigint"""
RECEIPT = "ts string, tool string, call string, session string, task string, op string, unit string, raw_alternative double, actual double, method string, confidence double, source_files bigint"
TASK = "ts string, id string, type string, outcome string, agents array<string>, human_minutes double, commit string, files_changed bigint"
#: What stands where nothing was given (fixed values); other texts are empty, other numbers 0.
GIVEN = {"agent": "lib", "ok": True, "unit": "tokens", "method": "modeled", "confidence": 1.0, "commit": None, "outcome": None, "human_minutes": None, "type": None, "agents": None, "files_changed": None}


def _whole(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in their types; those that are missing or NULL as ``GIVEN`` says. Other columns stay out."""
    have = {c.lower() for c in rows.columns}
    out = []
    for f in StructType.fromDDL(schema).fields:
        value = F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        default = GIVEN[f.name] if f.name in GIVEN else {"string": "", "bigint": 0, "double": 0.0}.get(f.dataType.simpleString())
        out.append((value if f.name == "ts" or default is None else F.coalesce(value, F.lit(default))).alias(f.name))
    return rows.select(*out)


def _numbered(rows: DataFrame, prefix: str, batch: str) -> DataFrame:
    """Rows with an ``id`` from what they hold and the batch they are recorded in. Rows equal in all are told apart by their number, counted before they
    are dealt out, so a task that runs again gives the same ids."""
    names = rows.columns
    same = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return same.select(S.short_id(prefix, F.lit(batch), text, F.col("_k").cast("string")).alias("id"), *names)


def calls(measured: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """(calls, consumer rows): every call is told twice, and its twin names the call, so that spend counts it once. Equal calls are as many calls."""
    rows = _numbered(_whole(measured, CALL), "c_", batch)
    twins = rows.select(S.short_id("m_", F.lit("twin"), F.col("id")).alias("id"), F.col("id").alias("call"), F.lit("call").alias("source"), *(c for c in rows.columns if c != "id"))
    return rows, twins


def _refusal(of_tool: bool) -> Column:
    bad_tool = ~F.col("tool").rlike(TOOL) | F.col("tool").isin(RESERVED)
    why = F.when(~F.col("unit").isin(UNITS), "unit").when(~F.col("method").isin(METHODS), "method")
    return why.when(bad_tool, "tool") if of_tool else why


def _saved(rows: DataFrame, of_tool: bool, prefix: str, batch: str) -> tuple[DataFrame, DataFrame]:
    whole = _whole(rows, RECEIPT).withColumn("saved", F.col("raw_alternative") - F.col("actual")).withColumn("_why", _refusal(of_tool))
    return _numbered(whole.where("_why is null").drop("_why"), prefix, batch), whole.where("_why is not null").withColumnRenamed("_why", "reason")


def receipts(rows: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """(receipts, refused): ``saved`` follows from what would have been used and what was; a unit or method that is not known is refused."""
    return _saved(rows, False, "r_", batch)


def savings(rows: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """(savings of tools, refused): as receipts; a tool's name is also that of its folder, so it must be a plain word and no other kind's.

    A row may bring an ``id`` of its own, made from what its run held: it keeps it, and equal ids are one row, the smallest.
    """
    if "id" not in rows.columns:
        return _saved(rows, True, "s_", batch)
    made, refused = _saved(rows.where("coalesce(id, '') = ''"), True, "s_", batch)
    whole = _whole(rows, RECEIPT + ", id string").where("id <> ''").withColumn("saved", F.col("raw_alternative") - F.col("actual")).withColumn("_why", _refusal(True))
    rest = [c for c in made.columns if c != "id"]
    own = whole.where("_why is null").groupBy("id").agg(F.min(F.struct(*rest)).alias("_r")).select("id", "_r.*")
    return made.unionByName(own), refused.unionByName(whole.where("_why is not null").withColumnRenamed("_why", "reason").drop("id"))


def tasks(rows: DataFrame) -> DataFrame:
    """Rows of tasks: what was not said stays NULL, so that a later row, folded over an earlier one, takes nothing away. Agents are told once, in order."""
    whole = _whole(rows, TASK)
    agents = F.array_sort(F.array_distinct(F.filter("agents", lambda a: F.coalesce(a, F.lit("")) != "")))
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    return whole.where("id <> ''").withColumns({"agents": F.when(F.size(agents) > 0, agents), "type": said("type"), "outcome": said("outcome"), "commit": said("commit")})


def record(ledger: Ledger, batch: int, writer: str, measured: DataFrame | None = None, receipt: DataFrame | None = None, saving: DataFrame | None = None, task: DataFrame | None = None) -> bool:
    """Publish a recording as one batch; False if it is there already. Refused rows are published beside the others as kind ``refused``."""
    tables, refused, name = {}, None, f"{batch}|{writer}"
    if measured is not None:
        tables["calls"], tables["consumer"] = calls(measured, name)
    for kind, rows, make in (("receipts", receipt, receipts), ("savings", saving, savings)):
        if rows is not None:
            tables[kind], bad = make(rows, name)
            bad = bad.withColumn("of", F.lit(kind))
            refused = bad if refused is None else refused.unionByName(bad)
    if refused is not None:
        tables["refused"] = refused
    if task is not None:
        tables["tasks"] = tasks(task)
    return ledger.publish(batch, writer, tables)
