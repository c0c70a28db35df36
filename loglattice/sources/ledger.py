"""Ledger tables: permissive JSONL, and the stand-ins that the generated tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSONL log; blank and broken lines are skipped, a value of the wrong type is NULL and its row stays."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = lines.where(F.expr("try_parse_json(value) is not null"))
    return whole.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row")).where("row is not null").select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage calls: one an event; credits are recorded for purchases alone."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("session"), F.col("event_type").alias("agent"),
        (k * 100).alias("tokens_in"), F.floor("value").cast("long").alias("tokens_out"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("credits"),
    )


#: The same in DuckDB SQL.
CALLS_SQL = """SELECT event_id AS id, ts, user_id AS session, event_type AS agent, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS tokens_in,
 CAST(floor(value) AS BIGINT) AS tokens_out, CASE WHEN event_type = 'purchase' THEN value END AS credits FROM events"""
