"""Views over time that hold for tables and streams alike: give a stream a watermark first (``late``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(rows: DataFrame, by: str, at: str = "ts") -> DataFrame:
    """Rows later than ``by`` are dropped by a stream, and its state with them; a table is left as it is."""
    return rows.withWatermark(at, by) if rows.isStreaming else rows


def _sums(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"))


def tumbling(rows: DataFrame, size: str, at: str = "ts") -> DataFrame:
    return _sums(rows.groupBy(F.window(at, size).alias("w"), "agent")).select(F.col("w.start").alias("bucket"), "agent", "n", "tokens_in")


def sliding(rows: DataFrame, size: str, slide: str, at: str = "ts") -> DataFrame:
    return _sums(rows.groupBy(F.window(at, size, slide).alias("w"), "agent")).select(F.col("w.start").alias("bucket"), "agent", "n", "tokens_in")


def sessions(rows: DataFrame, gap: str, at: str = "ts") -> DataFrame:
    """Runs of a session's rows with less than ``gap`` between one and the next."""
    x = rows.groupBy("session", F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return x.select("session", F.col("w.start").alias("bucket"), F.col("w.end").alias("until"), "n")


def deduped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key. A stream keeps keys until its watermark has passed them."""
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)
