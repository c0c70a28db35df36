"""Registered views of what recording makes of calls and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.plans.registry import query
from loglattice.sources import records
from loglattice.sources.ledger import calls, table


@query("SELECT agent, count(*) AS calls, count(*) AS twins, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(coalesce(tokens_out, 0)) AS BIGINT) AS tokens_out FROM calls GROUP BY agent")
def recorded_calls(spark, d):
    """All calls as a program records them, each with a twin of its own that names it; equal ones stay as many as they are."""
    use = calls(spark, d).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("session").cast("string").alias("session"), "agent", "tokens_in", "tokens_out")
    made, twins = records.calls(use, "whole")
    n = made.groupBy("agent").agg(F.count_distinct("id").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return n.join(twins.groupBy("agent").agg(F.count_distinct("call").alias("twins")), "agent")


RECEIPTS_SQL = """SELECT tool, CASE WHEN unit NOT IN ('tokens', 'usd', 'ms', 'gco2') THEN 'unit' WHEN method NOT IN ('measured', 'modeled', 'estimated') THEN 'method' WHEN NOT regexp_full_match(tool, '[a-z0-9][a-z0-9_-]*') OR tool = 'calls' THEN 'tool' ELSE '' END AS reason, raw, actual
 FROM (SELECT CASE l_linenumber WHEN 1 THEN 'graph' WHEN 2 THEN 'calls' WHEN 3 THEN '../graph' ELSE 'compress-' || l_linenumber END AS tool, CASE WHEN l_suppkey % 7 = 0 THEN 'hours' WHEN l_suppkey % 7 = 1 THEN 'ms' ELSE 'tokens' END AS unit, CASE WHEN l_partkey % 11 = 0 THEN 'guess' ELSE 'modeled' END AS method, l_partkey AS raw, l_quantity AS actual FROM lineitem)"""


@query(f"SELECT tool, reason, count(*) AS n, CASE WHEN reason = '' THEN count(*) ELSE 0 END AS ids, round(CAST(sum(raw - actual) AS DOUBLE), 2) AS saved FROM ({RECEIPTS_SQL}) GROUP BY tool, reason")
def recorded_savings(spark, d):
    """Receipts of tools: what is recorded under ids of its own and what is refused, with the reason; lines of orders stand for the runs."""
    k = F.col("l_linenumber")
    tool = F.when(k == 1, "graph").when(k == 2, "calls").when(k == 3, "../graph").otherwise(F.concat(F.lit("compress-"), k.cast("string")))
    unit = F.when(F.col("l_suppkey") % 7 == 0, "hours").when(F.col("l_suppkey") % 7 == 1, "ms")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("call"), tool.alias("tool"), unit.alias("unit"), F.when(F.col("l_partkey") % 11 == 0, "guess").alias("method"), F.col("l_partkey").alias("raw_alternative"), F.col("l_quantity").alias("actual"))
    made, refused = records.savings(x, "whole")
    both = made.withColumn("reason", F.lit("")).unionByName(refused, allowMissingColumns=True)
    return both.groupBy("tool", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.round(F.sum("saved"), 2).alias("saved"))
