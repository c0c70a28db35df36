"""Connected components by contraction, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.runtime import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node id reachable; nodes without an edge have no row.

    ``edges`` has long columns ``src`` and ``dst`` in any direction, with repeats and loops. Each round every
    node hooks to the neighbour (or itself) that comes first in a hashed order, edges are renamed to
    the hooks, and what collapses to a loop goes; the hashed order makes long chains shrink by a constant
    factor a round. Minima are partially aggregated before they are shuffled, and each rename joins two
    tables read from storage, so that a hub's edges can be split.
    """
    work = materialize(edges.where("src <> dst").select("src", "dst"), "cc-edges")
    names = None
    while not work.isEmpty():
        both = work.select("src", "dst").unionByName(work.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        hook = both.groupBy("src").agg(F.min(order("dst")).alias("m")).select(F.col("src").alias("node"), F.least(F.col("m"), order("src"))["id"].alias("up"))
        hook = materialize(hook, "cc-hooks")
        if names is None:
            names, spent = hook, None
        else:
            renamed = names.join(hook.select(F.col("node").alias("up"), F.col("up").alias("next")), "up", "left").select("node", F.coalesce("next", "up").alias("up"))
            names, spent = materialize(renamed, "cc-names", (names,)), hook
        moved = work.join(hook.select(F.col("node").alias("src"), F.col("up").alias("a")), "src").join(hook.select(F.col("node").alias("dst"), F.col("up").alias("b")), "dst")
        pairs = moved.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        work = materialize(pairs, "cc-edges", (work, spent))
    if names is None:
        return work.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    least = materialize(names.groupBy("up").agg(F.min("node").alias("component")), "cc-least")
    return materialize(names.join(least, "up").select("node", "component"), "cc-out", (names, least, work))
