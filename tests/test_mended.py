from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loglattice.operators import fold
from loglattice.plans import registry


@pytest.mark.parametrize("name", ["graphify_chats", "savings_topk"])
def test_savings_at_a_half_are_the_same_in_any_order(spark, tmp_path, name):
    amounts = [(96371.32, 0.06), (39706.07, 0.09), (78467.45, 0.01)]  # 10140.5000 together
    lines = [(k, p, x, "N") for k, some in enumerate(permutations(amounts)) for p, x in some] + [(6, 1e-7, 0.5, "A"), (6, 2.5, 1.0, "A"), (7, None, 0.5, "R"), (8, -5.0, 0.5, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double, l_discount double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "x") for k in range(10)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["session"]: r["saved"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert [got.get(k) for k in range(10)] == [10141] * 6 + [3, None, -3, None]


def test_notes_are_merged_in_tasks_that_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fold, "TASK_ROWS", 500, raising=False)
    lines = [(k, k % 7, "ANR"[k % 2]) for k in range(3000)] + [(-1, k, "N") for k in range(2000)] + [(-1, None, "A"), (None, 1, None), (None, 1, "R"), (5000, 1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["notes_plan"](spark, str(tmp_path))
    rows = {r["sha"]: (r["rows_"], r["methods"]) for r in got.collect()}
    assert rows == {**{k: (1, 1) for k in range(3000)}, -1: (2001, 2), None: (1, 1), 5000: (1, 0)}
    # 10,008 rows, both tables together: as many tasks as it takes, and none holds much more than its share.
    tasks = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(tasks) == 21 and max(tasks) < 500
