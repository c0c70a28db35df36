"""Late better rows on a stream: the result is that of the fold over a table, in any order and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import fold
from loglattice.streaming import supersede

ROW = "source string, session string, turn long, row_ref long, turns long, tokens_in long, tokens_out long, id string"
KEYS = ["source", "session", "turn", "row_ref"]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_fold_in_any_order_and_after_a_restart(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [("k", f"s{k % 5}", k % 3, k % 2, r.randrange(4) if k % 7 else None, r.randrange(3), r.randrange(3), f"i{k}") for k in range(120)]
    r.shuffle(rows)
    for key, value in supersede.STORE.items():
        spark.conf.set(key, value)
    given, told, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")

    def add(part):
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(given)

    def run():
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(given).withColumn("_tokens", F.col("tokens_in") + F.col("tokens_out"))
        out = supersede.superseding(stream, KEYS, ["turns", "_tokens", "id"])
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{told}/batch={batch}")
        out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    add(rows[:40])
    add(rows[40:60])
    run()
    add(rows[60:])
    run()
    got = supersede.current(spark.read.parquet(told).drop("batch"), KEYS).drop("_tokens")
    want = fold.kiro_fold(spark.createDataFrame(rows, ROW))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert spark.read.parquet(told).where("version > 1").count() > 0
