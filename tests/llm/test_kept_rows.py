"""Rows that resampling keeps, against a join with the ids drawn."""

import numpy as np
from pyspark.sql import functions as F

from loglattice.llm import resampling


def test_rows_stay_by_their_ids_and_texts_are_not_shuffled(spark):
    r = np.random.default_rng(3)
    word = lambda k: " ".join(f"{'good' if k % 2 else 'junk'}{x}" for x in r.integers(0, 40, r.integers(1, 30)))
    rows = [(k, word(k), float(k), "en") for k in range(600)] + [(k, word(k + 1), None, None) for k in range(0, 80, 3)] + [(None, "junk1 junk2", 1.0, "x"), (None, None, 2.0, None), (700, None, None, "y"), (701, "", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_grams double, lang string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 400)], "doc_id long, quality int, toxic int")
    drawn = {x["doc_id"] for x in resampling.resample(docs, labels).collect()} - {None}
    got = resampling.keep_resampled(docs, labels)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(x) for x in rows if x[0] is None or x[0] in drawn)
    scored = {}
    for x in resampling.score(docs, *resampling.fit(docs, labels)).collect():
        scored.setdefault(x["doc_id"], set()).add(x["gumbel_key"])
    assert any(len(v) > 1 for v in scored.values())  # repeated ids with different texts are among them
    one = docs.where("doc_id is null or doc_id >= 80")  # no id repeats: the kept rows come from their own partitions
    plan = resampling.keep_resampled(one.withColumn("lang", F.upper("lang")), labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
