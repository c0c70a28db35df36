import math
import random
from collections import Counter

import numpy as np
import xxhash

from loglattice.llm import resampling


def test_rejects_what_labels_call_bad_and_keeps_the_rest(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    docs, labels, truth = [], [], {}
    for i in range(3000):
        bad = r.random() < 0.15
        text = [r.choice(words) for _ in range(r.choice([8, 40, 150]))]
        if bad:
            text = [w if r.random() > 0.1 else r.choice(["vile1", "vile2"]) for w in text] + ["vile1"]
        docs.append((i, " ".join(text)))
        truth[i] = not bad
        if r.random() < 0.5:
            labels.append((i, 1, int(bad)))
    docs += [(5000, None), (5001, "")]
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [x.doc_id for x in resampling.resample(d, n).collect()]
    assert sorted(got) == sorted(x.doc_id for x in resampling.resample(d, n).collect())
    kept = set(got)
    assert sum(i in kept for i, good in truth.items() if good) > 0.98 * sum(truth.values())
    assert sum(i in kept for i, good in truth.items() if not good) < 0.1 * (len(truth) - sum(truth.values()))
    assert {5000, 5001} <= kept
    ratio, threshold = resampling.fit(d, n)
    scored = resampling.score(d, ratio, threshold)
    keys = sorted((x.gumbel_key for x in scored.collect()), reverse=True)
    assert len(got) == scored.where("log_weight >= 0").count()
    for k in (1, 7, 100, len(keys)):
        assert resampling.kth_largest(scored, "gumbel_key", k) == keys[k - 1]


def test_empty_tables(spark):
    d, n = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampling.resample(d, n).count() == 0
    d = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, good string")
    assert resampling.keep_resampled(d, n).count() == 3


def test_against_a_plain_version(spark):
    """Counts, ratios, weights, keys and the drawn set, worked out document by document."""
    r = np.random.default_rng(5)
    good, bad = [f"good{k}" for k in range(50)], [f"junk{k}" for k in range(50)]
    texts = {k: " ".join(r.choice(good if k % 2 else bad, r.integers(1, 40))) for k in range(400)} | {400: "", 401: None}
    labels = {k: (int(k % 2), int(k % 14 == 1)) for k in range(0, 300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    table = spark.createDataFrame([(k, *x) for k, x in labels.items()], "doc_id long, quality int, toxic int")
    marks = {k: q == 1 and t == 0 for k, (q, t) in labels.items()}
    held = {k for k in marks if xxhash.xxh3_64_intdigest(str(k)) % resampling.HELD_OUT == 0}
    grams = {k: resampling.gram_buckets(x).tolist() for k, x in texts.items()}
    raw = Counter(b for g in grams.values() for b in g)
    fine = Counter(b for k, g in grams.items() if marks.get(k) and k not in held for b in g)
    rate = sum(fine.values()) / sum(raw.values())

    def log_ratio(b):
        x = math.log((fine[b] + resampling.PRIOR) / (raw[b] * rate + resampling.PRIOR))
        return math.copysign(max(0.0, abs(x) - resampling.SHRINK), x)

    whole = {k: sum(map(log_ratio, g)) for k, g in grams.items()}
    cut = resampling._threshold(np.array([whole[k] / len(grams[k]) for k in sorted(held)]), np.array([marks[k] for k in sorted(held)]))
    weight = {k: whole[k] - len(g) * cut for k, g in grams.items()}
    noise = lambda k: -math.log(-math.log(float(resampling.uniform(resampling.mix64(np.array([xxhash.xxh3_64_intdigest(str(k))], np.uint64)))[0])))
    key = {k: weight[k] + noise(k) for k in texts}
    for share, k in ((None, sum(w >= 0 for w in weight.values())), (0.1, 41)):
        drawn = {x.doc_id: x for x in resampling.resample(docs, table, share).collect()}
        assert set(drawn) == set(sorted(key, key=key.get, reverse=True)[:k])
        assert all(abs(x.log_weight - weight[i]) < 1e-6 and abs(x.gumbel_key - key[i]) < 1e-6 and x.n_grams == len(grams[i]) for i, x in drawn.items())
