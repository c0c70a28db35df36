import numpy as np

from loglattice.llm import vector_dedup


def brute(rows, low):
    use = {k: np.array(v, float) for k, (_, v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    n, up = dict.fromkeys(range(len(rows)), 0), {k: k for k in range(len(rows))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in use:
        for j in use:
            if i < j and rows[i][2] == rows[j][2] and len(use[i]) == len(use[j]) and use[i] @ use[j] / np.linalg.norm(use[i]) / np.linalg.norm(use[j]) >= low:
                n[i] += 1
                n[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[k][0]: (n[k], rows[root(k)][0]) for k in range(len(rows))}


def test_links_match_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for c in range(40):
        base = r.standard_normal(16)
        for _ in range(int(r.choice([1, 2, 5, 30]))):
            rows.append((base + r.standard_normal(16) * r.choice([0, 0.05, 0.15])).tolist())
    rows = [(k, [float(np.float32(x)) for x in v], int(k % 2)) for k, v in enumerate(rows)]
    k = len(rows)
    rows += [(k, None, 1), (k + 1, [0.0] * 16, 1), (k + 2, [float("nan")] * 16, 1), (k + 3, [None] * 16, 0), (k + 4, rows[0][1], None), (k + 5, [2 * x for x in rows[0][1]], 0), (k + 6, [], 0), (k + 7, [float("inf")] * 16, 0)]
    want = brute(rows, 0.93)
    got = {x.vec_id: x for x in vector_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect()}
    assert len(got) == len(rows)
    pairs = sum(a for a, _ in want.values())
    assert 0.995 * pairs <= sum(x.n_links for x in got.values()) <= pairs
    assert all(got[i].n_links <= want[i][0] for i in got)
    assert sum(got[i].component_id == want[i][1] for i in got) >= 0.995 * len(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_blocks_of_a_large_bucket(spark):
    rows = [(k, [1.0, 1e-4 * k, 0.0], 7) for k in range(1500)] + [(1500 + k, [0.0, 0.0, 1.0], 7) for k in range(100)]
    got = {x.vec_id: x for x in vector_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[k].n_links == 1499 and got[k].component_id == 0 for k in range(1500))
    assert all(got[k].n_links == 99 and got[k].component_id == 1500 for k in range(1500, 1600))
    assert vector_dedup.vector_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_labels_of_repeated_ids_stay_apart(spark):
    """An id that occurs under two labels: each row has the links of its own label."""
    r = np.random.default_rng(9)
    a, b = ([float(np.float32(x)) for x in r.standard_normal(16)] for _ in range(2))
    near = [float(np.float32(x + 0.01)) for x in b]
    rows = [(1, a, 0), (1, b, 1), (3, near, 1), (4, near, 0), (None, a, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "label as cls", "'x' as sig")
    got = sorted((x.vec_id or -1, x.n_links, x.component_id) for x in vector_dedup.vector_components(df).collect())
    assert got == [(-1, 1, 1), (1, 1, 1), (1, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_few_pairs_at_the_threshold_are_missed():
    """Recall by cosine in 64 dimensions, for a table of ten thousand vectors a label and of ten million."""
    r = np.random.default_rng(3)
    for n in (10_000, 10_000_000):
        tables, hashes = vector_dedup.shape_for(n, 0.93)
        for cosine, least in ((0.93, 0.994), (0.95, 0.998)):
            a, b = r.standard_normal((2, 3000, 64))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            b -= (a * b).sum(1, keepdims=True) * a
            b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
            met = (vector_dedup.codes_of(a, 1, tables, hashes) == vector_dedup.codes_of(b, 1, tables, hashes)).any(axis=1)
            assert met.mean() >= least
        strangers = r.standard_normal((2000, 64))
        codes = vector_dedup.codes_of(strangers / np.linalg.norm(strangers, axis=1, keepdims=True), 1, tables, hashes)
        assert np.mean([2000 - len(np.unique(codes[:, t])) for t in range(tables)]) < 0.05 * 2000  # unrelated vectors hardly meet


def test_the_query_finds_planted_pairs(spark, tmp_path):
    from loglattice.llm.queries import QUERIES

    r = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in r.standard_normal(64)], k % 3) for k in range(300)]
    rows += [(300 + k, [float(np.float32(x + 0.05 * r.standard_normal())) for x in rows[k][1]], k % 3) for k in range(60)]
    rows += [(400 + k, rows[k][1], (k + 1) % 3) for k in range(20)]  # near ones of another label
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.vec_id: (x.n_links, x.component_id) for x in QUERIES["op10_vector_dedup"](spark, str(tmp_path)).collect()}
    want = brute(rows, 0.93)
    assert want[0] == (1, 0) and want[300] == (1, 0) and got == want
