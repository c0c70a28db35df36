import random

import numpy as np

from loglattice.llm import jaccard
from loglattice.llm.graph import connected_components


def brute(rows, words, percent):
    def shingle_set(text):
        w = [x for x in (text or "").encode().lower().split()]
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 100 * n >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed=1, groups=12):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for g in range(groups):
        base = r.choices(vocabulary, k=r.choice([3, 30, 120, 200]))
        for _ in range(r.choice([1, 2, 5, 40])):
            words = [w if r.random() > 0.012 else r.choice(vocabulary) for w in base]
            if r.random() < 0.3:
                words += passage
            rows.append(" ".join(words))
    rows += [None, "", "  \n", "one", "One", "one two", passage and " ".join(passage), "x " * 5000]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(spark):
    for words, percent in ((4, 85), (5, 80)):
        rows = corpus(words)
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, words, percent)


def test_repeats_nulls_and_other_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A B C D E F", "y"), (None, "q r s t u", "z"), (3, None, "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    got = jaccard.jaccard_components(df, 4, 85).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 2, -1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]
    kept = jaccard.keep_one_of_each(df, 4, 85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 3]
    assert jaccard.jaccard_components(df.limit(0), 4, 85).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001 + k) for k in range(50)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1051)}


def test_words_that_hash_alike_elsewhere_stay_apart(spark):
    """Zero bytes, and words that any polynomial hash modulo a power of two takes for equal."""
    morse = "a"
    for _ in range(11):
        morse += morse.translate(str.maketrans("ab", "ba"))
    swapped = morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, "a b c d e"), (2, "a\0 b\0 c d e"), (3, f"{morse} b c d"), (4, f"{swapped} b c d"), (5, "A b C d e"), (6, f"{morse}\nb C\x0bd")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 3)]


def test_overlap_by_words():
    r = random.Random(4)
    for words in (1, 2, 4, 5):
        for size, kinds in ((0, 1), (3, 3), (4, 2), (12, 3), (300, 40), (40_000, 30_000)):
            a = [f"w{r.randrange(kinds)}" for _ in range(size)]
            b = a[: size // 2] + [f"W{r.randrange(kinds)}" for _ in range(size // 2)]
            p, q = ({tuple(x.lower() for x in w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set() for w in (a, b))
            assert jaccard.overlap_of_words(" ".join(a), "\t".join(b), words) == (len(p), len(q), len(p & q))


def test_prefixes_grow_where_shingles_are_common():
    """Also where all counters are far above what a byte holds; and no pair that meets the threshold is held back."""
    r = np.random.default_rng(6)
    counts = r.poisson(4000, 1 << 16)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64) << np.uint64(1)
    counts[(pool >> np.uint64(48)).astype(np.int64)] += 60_000
    sketch = np.rint(8 * np.log2(1.0 + counts)).astype(np.uint8)
    usual, longer, pairs = float(jaccard.COUNT_OF[sketch].mean()) + 1, 0, 0
    for _ in range(200):
        base = r.choice(pool, 150, replace=False)
        other = base.copy()
        k = int(r.integers(0, 40))
        other[:k] = r.integers(0, 1 << 63, k, dtype=np.uint64)
        a, b = np.sort(base), np.sort(other)
        (ga, pa), (_, pb) = (jaccard.prefix_of(x, sketch, usual, 85) for x in (a, b))
        longer += len(pa) > ga
        i = len(np.intersect1d(a, b))
        if 100 * i >= 85 * (300 - i):
            pairs += 1
            assert jaccard.demanded(pa, pb, 150, 150, 85)
    assert longer == 200 and pairs > 20
    far = np.sort(np.r_[base[:30], r.integers(0, 1 << 63, 120, dtype=np.uint64)])
    assert not jaccard.demanded(pa, jaccard.prefix_of(far, sketch, usual, 85)[1], 150, 150, 85)
