"""Spelling variants against a plain version: every pair of words compared, every occurrence hashed on its own."""

import random
import re
import zlib
from collections import Counter

import pytest

from loglattice.llm import errata_trie

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    n = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= 2 * n[w] else None for w in n}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_each_pair_is_found_once(seed):
    r = random.Random(seed)
    letters = "abéc"[: 1 + seed % 4]
    words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 8))) for _ in range(100)})
    got = Counter(frozenset(p) for p in errata_trie.subtree_pairs(words, 0))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if a < b and is_near(a, b)} and set(got.values()) <= {1}


def corpus():
    r = random.Random(5)
    stems = ["".join(r.choice("abeéZ") for _ in range(r.randrange(4, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "strasse", "straße", "École", "écoles"]
    words = [w[:k] + r.choice(["", "a", "éb"]) + w[k + 1 :] for w in stems for k in range(len(w))] + stems * 3
    text = lambda: "".join(r.choice(words) + r.choice([" ", ", ", " ", "’", "1", "_", "ā"]) for _ in range(400))
    return [(k, text()) for k in range(12)] + [(3, "aaaaaa aaaaaa"), (3, "aaaaaa aaaaaa"), (None, "aaaaab aaaaab aaaaab"), (50, None), (51, ""), (52, "ababa " * 30000), (53, "x" * 700 + " " + "x" * 700 + " " + "x" * 700)]


@pytest.mark.parametrize("subtree", [1, 7, 100_000])
def test_equals_the_plain_version_however_the_trie_is_cut(spark, subtree):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "w", k) for k, t in rows], "doc_id long, text string, word string, n long").repartition(3)
    got = errata_trie.spelling_variants(docs, subtree=subtree).collect()
    want = plain(rows)
    assert len(got) == len(want) > 100 and sum(1 for v in want.values() if v[0]) > 20
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == want


def test_counting_does_not_depend_on_how_much_is_held(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(x) for x in errata_trie.word_counts(docs).collect()}
    runs, slips, counts = errata_trie.Runs(), {}, errata_trie.np.zeros(0, errata_trie.np.int64)
    total = Counter()
    for key, text in rows:
        counts = errata_trie.count_batch([key], [text or ""], runs, slips, counts)
        total.update({w: n for w, n in zip(runs.words, counts.tolist())})
        total.update(slips)
        runs, slips, counts = errata_trie.Runs(), {}, errata_trie.np.zeros(0, errata_trie.np.int64)
    assert whole == {(w, n) for w, n in total.items() if len(w) >= 5 and n >= 3}


def test_large_nodes_are_those_of_the_plain_count(spark):
    words = ["".join(p) for p in __import__("itertools").product("abc", repeat=5)] + ["abcdefghijk", "abcdefghijkl", "abcdefghijkm"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    for limit in (1, 2, 5, 30):
        got = errata_trie.large_nodes(df, limit)
        below = Counter(w[:k] for w in words for k in range(len(w) + 1))
        want = {}
        for u, n in below.items():
            kids = {p[-1]: m for p, m in below.items() if p[:-1] == u and p}
            if n > limit and kids:
                want[u] = min(kids, key=lambda c: (-kids[c], c))
        assert {u: c for u, c in got.items() if below[u] > limit} == want


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = errata_trie.spelling_variants(empty)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
