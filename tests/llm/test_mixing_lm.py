import math
import random
import zlib
from collections import Counter

import numpy as np

from loglattice.llm import mixing_lm as M
from loglattice.llm.runtime import hash_words


def corpus():
    r = random.Random(9)
    follow = {f"w{k}": [f"w{r.randrange(60)}" for _ in range(3)] for k in range(60)}
    rows = []
    for i in range(600):
        w, text = "w0", []
        for _ in range(r.choice([0, 1, 20, 200])):
            w = r.choice(follow[w]) if r.random() < 0.9 else f"w{r.randrange(60)}"
            text.append(w.upper() if r.random() < 0.1 else w)
            if r.random() < 0.02:
                text.append(f"rare{r.randrange(10**6)}")
        rows.append((i, " ".join(text)))
    return [*rows, (600, None), (None, "w1 w2"), (5, "w1\tw2\x0bw3"), (5, "w1\tw2\x0bw3")]


def test_base_columns_and_held_out_gain(spark):
    rows = corpus()
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(t for ts, o in zip(tokens, out, strict=True) if not o for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, o, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for (i, _), ts, o in zip(rows, tokens, out, strict=True))
    got = M.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)  # log-probabilities are negative
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    again = M.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(r.doc_id), round(r.score, 6)) for r in again)


def plain_scores(rows, coder):
    """The model in plain loops: counts of (context, beginning of a code) in dictionaries, words by their hashes."""
    docs = [(zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*hash_words((t or "").encode()).tolist(), int(M.END)]) for i, t in rows]
    totals = Counter(w for out, ws in docs if not out for w in ws)
    head = set(coder.head.tolist())
    inside, mass = Counter(w % 256 for w in totals if w not in head), Counter()
    for w, n in totals.items():
        mass[w % 256] += n if w not in head else 0

    def code(w):
        c, n, _ = coder(np.array([w], np.uint64))
        return format(int(c[0]), f"0{int(n[0])}b")

    codes = {w: code(w) for _, ws in docs for w in ws}
    seen = Counter()
    for out, ws in docs:
        for k, w in enumerate(ws):
            for context in contexts_of(ws, k) if not out else ():
                for d in range(len(codes[w]) + 1):
                    seen[context, codes[w][:d]] += 1
    start = M.Mixer().start
    for _, ws in docs:
        weights, score = {}, 0.0
        for lo in range(0, len(ws), M.BLOCK):
            step = {}
            for k in range(lo, min(lo + M.BLOCK, len(ws))):
                c = codes[ws[k]]
                for d in range(len(c)):
                    nodes = [seen[x, c[:d]] for x in contexts_of(ws, k)]
                    own = [seen[x, c[: d + 1]] for x in contexts_of(ws, k)]
                    odds = [M.STEP * max(-M.LEVELS, min(M.LEVELS, round(math.log((a + 0.4) / (n - a + 0.4)) / M.STEP))) for n, a in zip(nodes, own, strict=True)]
                    gate = (d > 0) + 2 * ((nodes[1] > 0) + (nodes[1] > 3)) + 6 * ((nodes[2] > 0) + (nodes[2] > 3))
                    w = weights.setdefault(gate, [float(v) for v in start[gate]])
                    p = 1 / (1 + math.exp(-max(-14, min(14, sum(a * b for a, b in zip(w, odds, strict=True))))))
                    score += math.log10(p)
                    step.setdefault(gate, []).append([(1 - p) * o for o in odds])
            for gate, moves in step.items():
                weights[gate] = [w + M.RATE * sum(m[c] for m in moves) / (len(moves) + 64) for c, w in enumerate(weights[gate])]
        for w in ws:
            if w not in head:
                score += math.log10((totals[w] + 0.1) / (mass[w % 256] + 0.1 * (inside[w % 256] + 1)))
        yield score


def contexts_of(ws, k):
    return (), (ws[k - 1] if k else None,), (ws[k - 1] if k else None, ws[k - 2] if k > 1 else None)


def test_scores_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(M, "SPARE_BITS", 24)  # no two contexts meet
    rows = [(i, t) for i, t in corpus() if i is not None and i % 4 < 2]
    made, real = [], M.Coder.__init__

    def kept(self, head, counts):
        real(self, head, counts)
        made.append(self)

    with monkeypatch.context() as m:
        m.setattr(M.Coder, "__init__", kept)
        frame = M.score_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, round(r.score, 2)) for r in frame.collect())
    want = sorted((i, s) for (i, _), s in zip(rows, plain_scores(rows, made[0]), strict=True))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-3, atol=0.02)


def test_codes_are_a_distribution():
    head, counts = np.array([3, 900, 77, 12345], np.uint64), np.array([50, 3, 9, 20])
    coder = M.Coder(head, counts)
    words = np.r_[head, np.arange(1 << M.CLASS_BITS, dtype=np.uint64) + np.uint64(1 << 40)]
    code, size, known = coder(words)
    assert known.tolist() == [True] * 4 + [False] * 256
    random_counts = np.random.default_rng(1).integers(0, 9, (M.CONTEXTS, len(words)))
    says = [M.path_says(coder.left.astype(np.uint64), c, coder.width) for c in random_counts]
    lens = np.ones(len(words), np.int64)
    logp = M.Mixer().log_probability(size, says, [coder.symbols(code, size)] * M.CONTEXTS, lens)
    assert abs(np.exp(logp).sum() - 1) < 1e-5


def test_what_neighbours_share_is_told_once():
    r = np.random.default_rng(4)
    coder = M.Coder(r.integers(0, 2**64, 40, np.uint64), r.integers(1, 500, 40))
    for n in (0, 1, 3, 5000):
        left = coder.left[r.integers(0, len(coder.left), n)]
        context = r.integers(0, max(1, n // 40), n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys = np.unique(M.context_keys(context, 40, left, coder.width))
        size = coder.sizes(keys)
        says = M.path_says(keys, r.integers(0, 200, len(keys)), coder.width)
        says[np.arange(coder.width) >= size[:, None]] = 0
        chunk = np.sort(r.permutation(len(keys))[: len(keys) // 2 + 1])  # a chunk asks for some of a range's keys
        new = M.unsaid(keys[chunk], size[chunk], coder.width)
        assert np.array_equal(M.said_again(says[chunk][new], keys[chunk], size[chunk], coder.width), says[chunk])
        assert n < 5000 or new.sum() < 0.7 * size[chunk].sum()


def test_packed_numbers_come_back():
    for values in ([], [5], [0, 1, 2**63, 2**64 - 1], sorted(random.Random(3).getrandbits(64) for _ in range(999))):
        values = np.array(values, np.uint64)
        assert M.unpack(M.pack(values)).tolist() == M.unpack_sorted(M.pack_sorted(values)).tolist() == values.tolist()


def test_pairs_of_a_context_stay_apart_as_the_corpus_grows(spark):
    """A pair of words is as sure in a corpus with 100 times as many other pairs: nothing shares its counts."""
    def sure(n):
        rows = [(1 + 10 * i, f"left{i} right{i} " * 5) for i in range(n)] + [(j, "key door " * 8) for j in range(3, 9)]
        return {r.doc_id: r.score / r.n_tokens for r in M.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[4]

    assert sure(3000) > sure(30) - 0.35


def test_no_rows(spark):
    assert M.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = M.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert (got[0].train_tokens, got[0].base_score) == (0, 0.0)
