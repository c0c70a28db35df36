import itertools
import math

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from loglattice.llm import segmentation as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def found_of(texts, keys, v, k=S.SAMPLES):
    """Per text: (ids, log-probability, perturbed value, inclusion score) of each draw."""
    out = [[] for _ in texts]
    for which, ids, n, lp, value, score in S.sample(texts, keys, v, k):
        for d, part, *numbers in zip(which, np.split(ids, np.cumsum(n)[:-1]), lp, value, score, strict=True):
            out[d].append((part, *numbers))
    return out


def test_splits_as_the_model_sees_it():
    for text in ["", " ", "a", "  Hi  there \n x ", "a b  c   ", "\t", "日本 語", "a ", " a"]:
        assert "".join(" " + w for w in S.split_words(text)) == (" " + text if text else "")
        assert not any(w.strip(" ").count(" ") for w in S.split_words(text))


def every(text, v):
    whole = "".join(" " + w for w in S.split_words(text))
    ids = {p: i for i, p in v.pieces.items()}
    out = []

    def go(at, path, lp):
        if at == len(whole):
            out.append((tuple(path), lp))
        for n in range(1, v.longest + 1):
            p = whole[at : at + n]
            if len(p) == n and p in ids:
                go(at + n, [*path, ids[p]], lp + v.score[ids[p]])

    go(0, [], 0.0)
    z = math.log(sum(math.exp(lp) for _, lp in out))
    return {p: lp - z for p, lp in out}


def test_round_trip_and_distinct():
    v = S.vocabulary(MODEL)
    texts = ["Hello there, world", "", "  two  spaces \n and 日本語 🙂 ü", "x" * 500, "a", " ", "the marker ▁ is a character ▁▁ too"]
    for t, found in zip(texts, found_of(texts, np.arange(7, dtype=np.uint64), v, 4), strict=True):
        assert all(v.decode(ids.tolist()) == t for ids, *_ in found)
        assert len({ids.tobytes() for ids, *_ in found}) == len(found) == (1 if t == "" else len(found))
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
    assert len(found_of(["Hello there, world"], np.zeros(1, np.uint64), v, 40)[0]) == 40


def test_pieces_are_those_of_the_library():
    v, sp = S.vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "Plain words only, with 日本 and 🙂"
    for ids, *_ in found_of([text], np.array([3], np.uint64), v, 5)[0]:
        assert sp.decode(ids.tolist()) == text


def test_sample_follows_the_distribution():
    """Against enumeration: log-probabilities, first draws, pairs and triples drawn without replacement."""
    v = S.vocabulary(MODEL)
    text = "the on"
    p = every(text, v)
    n, k = 12000, 3
    got = found_of([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), v, k)
    first, pairs, triples = {}, {}, {}
    for found in got:
        keys = [tuple(ids.tolist()) for ids, *_ in found]
        assert len(set(keys)) == min(k, len(p))
        for key, (_, lp, _, _) in zip(keys, found, strict=True):
            assert abs(lp - p[key]) < 1e-6
        first[keys[0]] = first.get(keys[0], 0) + 1
        pairs[tuple(keys[:2])] = pairs.get(tuple(keys[:2]), 0) + 1
        triples[tuple(keys)] = triples.get(tuple(keys), 0) + 1
    near = lambda seen, q: abs(seen / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    assert all(near(first.get(key, 0), math.exp(lp)) for key, lp in p.items())
    for path in itertools.permutations(sorted(p, key=p.get)[-5:], 3):
        a, b, c = (math.exp(p[x]) for x in path)
        assert near(triples.get(path, 0), a * b / (1 - a) * c / (1 - a - b))
    for a, b in itertools.permutations(sorted(p, key=p.get)[-5:], 2):
        assert near(pairs.get((a, b), 0), math.exp(p[a]) * math.exp(p[b]) / (1 - math.exp(p[a])))


def test_all_segmentations_when_there_are_few():
    v = S.vocabulary(MODEL)
    p = every("ab", v)
    found = found_of(["ab"], np.array([5], np.uint64), v, len(p) + 3)[0]
    assert {tuple(ids.tolist()) for ids, *_ in found} == set(p) and all(score == 0 for *_, score in found)


def test_inclusion_scores_are_unbiased():
    v = S.vocabulary(MODEL)
    n = 4000
    got = found_of(["and the"] * n, np.arange(n, dtype=np.uint64) * np.uint64(104729) + np.uint64(5), v, 3)
    total = np.mean([sum(math.exp(lp - score) for _, lp, _, score in found) for found in got])
    assert abs(total - 1) < 0.05


def test_a_batch_changes_no_bit():
    """A text alone and among others: the same ids and the same doubles."""
    v = S.vocabulary(MODEL)
    r = np.random.default_rng(2)
    words = ["the", "one", "Straße", "zzyzx", "日本語", "🙂", "a", "", "internationalisation", "x" * 70]
    texts = [" ".join(r.choice(words, r.integers(0, 60))) for _ in range(150)]
    keys = np.array([xxhash.xxh3_64_intdigest(str(i)) for i in range(150)], np.uint64)
    whole = found_of(texts, keys, v, 4)
    for d in range(150):
        alone = found_of(texts[d : d + 1], keys[d : d + 1], v, 4)[0]
        assert [(a.tobytes(), *x) for a, *x in alone] == [(a.tobytes(), *x) for a, *x in whole[d]]


def test_a_long_text():
    v = S.vocabulary(MODEL)
    texts = ["ab c " * 100_000, "y" * 60_000]
    for t, found in zip(texts, found_of(texts, np.arange(2, dtype=np.uint64), v), strict=True):
        assert len(found) == 3 and all(v.decode(ids.tolist()) == t for ids, *_ in found)


def test_operator(spark):
    rows = [(1, "one two three", 9), (2, None, 9), (3, "", 9), (None, "null id", 9), (1, "one two three", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    a = sorted(map(tuple, S.sample_segmentations(df, MODEL).collect()), key=str)
    b = sorted(map(tuple, S.sample_segmentations(df.repartition(3), MODEL).collect()), key=str)
    assert a == b and sum(x[0] == 1 for x in a) == 6 and sum(x[0] == 2 for x in a) == 1
    assert S.sample_segmentations(df.limit(0), MODEL).count() == 0


def test_decoding(spark):
    texts = ["one  two ", "", None, "日本 ▁ 🙂", " x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drawn = S.sample_segmentations(df, MODEL).withColumn("decoded", F.lit("clash"))
    back = S.decode_segmentations(drawn, MODEL).collect()
    assert all(r.decoded == (texts[r.doc_id] or "") for r in back) and {r.doc_id for r in back} == set(range(5))
    v = S.vocabulary(MODEL)
    odd = [(np.array([int(v.byte_ids[0xC3])], "<u4").tobytes(),), (None,), (b"",), (np.array([10**6], "<u4").tobytes(),)]
    assert [r.decoded for r in S.decode_segmentations(spark.createDataFrame(odd, "ids binary"), MODEL).collect()] == ["�", None, "", ""]
    assert S.decode_segmentations(drawn.limit(0), MODEL).count() == 0
