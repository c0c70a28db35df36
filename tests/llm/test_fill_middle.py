"""Fill-in-middle against a plain version by Python's slices."""

import hashlib
import random

import pyarrow as pa

from loglattice.llm import fill_middle


def plain(key, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text
    return key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text


def rows():
    r = random.Random(1)
    signs = ["a", "é", "é", "\U0001f600", "\n", "\r", "<", ">", "P", "S", "M", "\0", "‍", " ", " ", "'"]
    made = [(k, "".join(r.choice(signs) for _ in range(r.randrange(40)))) for k in range(1500)]
    return made + [(7, "again"), (7, "again"), (None, "no key"), (5, None), (6, ""), (8, "\U0001f600" * 400_000), (9, "<P>"), (10, "a<S"), (-3, "minus")]


def test_equals_the_plain_version(spark):
    given = rows()
    docs = spark.createDataFrame([(k, t, "f", k, "o") for k, t in given], "doc_id long, text string, form string, n long, output string").repartition(3)
    order = lambda x: tuple(map(str, x))
    want = sorted((plain(*x) for x in given), key=order)
    got = sorted(map(tuple, fill_middle.fill_middle(docs).collect()), key=order)
    assert got == want and {x[2] for x in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sorted(map(tuple, fill_middle.fill_middle(docs, digests=True).collect()), key=order)
    assert digests == sorted(((*x[:5], sha(x[5]), sha(x[6])) for x in want), key=order)


def test_own_markers_keys_and_an_empty_table(spark):
    docs = spark.createDataFrame([("k1", "it's a <P> text"), ("k2", "other")], "name string, body string")
    got = fill_middle.fill_middle(docs, "name", "body", cut=100, suffix_first=100, markers=("[p'", "[s'", "[m'"), seed="z").collect()
    assert {x.name: x.form for x in got} == {"k1": "spm", "k2": "spm"} and all(x.output.startswith("[s'") and "[p'" in x.output for x in got)
    assert {x.restored for x in got} == {"it's a <P> text", "other"}
    assert fill_middle.fill_middle(docs.limit(0), "name", "body").count() == 0


def test_slices_bound_the_text_that_is_registered():
    batch = pa.RecordBatch.from_pydict({"key": [1, 2, 3, 4, 5], "text": ["a" * 40, None, "b" * 70, "c" * 200, "d"]})
    parts = [t.column("key").to_pylist() for t in fill_middle.slices(batch, 100)]
    assert parts == [[1, 2], [3], [4], [5]]
