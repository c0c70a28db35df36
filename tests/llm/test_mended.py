"""Cases that earlier versions got wrong: media inside media, equal rows in packing, numbers that only look like cards, long prefixes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loglattice.llm import jaccard, media, packing, pii


def page(n, body=b"x" * 20):
    return b"OggS\0" + bytes(21) + bytes([1, len(body)]) + body if n else b""


def test_a_stream_of_pages_holds_no_stream_of_its_own():
    ogg = page(1) * 3
    assert media.sniff(ogg) == [("audio/ogg", 0, len(ogg))]
    assert media.sniff(b"head" + ogg + b"tail") == [("audio/ogg", 4, len(ogg))]


def test_a_document_saved_twice_ends_at_its_last_mark():
    once = b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF\n"
    twice = once + b"more\nstartxref\n40\n%%EOF"
    assert media.sniff(twice) == [("application/pdf", 0, len(twice))]
    two = b"-" + once + twice
    assert media.sniff(two) == [("application/pdf", 1, len(once) - 1), ("application/pdf", 1 + len(once), len(twice))]
    assert media.sniff(b"%PDF-1.4 no end") == [] and media.sniff(b"%PDF-x\nstartxref\n%%EOF") == []


@pytest.mark.parametrize("magic", [b"PK\x03\x04", b"%PDF-1", b"OggS", b"RIFF", b"GIF89a"])
def test_many_magics_take_linear_time(magic):
    def took(n, tail):
        began = time.perf_counter()
        media.sniff(magic * n + tail)
        return time.perf_counter() - began

    for tail in (b"", b"PK\x05\x06" + bytes(18), b"startxref %%EOF"):
        took(1000, tail)
        assert took(80_000, tail) < max(1.0, 12 * took(20_000, tail))


def test_equal_rows_are_packed_each_without_meeting_each_other(spark):
    rows = [(7, b"same ids here")] * 3000 + [(8, b"other"), (None, b"none"), (None, b"none"), (9, None), (7, b"same id, other ids")]
    docs = spark.createDataFrame(rows, "doc_id long, ids binary").repartition(4)
    sequences = packing.pack_sequences(docs, "ids", 1, capacities=(64, 256, 1024))
    got = packing.unpack(sequences, 1).groupBy("doc_id", "ids").count().collect()
    assert {(x.doc_id, bytes(x.ids)): x["count"] for x in got} == {(7, b"same ids here"): 3000, (8, b"other"): 1, (None, b"none"): 2, (7, b"same id, other ids"): 1}
    plan = sequences._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and sequences.agg(F.sum("used")).first()[0] == sum(len(b or b"") for _, b in rows)


@pytest.mark.parametrize("text, kinds", [
    ("paid at 1700000000000 ms", []), ("order 12345678901234", []), ("2024010112345678", []), ("4111 1111 1111 1111", ["card"]), ("4111 1111 1111 1112", []), ("5555555555554444", ["card"]), ("0000000000000000", []),
    ("GB82 WEST 1234 5698 7654 32", ["iban"]), ("GB82 WEST 1234 5698 7654 33", []), ("7536784127813050 4845168114407329", ["card"] if pii.luhn_valid("4845168114407329") else []),
])
def test_numbers_are_cards_only_if_they_check(text, kinds):
    assert [k for k, *_ in pii.detect(text)] == kinds
    assert pii.pseudonymise(text, b"k")[0] != text if kinds else pii.pseudonymise(text, b"k")[0] == text


def test_block_pairs_equal_sets_whatever_the_columns(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    base = r.sample(range(10_000), 400)
    rows = []
    for k in range(60):
        own = [base[0], *sorted(base[1 : r.randrange(200, 400)] + r.sample(range(20_000, 90_000), r.randrange(30)))]
        rows.append((base[0], 0, 0, 0, k, len(own) + 20, k % 7, len(own), np.array(own, "<i8").tobytes()))
    batch = pa.RecordBatch.from_pydict(dict(zip(["token", "x", "y", "block", "rep", "n", "label", "gens", "prefix"], map(list, zip(*rows)), strict=True)))
    pairs = lambda: {(a, b) for out in jaccard._block_pairs(80)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    whole = pairs()
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    assert pairs() == whole and len(whole) > 20
