import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.llm import chat, media, packing, pii, token_store
from loglattice.llm.runtime import scratch


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 65536, 65537, 140001])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 1 << 31, n).astype("<u4")
    payload, sizes = token_store.shuffle_planes(ids, mode)
    assert (token_store.unshuffle_planes(payload, sizes, n, mode) == ids).all()


def test_token_store_equals_the_tokenizer(spark, bpe):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe)
    texts = ["Hello  world, it's 5 o'clock\n\n next", None, "", " lead and trail ", "größe x\t\ty ² ½ 日本語 🙂", "a\r\nb \n c", "<|endoftext|> x", "x" * 300 + " " + "y z" * 50, "tab\t tab", "x   y\x1c z"]
    rows = [(k, x) for k, x in enumerate(texts)] + [(3, "again"), (None, "null id")]
    random.Random(1).shuffle(rows)
    path = scratch(spark, "test-store")
    token_store.write_token_store(spark.createDataFrame(rows, "doc_id long, text string"), path, bpe)
    got = sorted(token_store.read_token_store(spark, path).collect(), key=lambda r: r.start)
    at, stream = 0, []
    for r, (i, x) in zip(got, sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")), strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, len(ids), ids)
        at, stream = at + len(ids), stream + ids
    assert token_store.read_id_range(spark, path, 5, 40) == stream[5:45]
    empty = scratch(spark, "test-store")
    token_store.write_token_store(spark.createDataFrame([], "doc_id long, text string"), empty, bpe)
    assert token_store.read_token_store(spark, empty).count() == 0


def test_sniffing_and_carving(spark):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + b"\0" * 9 + b"\x02\x01\x00\x00" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02abc\xff\x00d\xff\xd9"
    wav = media.wav_of(b"ab" + png + b"BM not a bitmap GIF89a" + gif + jpeg)
    rows = [(0, png, "image/gif"), (1, wav, "audio/wav"), (2, b"", "x"), (3, None, None), (4, png[:-1], "image/png"), (5, gif, "image/gif"), (6, jpeg + b"tail", "a"), (7, zlib.compress(b"x", wbits=31), "b")]
    got = {r.k: r for r in media.sniff_media(spark.createDataFrame(rows, "k int, media binary, declared_type string")).collect()}
    assert [got[k].detected_type for k in range(8)] == ["image/png", "audio/wav", None, None, None, "image/gif", "image/jpeg", "application/gzip"]
    assert [got[k].corrected for k in range(8)] == [True, False, False, False, False, False, True, True]
    assert [(e.type, e.start, e.length) for e in got[1].embedded] == [("image/png", 46, len(png)), ("image/gif", 46 + len(png) + 22, len(gif)), ("image/jpeg", 46 + len(png) + 22 + len(gif), len(jpeg))]
    assert got[6].media_length == len(jpeg)


def test_carving_gives_the_bytes_and_samples_are_where_the_chunk_says(spark):
    packed = zlib.compress(b"y" * 3_000_000, wbits=31)
    inner = media.wav_of(b"abc")
    late = b"RIFF" + struct.pack("<I", 4 + 24 + 12 + 8 + 4) + b"WAVE" + media.wav_of(b"")[12:36] + b"LIST" + struct.pack("<I", 4) + b"info" + b"data" + struct.pack("<I", 4) + b"wxyz"
    rows = [(1, b"front " + packed + b" middle " + inner + b"!", "x", "own"), (2, late, None, "own"), (3, None, None, "own")]
    df = media.sniff_media(spark.createDataFrame(rows, "k int, media binary, declared_type string, embedded string"))
    got = [(r.k, r.carved.type, bytes(r.media)) for r in media.carve_media(df).orderBy("k", "carved.start").collect()]
    assert got == [(1, "application/gzip", packed), (1, "audio/wav", inner)]
    features = {r.k: r for r in media.media_features(df).collect()}
    assert features[2].payload_sha256 == hashlib.sha256(b"wxyz").hexdigest() and features[1].payload_bytes is None
    again = media.text_to_media(spark.createDataFrame([(1, "t", b"m")], "doc_id int, text string, media binary"))
    assert media.media_features(media.sniff_media(again)).first().payload_bytes == 64
    assert media.carve_media(df.limit(0)).count() == 0


def test_media_digests(spark):
    texts = [None, "", "x" * 64, "é" * 40, "RIFF____WAVE" * 9]
    df = media.text_to_media(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    for r in media.media_features(media.sniff_media(df)).collect():
        raw = (r.text or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        start, size = media.samples_at(r.media)
        assert r.media[start : start + size] == pad and r.media_sha256 == hashlib.sha256(r.media).hexdigest()


def test_chat_round_trip(spark):
    odd = "\\### Assistant: </turn> <|end|>\n<|turn user|> \\l \\b \\"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "y"), (1, 1, "assistant", odd)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.text_parts(df))
    got = {r.conv_id: r for r in chat.read_back(done).collect()}
    roles = ["a|>b", "", "x\\0", "|", None, "\\p"]
    made = chat.format_conversation([{"role": w, "parts": [{"type": "text", "text": "hi|>"}]} for w in roles])
    assert chat.parse_formatted(made["formatted"]) == [(w, "hi|>") for w in roles]
    turns = [("user", odd), ("assistant", odd), ("assistant", odd), ("assistant", "")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((odd * 2).encode()).hexdigest() and got[1].loss_chars == 2 * len(odd)
    assert (got[2].n_turns, got[2].loss_chars, got[None].loss_chars) == (1, 0, 1)
    assert chat.read_back(chat.format_chats(chat.text_parts(df.limit(0)))).count() == 0


def test_typed_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    turns = [{"role": "user", "parts": [part(type="text", text="see <"), part(type="image", ref="a.png", width=28, height=15), part(type="audio", ref="b.wav", seconds=2.5), part(type="document", ref="c.pdf", pages=3)]}]
    got = chat.format_conversation(turns)
    assert got["formatted"] == "<|turn user|>see \\l<|image 0|><|audio 1|><|document 2|><|end|>\n"
    assert [(a["ref"], a["tokens"]) for a in got["attachments"]] == [("a.png", 4), ("b.wav", 63), ("c.pdf", 768)]
    assert got["media_tokens"] == 835


def test_packing_is_valid_and_tight(spark):
    r = random.Random(3)
    rows = [(k, r.choice([1, 5, 17, 64, r.randint(1, 40), r.randint(1, 300)])) for k in range(3000)] + [(3000, None), (3001, 0), (3002, -4), (5, 17), (5, 17)]
    got = packing.pack_best_fit(spark.createDataFrame(rows, "doc_id long, length long"), capacities=(16, 32, 64)).collect()
    bins = {}
    for x in got:
        if x.bin_id is not None:
            bins.setdefault((x.bin_id, x.capacity), []).append((x.offset, x.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and capacity == min(c for c in (16, 32, 64) if c >= at)
    total = sum(n for _, n in rows if n and n > 0)
    assert sum(n for parts in bins.values() for _, n in parts) == total
    assert sum(c for _, c in bins) <= 1.02 * total
    by_doc = {}
    for x in got:
        by_doc.setdefault(x.doc_id, []).append(x)
    for i, n in rows[:3000]:
        if i != 5:
            assert sum(x.length for x in by_doc[i]) == n and sorted(x.piece for x in by_doc[i]) == list(range(by_doc[i][0].n_pieces))
    assert sum(x.bin_id is None for x in got) == 3
    assert packing.pack_best_fit(spark.createDataFrame([], "doc_id long, length long")).count() == 0


def test_sequences_hold_what_they_say(spark):
    r = random.Random(4)
    texts = {k: bytes(r.randrange(256) for _ in range(r.choice([0, 1, 9, 40, 64, 130]))) for k in range(400)}
    df = spark.createDataFrame([*((k, x, "z") for k, x in texts.items()), (900, None, "z"), (None, b"abc", "z"), (500, b"ab", "z"), (500, b"ab", "z"), (501, b"same", "z"), (501, b"id", "z")], "doc_id long, ids binary, capacity string")
    sequences = packing.pack_sequences(df, "ids", 1, capacities=(16, 32, 64))
    assert all(len(x.ids) == x.used <= x.capacity for x in sequences.collect())
    got = {}
    for x in packing.unpack(sequences, 1).orderBy("doc_id", "piece").collect():
        got[x.doc_id] = got.get(x.doc_id, b"") + bytes(x.ids)
    assert got.pop(None) == b"abc" and got.pop(500) == b"abab" and got.pop(501) in (b"sameid", b"idsame")
    assert got == {k: x for k, x in texts.items() if x}
    assert packing.pack_sequences(df.limit(0), "ids", 1).count() == 0


def test_plan_is_near_the_best_one():
    """Against all partitions of small sets: the cost of capacities and bins."""

    def best(items, capacities, bin_cost):
        least = [float("inf")]

        def go(k, bins, cost):
            if cost >= least[0]:
                return
            if k == len(items):
                least[0] = cost
                return
            price = lambda used: min(c for c in capacities if c >= used) + bin_cost
            for b in range(len(bins)):
                if bins[b] + items[k] <= capacities[-1]:
                    bins[b] += items[k]
                    go(k + 1, bins, cost + price(bins[b]) - price(bins[b] - items[k]))
                    bins[b] -= items[k]
            go(k + 1, [*bins, items[k]], cost + price(items[k]))

        go(0, [], 0)
        return least[0]

    r, ratio = random.Random(2), []
    for _ in range(40):
        items = sorted((r.randint(1, 40) for _ in range(7)), reverse=True)
        plan = packing.plan_bins({n: items.count(n) for n in items}, (16, 32, 64), 4)
        ratio.append(sum((g.capacity + 4) * g.count for g in plan) / best(items, (16, 32, 64), 4))
    assert min(ratio) >= 1 and np.mean(ratio) < 1.08 and max(ratio) < 1.5


def test_plan_uses_every_rank_once():
    r = random.Random(5)
    for _ in range(30):
        counts = {n: r.randint(1, 50) for n in r.sample(range(1, 65), 30)}
        seen = {n: [] for n in counts}
        for g in packing.plan_bins(counts, (16, 32, 64)):
            for n, m, first in g.items:
                seen[n] += range(first, first + m * g.count)
        assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())


def test_surrogates_are_one_to_one_and_keep_format(spark):
    k = hashlib.blake2b(b"k", digest_size=32).digest()
    phones = [f"+1 ({a}) 555-{b:04d}" for a in range(200, 260) for b in range(100)]
    got = [pii.spelled("phone", p, pii.surrogate("phone", pii.canonical("phone", p), k)) for p in phones]
    assert len(set(got)) == len(phones) and all(a != b and a.startswith("+1 (") and len(a) == len(b) for a, b in zip(got, phones, strict=True))
    cards = [x + pii.luhn_digit(x) for x in (f"4{n:014d}" for n in range(3000))]
    new = [pii.surrogate("card", c, k) for c in cards]
    assert len(set(new)) == 3000 and all(pii.luhn_valid(c) for c in new)
    for (script, gender), names in pii.GIVEN.items():
        moved = {n: pii._pool(script, gender, k)[n] for n in names}
        assert sorted(moved.values()) == sorted(names) and all(a != b for a, b in moved.items())


def test_replacing_keeps_coreference_and_other_text(spark):
    text = "Mr. John Smith (j.smith@corp.example.com, 10.1.2.3) paid 4111 1111 1111 1111; later j.smith@corp.example.com wrote to Mrs. Anna Jones. DE89370400440532013000 token = \"2321bac4d15ec8f90433955bf9d3cf61da5bdd1e\""
    rows = [(1, text, 1), (2, None, 2), (3, "", 3), (4, "plain words only", 4), (5, text, 5)]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id int, text string, moved int"), b"k").collect()}
    assert got[1].text == got[5].text and got[2].text is None and got[4].text == "plain words only" and got[3].pii == []
    assert [e.type for e in got[1].pii] == ["name", "email", "ip", "card", "email", "name", "iban", "secret"]
    assert got[1].pii[1].surrogate == got[1].pii[4].surrogate != "j.smith@corp.example.com"
    for e in got[1].pii:
        assert text[e.start : e.end] not in got[1].text
    assert got[1].text.startswith("Mr. ") and "Mrs. " in got[1].text


def test_short_names_stay_apart_and_none_stays():
    key = hashlib.blake2b(b"k", digest_size=32).digest()
    names = [f"{c}{v}" for c in "BCDFGHJKLMNPQRSTVWXYZ" for v in "aeiou"]
    cycle = ["Bo"]
    while (then := pii.surrogate("name", cycle[-1], key)) != cycle[0]:
        cycle.append(then)
    assert set(cycle) == set(names)  # one cycle over the whole format
    cycle = [f"Mr. {x}" for x in cycle]
    some = ["x@e.org", "y@e.org", "GB82WEST12345698765432", "DE89370400440532013000", "Mr. Éé"]
    for values in (cycle[:2], cycle[::-1][:60], cycle, some):
        new, found = pii.pseudonymise("; ".join([*values, *values]), key)
        of = dict(zip([*values, *values], [e["surrogate"] for e in found], strict=True))
        assert [of[v] for v in values * 2] == [e["surrogate"] for e in found] == new.split("; ")
        assert len(set(of.values())) == len(values) and not set(of.values()) & set(values)
    addresses = [f"{a}@example.com" for a in "abcdefghijklmnopqrstuvwxyz"]
    new = pii.pseudonymise(" ".join(addresses), key)[0].split(" ")
    assert len(set(new)) == 26 and not set(new) & set(addresses) and all(pii.detect(n) for n in new)


def test_a_swap_of_two_entities_is_not_undone(monkeypatch):
    swap = {"Bo": "Li", "Li": "Bo"}
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, key: swap[value])
    new = pii.pseudonymise("Mr. Bo, Mr. Li", b"k" * 32)[0].split(", ")
    assert len(set(new)) == 2 and not {x[4:] for x in new} & set(swap)


VALUES = {
    "email": [f"p{n}@corp.org" for n in range(30)], "ip": [f"10.1.2.{n}" for n in range(30)], "ssn": [f"115-05-{n:04d}" for n in range(30)], "phone": [f"(415) 555-{n:04d}" for n in range(30)],
    "card": [f"4{n:014d}" + pii.luhn_digit(f"4{n:014d}") for n in range(30)], "iban": [f"DE{pii.iban_check('DE', f'3704004405320130{n:02d}')}3704004405320130{n:02d}" for n in range(30)],
    "secret": [f"sk_{n:02d}abcdefghij0123456789" for n in range(30)], "name": [f"Mrs. Anna {c}{v}nd" for c in "BCDFGHJKLM" for v in "aeo"],
}


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_a_value_and_its_surrogate_in_one_text(kind):
    """Two entities stay two, and none of them stays as it is."""
    key = hashlib.blake2b(b"k", digest_size=32).digest()
    for value in VALUES[kind]:
        both = [value, pii.spelled(kind, value, pii.surrogate(kind, pii.canonical(kind, value), key))]
        new, found = pii.pseudonymise(" and ".join(both), key)
        assert [e["type"] for e in found] == [kind] * 2
        assert len(set(new.split(" and "))) == 2 and not set(new.split(" and ")) & set(both)
    assert len({pii.pseudonymise(v, key)[0] for v in VALUES[kind]}) == 30


def test_spellings_of_an_entity_have_one_surrogate():
    key = hashlib.blake2b(b"k", digest_size=32).digest()
    text = "+1 415 555 2671; (415) 555-2671; +14155552671; John@corp.com; john@corp.com; Mr. John Smith; John  Smith; 4111 1111 1111 1111; 4111111111111111"
    new = pii.pseudonymise(text, key)[0].split("; ")
    digits = ["".join(c for c in x if c.isdigit()) for x in new]
    assert digits[0] == digits[2] == "1" + digits[1] and digits[1] != "4155552671" and new[0].startswith("+1 ") and new[1][0] == "("
    assert new[3].lower() == new[4] and new[3][0].isupper() and new[5].split()[1:] == new[6].split() and "  " in new[6] and new[5].startswith("Mr. ")
    assert digits[7] == digits[8] and new[7].count(" ") == 3
    assert all(a != b for a, b in zip(new, text.split("; "), strict=True))


def test_names_of_several_languages_and_clashing_columns(spark):
    rows = [(1, "Priya Patel met Wei Zhang", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = pii.replace_pii(df, b"k").first()
    assert [e.type for e in got.pii] == ["name", "name"] and "Patel" not in got.text and "Zhang" not in got.text
    plain = pii.replace_pii(df, b"k", report=None)
    assert plain.columns == df.columns and plain.first().pii == "own" and plain.first().text == got.text
    assert pii.replace_pii(df.limit(0), b"k").count() == 0


def test_long_runs_take_linear_time():
    import time

    key = hashlib.blake2b(b"k", digest_size=32).digest()
    for unit in ("a", "a.", "a@", "1 ", "Mr. ", "x@y.z", "(1"):
        began = time.process_time()
        pii.pseudonymise(unit * (1_000_000 // len(unit)) + "@", key)
        assert time.process_time() - began < 20, unit


@pytest.mark.parametrize("special", [False, True])
def test_units_equal_the_library(bpe, special):
    import itertools

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe)
    t.encode_special_tokens = not special
    enc = token_store.Encoder(bpe, special)
    texts = ["a<|endoftext|> b", "a \xa0 \xa0", "a\n <|endoftext|> \n<|endoftext|>", "a <|endoftext|  b"]
    texts += ["".join(c) for n in range(1, 6) for c in itertools.product("a \xa0\n'\x1c\x85", repeat=n)]
    texts += [f"a {c} {c}b  {c}" for c in "\u180e\u200b\ufeff\u2003\u3000\u2028\x1f\x0b\x0c\t"]
    for x in texts:
        assert np.frombuffer(enc.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    if special:
        assert np.frombuffer(enc.encode(texts[0]), "<u4").tolist() == [64, 50256, 275]
    assert np.frombuffer(enc.encode(texts[1]), "<u4").tolist() == [64, 11504]


def test_a_piece_is_encoded_once_whatever_stands_beside_it(bpe):
    from collections import Counter

    class Counted:
        def __init__(self, model):
            self.model, self.seen = model, Counter()

        def tokenize(self, piece):
            self.seen[piece] += 1
            return self.model.tokenize(piece)

    from tokenizers import Tokenizer

    enc, t = token_store.Encoder(bpe), Tokenizer.from_file(bpe)
    enc.model = Counted(enc.model)
    for text in ("on ndtho, ndtho. ndtho; ndtho12 ndtho's\nNdtho \nNdtho, on ndtho's, ndtho! ndthoé ndthoé,", "on ndtho: ndtho?"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert enc.model.seen["Ġndtho"] == 1 and max(enc.model.seen.values()) == 1


@pytest.mark.parametrize("size", [1, 60, 1 << 23])
def test_batches_equal_the_library(bpe, size, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SLICE_BYTES", size)
    t, draw = Tokenizer.from_file(bpe), random.Random(size)
    texts = ["".join(draw.choices("as1'!. \n\t\xa0é«²\x1c—日\u200b\x7ftdmrevl  \n", k=draw.randrange(25))) for _ in range(2000)]
    texts += [None, "", " ", "  ", "\n", " \nA", "\n\nA", "x", "a <|endoftext|> b", "<|endoftext|>", None, "y" * 300, "a ", "b", "\n", "'s"]
    got = list(token_store.Encoder(bpe).encode_all(pa.array(["cut off", *texts])[1:]))
    for x, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, x
    assert list(token_store.Encoder(bpe).encode_all(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("ordered", [False, True])
def test_long_conversations_are_written_in_pieces(spark, ordered):
    n, text = 500, "<é\\" * 7000
    odd = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.col("id").cast("string"), F.lit(text)).alias("text"))
    few = odd.where("turn < 2").withColumn("conv_id", F.lit(None).cast("long")).union(odd.where("turn < 3").withColumn("conv_id", F.lit(2)))
    rows = chat.text_parts(odd.union(few).repartition(5))
    image = F.array_append("parts", F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("r").alias("ref"), F.lit(14).alias("width"), F.lit(14).alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))
    done = chat.format_chats(rows.withColumn("parts", image))
    pieces = done.where("conv_id = 1").orderBy("piece").collect()
    assert len(pieces) > 5 and max(len(p.formatted) for p in pieces) < 3 * chat.PIECE_CHARS
    assert [p.piece for p in pieces] == list(range(len(pieces))) and [a.ordinal for p in pieces for a in p.attachments] == list(range(n))
    turns = [("assistant" if k % 2 else "user", f"{k}{text}<|image {k}|>") for k in range(n)]
    whole = "".join(p.formatted for p in pieces)
    assert all(whole[s.start : s.end] == chat.escape(f"{k}{text}") + f"<|image {k}|>" for k, s in zip(range(1, n, 2), [s for p in pieces for s in p.loss_spans], strict=True))
    got = {r.conv_id: r for r in chat.read_back(done, ordered=ordered).collect()}
    assert len(got) == 3 and [got[k].n_turns for k in (None, 1, 2)] == [2, n, 3]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got[1].n_attachments, got[1].media_tokens, got[1].formatted_chars) == (n, n, len(whole))
