"""Scoring by online logistic context mixing.

A text is a sequence of words and one end. Each token is a short binary code (a Huffman code for the words that
make up at least 1/HEAD of the training tokens, a class of its hash for all others, then its share of the class).
Every bit is predicted in several hashed contexts (none, the word before, the two words before); the predictors'
counts are summed over the whole training corpus. A document's bits are mixed in the logistic domain by weights
gated by how much the contexts have seen, and the weights are refined as the document is read.

Counts of words, and of codes in contexts, travel by chunk of text: a chunk sends its distinct words (or pairs of
context and code) and how often they occur to the ranges of the hash space, each range adds up what it got and
answers each chunk. Hashes of contexts get wider with the number of training tokens and nothing is dropped, so the
model grows with the corpus. Nothing that grows with it passes the driver: it sees the head words and the class
totals, both of fixed size.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.runtime import gather, hash_words, materialize, mix64, sum_slices

HEAD = 1024
CLASS_BITS = 8
CONTEXTS = 3
GATES = 18
#: Hashes of contexts have this many bits more than the number of training tokens, so that few of them meet.
SPARE_BITS = 5
#: Pairs of context and code that a range holds at most, if all tokens give different ones.
RANGE_PAIRS = 4_000_000
#: A predictor's say on a bit: its log odds in steps, and how much the context has seen (nothing, a little, more).
STEP, LEVELS = 0.2, 42
#: Tokens of a document between two refinements of its weights.
BLOCK = 64
RATE = 1.0
CHUNK_CHARS = 8_000_000
END = np.uint64(0x5E0F0E0D5E0F0E0D)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
CHUNK = "chunk long, doc_ids array<long>, held_out array<boolean>, doc_bytes array<long>, lens array<long>, tokens binary, words binary, counts binary, n_words long, n_train long"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


@lru_cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Numbers as 64 bits, byte plane by byte plane, compressed."""
    return _zstd()[0].compress(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """The order of words by how often they occur: as ranks in it, most tokens are small numbers."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def _chunks(batches):
    from pyspark import TaskContext

    shard, seq = TaskContext.get().partitionId(), 0
    ids, raws, size = [], [], 0

    def flush():
        arrays = [hash_words(r) for r in raws]
        lens = np.array([len(a) + 1 for a in arrays])
        flat = np.empty(lens.sum(), np.uint64)
        at = np.cumsum(lens)
        flat[at - 1] = END
        inner = np.ones(len(flat), bool)
        inner[at - 1] = False
        flat[inner] = np.concatenate(arrays)
        words, local = np.unique(flat, return_inverse=True)
        out = np.array([held_out(i) for i in ids])
        counts = np.bincount(local[~np.repeat(out, lens)], minlength=len(words)).astype("<u4")
        order = by_frequency(counts)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = [shard << 32 | seq, ids, out.tolist(), [len(r) for r in raws], lens.tolist(), pack(rank[local]), pack_sorted(words), pack(counts), len(words), int(counts.sum())]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in CHUNK.split(", ")])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            raws.append((t.as_py() or "").encode())
            size += len(raws[-1])
            if size >= CHUNK_CHARS:
                yield flush()
                ids, raws, size, seq = [], [], 0, seq + 1
    if ids:
        yield flush()


def _cuts(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Where the ranges of sorted keys of ``width`` bits begin and end; a range is named by the top ``bits``."""
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits) if bits else np.empty(0, np.uint64)
    return np.r_[0, np.searchsorted(keys, inner), len(keys)]


def _to_ranges(bits: int):
    """A chunk's words by range: the top bits of the hash."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpack_sorted(row["words"]), unpack(row["counts"])
                cut = _cuts(words, bits, 64)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array(full, pa.int32()), "chunk": pa.array([row["chunk"]] * len(full), pa.int64()),
                    "words": pa.array([pack_sorted(words[cut[k] : cut[k + 1]]) for k in full], pa.binary()), "counts": pa.array([pack(counts[cut[k] : cut[k + 1]]) for k in full], pa.binary()),
                })

    return run


def _added(keys, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of several chunks with their counts: (distinct keys, totals, place of each key given, where each chunk's keys begin)."""
    parts = [unpack_sorted(k) for k in keys]
    own, where = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(where, np.concatenate([unpack(c) for c in counts]), len(own)).astype("<i8")
    return own, total, where, np.r_[0, np.cumsum([len(p) for p in parts])]


def _answer(n_train: int):
    """One range: total of each word, sent back to each chunk; and the range's head words and class totals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, total, where, at = _added(pdf["words"], pdf["counts"])
        back = [pack(total[where[a:b]]) for a, b in zip(at, at[1:], strict=False)]
        head = (total > 0) & (total >= n_train / HEAD)
        tail = (total > 0) & ~head
        k = (words[tail] & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)
        classes = np.stack([np.bincount(k, minlength=1 << CLASS_BITS), np.bincount(k, total[tail], 1 << CLASS_BITS).astype(np.int64)]).astype("<i8")
        r = int(pdf["range"].iloc[0])
        rows = [(r, c, b, None) for c, b in zip(pdf["chunk"], back, strict=True)]
        rows += [(r, -1, total[head].tobytes(), words[head].tobytes()), (r, -2, classes.tobytes(), None)]
        return pd.DataFrame(rows, columns=["range", "chunk", "counts", "words"])

    return run


def huffman(counts: list[int]) -> list[tuple[int, int]]:
    """(code, length) of each symbol; ties by position."""
    if len(counts) <= 1:
        return [(0, 0)] * len(counts)
    heap = [(c, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    fresh = len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, fresh, (x, y)))
        fresh += 1
    codes = [(0, 0)] * len(counts)
    stack = [(heap[0][2], 0, 0)]
    while stack:
        node, code, n = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[0], code << 1, n + 1), (node[1], code << 1 | 1, n + 1)]
        else:
            codes[node] = code, n
    return codes


class Coder:
    """Codes of words: a first bit (1: head), then the head word's Huffman code or the class."""

    def __init__(self, head: np.ndarray, counts: np.ndarray):
        order = np.argsort(head)
        self.head, self.counts = head[order], counts[order]
        codes = huffman(counts[order].tolist())
        self.code = np.array([1 << n | c for c, n in codes], np.int64)
        self.size = np.array([1 + n for _, n in codes], np.int64)
        #: All codes, shifted to the width of the longest, in order; no code is the beginning of another.
        self.width = int(max([1 + CLASS_BITS, *self.size.tolist()]))
        size = np.r_[self.size, np.full(1 << CLASS_BITS, 1 + CLASS_BITS)]
        left = np.r_[self.code, np.arange(1 << CLASS_BITS)] << (self.width - size)
        self.order = np.argsort(left)
        self.left, self.left_size = left[self.order], size[self.order]

    def symbols(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each code among all codes in order."""
        return np.searchsorted(self.left, code << (self.width - size))

    def sizes(self, keys: np.ndarray) -> np.ndarray:
        """The length of the code that ends each key."""
        return self.left_size[np.searchsorted(self.left, (keys & np.uint64((1 << self.width) - 1)).astype(np.int64))]

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, length, is it a head word) of each word."""
        if not len(self.head):
            at, known = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
            return (words & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64), np.full(len(words), 1 + CLASS_BITS), known
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        known = self.head[at] == words
        tail = (words & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)
        return np.where(known, self.code[at], tail), np.where(known, self.size[at], 1 + CLASS_BITS), known


def context_hashes(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Nothing, the word before, the two before; ``first`` marks each document's first token."""
    with np.errstate(over="ignore"):
        before = np.r_[np.uint64(0), words[:-1]]
        before[first] = 0
        two = np.r_[np.uint64(0), before[:-1]]
        two[first] = 0
        one = mix64(before)
        return [np.zeros(len(words), np.uint64), one, mix64(one ^ (two * _PRIME))]


def bits_of(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, depth) of all bits, token by token."""
    token = np.repeat(np.arange(len(size)), size)
    return token, np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)


def path_says(keys: np.ndarray, total: np.ndarray, width: int) -> np.ndarray:
    """What the predictors of a context say on each bit of each code: one byte a bit, a row a code.

    ``keys`` are distinct and in order: a context, then a code in its last ``width`` bits. The codes that share their first
    bits are neighbours, so a node's count is a sum over a run. A byte holds the log odds of the bit that the code has, and
    how often its node was seen; the other bit of the node gets the same with the opposite sign.
    """
    says = np.empty((len(keys), width), np.uint8)
    node = None
    for d in range(width + 1):
        begin = keys >> np.uint64(width - d)
        fresh = np.r_[True, begin[1:] != begin[:-1]][: len(keys)]
        below = np.add.reduceat(total, np.flatnonzero(fresh))[np.cumsum(fresh) - 1] if len(keys) else total
        if d:
            odds = (np.log(below + 0.4) - np.log(node - below + 0.4)) / STEP
            says[:, d - 1] = np.clip(np.rint(odds), -LEVELS, LEVELS) + LEVELS + (2 * LEVELS + 1) * ((node > 0).astype(np.int8) + (node > 3))
        node = below
    return says


def unsaid(keys: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bits that the key before does not tell: those after the path that both share and the bit in which they part,
    which is the other one of the same node."""
    shared = np.full(len(keys), -1)
    shared[1:] = np.maximum(width - np.frexp((keys[1:] ^ keys[:-1]).astype(np.float64))[1], -1)
    depth = np.arange(width)
    return (depth > shared[:, None]) & (depth < size[:, None])


def said_again(told: np.ndarray, keys: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """``path_says`` of all bits from that of the bits that had to be told; bits after a code's end are 0."""
    new, row, byte = unsaid(keys, size, width), np.arange(len(keys)), np.arange(256)
    other = (byte // (2 * LEVELS + 1) * (2 * LEVELS + 1) + 2 * LEVELS - byte % (2 * LEVELS + 1)).astype(np.uint8)
    says = np.zeros((len(keys), width), np.uint8)
    says[new] = told
    for d in range(width):
        at = np.maximum.accumulate(np.where(new[:, d], row, 0))
        parted = (keys ^ keys[at]) >> np.uint64(width - 1 - d) & np.uint64(1) == 1
        column = says[at, d]
        says[:, d] = np.where(d < size, np.where(parted, other[column], column), 0)
    return says


def context_keys(context: np.ndarray, context_bits: int, left: np.ndarray, width: int) -> np.ndarray:
    return (context >> np.uint64(64 - context_bits)) << np.uint64(width) | left.astype(np.uint64)


def _read_chunk(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = by_frequency(unpack(row["counts"]))
    return order[unpack(row["tokens"]).astype(np.int64)], unpack_sorted(row["words"]), np.array(row["lens"])


def _pairs(coder, context_bits: int, bits: int):
    """A chunk's distinct pairs of context and code by range, with their counts in its training documents."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                local, words, lens = _read_chunk(row)
                code, size, _ = coder.value(words)
                width = coder.value.width
                left = (code << (width - size))[local]
                learn = ~np.repeat(np.array(row["held_out"]), lens)
                contexts = context_hashes(words[local], np.cumsum(lens) - lens)
                for order in range(1, CONTEXTS):
                    keys, where = np.unique(context_keys(contexts[order], context_bits, left, width), return_inverse=True)
                    counts = np.bincount(where[learn], minlength=len(keys))
                    cut = _cuts(keys, bits, context_bits + width)
                    full = np.flatnonzero(np.diff(cut))
                    yield pa.RecordBatch.from_pydict({
                        "range": pa.array(full, pa.int32()), "kind": pa.array([order] * len(full), pa.int32()), "chunk": pa.array([row["chunk"]] * len(full), pa.int64()),
                        "keys": pa.array([pack_sorted(keys[cut[k] : cut[k + 1]]) for k in full], pa.binary()), "counts": pa.array([pack(counts[cut[k] : cut[k + 1]]) for k in full], pa.binary()),
                    })

    return run


def _answer_pairs(coder):
    """One range of one kind of context: what its predictors say, sent back to each chunk for its pairs, once for what neighbours share."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, total, where, at = _added(pdf["keys"], pdf["counts"])
        width = coder.value.width
        says = path_says(keys, total, width)
        size = coder.value.sizes(keys)
        asked = (where[a:b] for a, b in zip(at, at[1:], strict=False))
        back = [_zstd()[0].compress(says[k][unsaid(keys[k], size[k], width)].tobytes()) for k in asked]
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": pdf["kind"], "range": pdf["range"], "counts": back})

    return run


class Mixer:
    """The mixing of one chunk's documents side by side."""

    def __init__(self):
        byte = np.arange(256)
        self.odds = ((byte % (2 * LEVELS + 1) - LEVELS) * STEP).astype(np.float32)
        self.seen = byte // (2 * LEVELS + 1)
        # What a context is trusted with at first, by how much it and the longer one have seen.
        self.start = np.zeros((GATES, CONTEXTS), np.float32)
        for g in range(GATES):
            one, two = g // 2 % 3, g // 6
            w2 = (0.0, 0.35, 0.7)[two]
            w1 = (0.0, 0.4, 0.75)[one] * (1 - w2)
            self.start[g] = 1 - w1 - w2, w1, w2

    def log_probability(self, size, says, pairs, lens) -> np.ndarray:
        """Natural log-probability of each document's bits. Documents are read in blocks; weights change between blocks.

        ``size``: bits of each token. ``says`` of each context, by pair and depth; ``pairs``: each token's pair there.
        """
        n_docs = len(lens)
        start = np.cumsum(lens) - lens
        weights = np.repeat(self.start[None], n_docs, axis=0).reshape(-1, CONTEXTS)
        out = np.zeros(n_docs)
        step = max(1, 400_000 // BLOCK)
        for lo in range(0, n_docs, step):
            docs = np.arange(lo, min(lo + step, n_docs))
            at = 0
            while len(docs := docs[lens[docs] > at]):
                n = np.minimum(BLOCK, lens[docs] - at)
                doc = np.repeat(docs, n)
                tokens = np.repeat(start[docs] + at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                token, depth = bits_of(size[tokens])
                said = [says[c][pairs[c][tokens][token], depth] for c in range(CONTEXTS)]
                x = [self.odds[b] for b in said]
                gate = doc[token] * GATES + (depth > 0) + 2 * self.seen[said[1]] + 6 * self.seen[said[2]]
                w = weights[gate]
                z = w[:, 0] * x[0] + w[:, 1] * x[1] + w[:, 2] * x[2]
                p = 1 / (1 + np.exp(-np.clip(z, -14, 14).astype(np.float64)))
                out += np.bincount(doc[token], np.log(p), n_docs)
                error = (1 - p).astype(np.float32)
                own, inverse, number = np.unique(gate, return_inverse=True, return_counts=True)
                for c in range(CONTEXTS):
                    weights[own, c] += RATE * np.bincount(inverse, error * x[c], len(own)).astype(np.float32) / (number + 64)
                at += BLOCK
        return out


def _score(coder, says_none: np.ndarray, context_bits: int, classes, n_train: int, n_distinct: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches):
        mixer, width = Mixer(), coder.value.width
        for batch in batches:
            for row in batch.to_pylist():
                local, words, lens = _read_chunk(row)
                answers = [[p["counts"] for p in sorted(row["answers"], key=lambda p: p["range"]) if p["kind"] == kind] for kind in range(CONTEXTS)]
                count = np.concatenate([unpack(b) for b in answers[0]]).astype(np.int64)
                first = np.cumsum(lens) - lens
                base = np.log10((count + 0.1) / (n_train + 0.1 * (n_distinct + 1)))
                code, size, known = coder.value(words)
                k = (words & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)
                kinds, mass = classes
                inside = np.where(known, 0.0, np.log10((count + 0.1) / (mass[k] + 0.1 * (kinds[k] + 1))))
                contexts = context_hashes(words[local], first)
                left = (code << (width - size))[local]
                says, pairs = [says_none], [coder.value.symbols(code, size)[local]]
                for order in range(1, CONTEXTS):
                    keys, where = np.unique(context_keys(contexts[order], context_bits, left, width), return_inverse=True)
                    told = np.frombuffer(b"".join(_zstd()[1].decompress(b) for b in answers[order]), np.uint8)
                    says.append(said_again(told, keys, coder.value.sizes(keys), width))
                    pairs.append(where)
                bits = mixer.log_probability(size[local], says, pairs, lens) / np.log(10)
                score = bits + np.add.reduceat(inside[local], first)
                columns = [row["doc_ids"], row["held_out"], lens, np.add.reduceat((count > 0).astype(np.int64)[local], first), np.full(len(lens), n_train), np.add.reduceat(base[local], first), score, row["doc_bytes"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    The model learns from the documents that are not held out. Scores are log10 probabilities of the words and the end;
    an unknown word counts as the unknown word of its class, as the base score counts all unknown words as one.
    A null text is empty (its one token is the end, its bits per byte are per one byte); a null id is held out.
    """
    spark = docs.sparkSession
    chunks = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_chunks, CHUNK)
    chunks = materialize(chunks, "lm-chunks")
    tokens = F.aggregate("lens", F.lit(0).cast("long"), lambda a, b: a + b)
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("train"), F.coalesce(F.sum(tokens), F.lit(0)).alias("all")).first()
    n_train = int(size["train"])
    grown = int(size["n"]).bit_length()
    bits = max(min(8, grown), grown - 4)  # a range holds the words of about 16 chunks at most
    asked = chunks.select("chunk", "words", "counts").mapInArrow(_to_ranges(bits), "range int, chunk long, words binary, counts binary")
    answers = asked.groupBy("range").applyInPandas(_answer(n_train), "range int, chunk long, counts binary, words binary")
    answers = materialize(answers, "lm-answers")
    # At most HEAD words; the classes' two numbers are added up over all ranges.
    heads = gather(answers.where("chunk = -1 and octet_length(words) > 0").select("words", "counts"))
    head = np.concatenate([np.frombuffer(r["words"], "<u8") for r in heads] or [np.empty(0, np.uint64)])
    head_counts = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in heads] or [np.empty(0, np.int64)])
    classes = np.zeros((2, 1 << CLASS_BITS), np.int64)
    for r in gather(sum_slices(answers.where("chunk = -2").select(F.lit(0).alias("slice"), "counts"))):
        classes += np.frombuffer(r["counts"], "<i8").reshape(2, -1)
    n_distinct = len(head) + int(classes[0].sum())
    made = Coder(head, head_counts)
    says_none = path_says(made.left.astype(np.uint64), np.r_[made.counts, classes[1]][made.order], made.width)
    coder = spark.sparkContext.broadcast(made)
    context_bits = min(64 - made.width, n_train.bit_length() + SPARE_BITS)
    pair_bits = min(context_bits, max(min(6, grown), (int(size["all"]) // RANGE_PAIRS).bit_length()))
    pairs = chunks.select("chunk", "held_out", "lens", "tokens", "words", "counts").mapInArrow(_pairs(coder, context_bits, pair_bits), "range int, kind int, chunk long, keys binary, counts binary")
    said = pairs.groupBy("kind", "range").applyInPandas(_answer_pairs(coder), "chunk long, kind int, range int, counts binary")
    counted = answers.where("chunk >= 0").select("chunk", F.lit(0).alias("kind"), "range", "counts")
    by_chunk = counted.unionByName(said).groupBy("chunk").agg(F.collect_list(F.struct("kind", "range", "counts")).alias("answers"))
    both = chunks.drop("n_words", "n_train").join(by_chunk, "chunk")
    scored = both.mapInArrow(_score(coder, says_none, context_bits, classes, n_train, n_distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    scored = materialize(scored, "lm-scores", (chunks, answers))  # a chunk at a time
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
