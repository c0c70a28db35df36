"""Sampled subword segmentations without replacement, and their decoding.

A SentencePiece vocabulary spans a lattice of pieces over each text. Piece scores give a distribution over
segmentations; perturbing the log-probability of every segmentation with Gumbel noise and taking the k largest
draws k distinct ones without replacement. They are found by A* search from the top. A node of the search is a set
of segmentations: those that leave a known one somewhere within a stretch of its edges, or that leave all known
ones at one edge. Its bound is the exact largest perturbed value in the set, drawn as a truncated Gumbel, so the
first k sets popped give the sample; a set popped is split at the edge where its best member leaves. Where that is
comes from the known path's running log-probability, since what leaves before an edge weighs one minus what
follows up to it. All texts of a batch take each step together.

Pieces never cross the start of a word, so the lattice is a chain of word lattices, one for each distinct word.
Log-probabilities and shares are summed as integers (units 2^-36 and 2^-60): a text's numbers do not depend on
what shares its batch. An alternative that weighs less than such a unit is never drawn.

Scores: the vocabularies at hand rank their pieces and carry no probabilities; log-probability is -log(rank +
RANK_SHIFT), which is Zipf's law. Bytes of characters outside the vocabulary cost BYTE_SCORE each.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.runtime import mix64, uniform, with_fields

SPACE = "▁"
RANK_SHIFT = 100.0
BYTE_SCORE = -14.0
SAMPLES = 3
#: Characters of text worked on at a time; a longer text is worked on alone.
BATCH_CHARS = 2_000_000
#: Ids decoded at a time; a longer row is decoded alone.
DECODE_IDS = 200_000
#: Log-probabilities are in units of 2^-LOG_BITS, shares of a lattice node in units of 2^-SHARE_BITS.
LOG_BITS, SHARE_BITS = 36, 60
LOG_ONE, SHARE_ONE = 1 << LOG_BITS, 1 << SHARE_BITS
_B = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces by 64-bit polynomial hash of their code points, in an open table; which prefixes go on; byte pieces.

    A piece's blank marker stands for a blank here, so that the marker itself, in a text, is a character of its own.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        entries: dict[str, int] = {}
        raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                code = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[code], raw[i] = i, bytes([code])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i).replace(SPACE, " ")
                entries[piece], raw[i] = i, piece.encode()
        self.longest = max(map(len, entries))
        inner = {p[:k] for p in entries for k in range(1, len(p))}
        rank = {i: r for r, i in enumerate(sorted(entries.values(), key=lambda i: -sp.get_score(i)))}
        keys = sorted({*entries, *inner})
        self.bits = max(10, (2 * len(keys)).bit_length())  # at most half full
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int32)
        self.score = np.full(n, BYTE_SCORE)
        for i, r in rank.items():
            self.score[i] = -np.log(r + RANK_SHIFT)
        self.pieces = {i: p for p, i in entries.items()}
        for p in keys:
            h = self.hash(p)
            at = h >> (64 - self.bits)
            while self.keys[at]:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = h, entries.get(p, -1)
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.place = np.cumsum(self.size) - self.size

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ (ord(c) + 1)) * int(_B)) & ((1 << 64) - 1)
            h ^= h >> 29
        return h or 1

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(present, id): -1 for what only begins a piece."""
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        k = self.keys[at]
        there = k == h
        open_ = np.flatnonzero(~there & (k != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            k = self.keys[at[open_]]
            hit = k == h[open_]
            there[open_[hit]] = True
            open_ = open_[~hit & (k != 0)]
        return there, np.where(there, self.ids[at], -1)

    def decode(self, ids: list[int]) -> str:
        """The text of one segmentation; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(self.blob[self.place[i] : self.place[i] + self.size[i]].tobytes() for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    if model_file not in _vocabularies:
        _vocabularies[model_file] = Vocabulary(model_file)
    return _vocabularies[model_file]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], .. start[0] + n[0] - 1, start[1], .. in one array."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Lattices:
    """Word lattices of distinct words, end to end: nodes are character positions, with an end node after each word.

    first[node]..first[node + 1] are its edges, the longest one first, which is mostly the likeliest; ``share`` is an edge's probability from
    the node, ``upto`` the sum of shares up to the edge, ``logp`` its logarithm, ``final`` whether it ends the word.
    """

    def __init__(self, words: list[str], v: Vocabulary):
        text = np.frombuffer(("".join([" " + w for w in words])).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.root = np.cumsum(size + 1) - size - 1  # a node for each character and an end node
        word = np.repeat(np.arange(len(words)), size)
        node = np.arange(len(text)) + word  # node of a character
        end = np.repeat(np.cumsum(size), size)  # past the word's last character
        del word
        self.n_nodes = int(len(text) + len(words))
        starts, ends, ids = [], [], []
        alive, h = np.arange(len(text)), np.zeros(len(text), np.uint64)
        single = np.zeros(len(text), bool)
        with np.errstate(over="ignore"):
            for length in range(1, v.longest + 1):
                if length > 1:
                    keep = alive + length <= end[alive]
                    alive, h = alive[keep], h[keep]
                if not len(alive):
                    break
                h = (h ^ (text[alive + (length - 1)] + np.uint64(1))) * _B
                h ^= h >> np.uint64(29)
                there, found = v.find(np.where(h == 0, np.uint64(1), h))
                whole = found >= 0
                starts.append(node[alive[whole]])
                ends.append(node[alive[whole]] + length)
                ids.append(found[whole])
                if length == 1:
                    single[alive[whole]] = True
                alive, h = alive[there], h[there]
        bare = np.flatnonzero(~single)  # characters outside the vocabulary: one edge of their bytes, id -1 - code point
        if len(bare):
            starts.append(node[bare])
            ends.append(node[bare] + 1)
            ids.append(-1 - text[bare].astype(np.int64))
        start, stop, ident = (np.concatenate(x[::-1]) if x else np.empty(0, np.int64) for x in (starts, ends, ids))
        order = np.argsort(start, kind="stable")
        start, stop, ident = start[order], stop[order], ident[order].astype(np.int64)
        del starts, ends, ids, order, alive, h, single
        code = -1 - ident
        bytes_of = np.where(ident < 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 0)
        plain = bytes_of == 1  # a single byte has a single id
        ident[plain] = v.byte_ids[code[plain]]
        weight = np.where(bytes_of == 0, v.score[np.maximum(ident, 0)], BYTE_SCORE * bytes_of)
        del code, bytes_of, plain
        self.first = first = np.searchsorted(start, np.arange(self.n_nodes + 1))
        # Backwards over positions, all words at once: level d is d characters before the word's end.
        beta = np.zeros(self.n_nodes)
        left = end - np.arange(len(text))
        by_level = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by_level], np.arange(1, (int(left.max()) if len(left) else 0) + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = node[by_level[a:b]]
            n = first[at + 1] - first[at]
            e = _ranges(first[at], n)
            s = weight[e] + beta[stop[e]]
            cut = np.cumsum(n) - n
            top = np.maximum.reduceat(s, cut)
            beta[at] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, n)), cut))
        logp = np.minimum(weight + beta[stop] - beta[start], 0.0)
        del weight, beta, left, by_level
        self.start, self.stop, self.ident = start, stop, ident
        self.logp = np.rint(logp * LOG_ONE).astype(np.int64)
        total = np.cumsum(np.rint(np.exp(logp) * SHARE_ONE).astype(np.uint64))  # wraps around; differences do not
        base = np.r_[np.uint64(0), total][first[start]]
        self.upto = np.minimum((total - base).astype(np.int64), SHARE_ONE)
        self.upto[first[1:][np.diff(first) > 0] - 1] = SHARE_ONE
        self.share = np.diff(self.upto, prepend=0)
        top = first[:-1][np.diff(first) > 0]
        self.share[top] = self.upto[top]
        self.final = first[self.stop + 1] == first[self.stop]

    def descend(self, roots: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation from each root to its word's end, drawn by the row's bits ``h``: (edges row by row, how many each)."""
        n = np.zeros(len(roots), np.int64)
        rows = np.flatnonzero(self.first[roots + 1] > self.first[roots])
        trace, at, bits = [], roots[rows], h[rows]
        while len(rows):
            u = (bits >> np.uint64(64 - SHARE_BITS)).astype(np.int64)
            e = self.first[at]
            miss = np.flatnonzero(u >= self.upto[e])
            while len(miss):
                e[miss] += 1
                miss = miss[u[miss] >= self.upto[e[miss]]]
            trace.append((rows, e))
            n[rows] += 1
            on = np.flatnonzero(~self.final[e])
            rows, at = rows[on], self.stop[e[on]]
            bits = mix64(bits[on])
        cut = np.cumsum(n) - n
        edges = np.empty(int(n.sum()), np.int64)
        for step, (rows, e) in enumerate(trace):
            edges[cut[rows] + step] = e
        return edges, n


_after_word = re.compile(r"(?<=[^ ]) ").split


def split_words(text: str) -> list[str]:
    """The words as the model sees them, each without the blank that it begins with: a text is cut where a blank follows
    something else, as no piece goes across."""
    if not text:
        return []
    return text.split(" ") if text[0] != " " and "  " not in text else _after_word(text)


def _truncated(location, bound, u):
    """The largest of Gumbels with the total log weight ``location``, given that it is below ``bound``."""
    with np.errstate(invalid="ignore"):
        return np.where(location == -np.inf, -np.inf, location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(u)))


class _Draw:
    """One segmentation each of the texts ``docs``: ``edges`` end to end with the place of their word, and running sums."""

    def __init__(self, n_docs: int, docs: np.ndarray, edges: np.ndarray, word: np.ndarray, n: np.ndarray, lat: Lattices):
        self.docs, self.edges, self.word = docs, edges, word
        self.base, self.n = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        self.base[docs], self.n[docs] = np.cumsum(n) - n, n
        self.sums = np.r_[0, np.cumsum(lat.logp[edges])]  # falls all along

    def log_upto(self, d: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.sums[self.base[d] + k] - self.sums[self.base[d]]


def _search(words: list[list[str]], keys: np.ndarray, v: Vocabulary, k: int):
    """(lattices, draws, log-probabilities and perturbed values of each draw, best bound of what is left of each text)."""
    n_docs = len(words)
    index = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    at = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64)
    lat = Lattices(list(index), v)
    root = lat.root[at]
    n_words = np.fromiter(map(len, words), np.int64, n_docs)
    begin = np.cumsum(n_words) - n_words
    golden = np.uint64(0x9E3779B97F4A7C15)

    def seed(d, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(keys[d] ^ np.uint64(salt * 0x51ED2701))

    def noise(d, salt: int) -> np.ndarray:
        return uniform(mix64(seed(d, salt)))

    def drawn(d: np.ndarray, roots: np.ndarray, word: np.ndarray, n: np.ndarray, salt: int):
        """Segmentations from ``roots``, n[i] of them for text d[i]; their edges, the words' places, edges a text."""
        with np.errstate(over="ignore"):
            edges, m = lat.descend(roots, mix64(np.repeat(seed(d, salt), n) + word.astype(np.uint64) * golden))
        of = np.r_[0, np.cumsum(m)]
        ends = np.cumsum(n)
        return edges, np.repeat(word, m), of[ends] - of[ends - n]

    every = np.arange(n_docs)
    edges, word, n = drawn(every, root, np.arange(len(root)) - np.repeat(begin, n_words), n_words, 1)
    draws = [_Draw(n_docs, every, edges, word, n, lat)]
    value = [-np.log(-np.log(noise(every, 2)))]
    logs = [draws[0].log_upto(every, n)]
    # The queue of each text: a bound and (which draw, lo, hi, draws known at lo: 0 for a stretch of edges).
    slots = 4 * k
    bound = np.full((n_docs, slots), -np.inf)
    node = np.zeros((n_docs, slots, 4), np.int64)
    used = np.zeros(n_docs, np.int64)

    def weight_of(t: int, d, lo, hi) -> np.ndarray:
        """Log weight of what leaves draw t on the edges lo..hi."""
        before, within = draws[t].log_upto(d, lo), draws[t].log_upto(d, hi) - draws[t].log_upto(d, lo)
        with np.errstate(divide="ignore"):
            return before / LOG_ONE + np.log(-np.expm1(within / LOG_ONE))

    def push(d, which: tuple, weight, top, salt: int):
        bound[d, used[d]] = _truncated(weight, top, noise(d, salt))
        node[d, used[d]] = np.stack([np.broadcast_to(x, d.shape) for x in which], axis=1)
        used[d] += 1

    push(every, (0, 0, n, 0), weight_of(0, every, np.zeros_like(n), n), value[0], 3)
    for turn in range(1, k):
        slot = bound.argmax(axis=1)
        top = bound[every, slot]
        d = np.flatnonzero(top > -np.inf)
        if not len(d):
            break
        top, (parent, lo, hi, known) = top[d], node[d, slot[d]].T
        bound[d, slot[d]] = -np.inf
        cut = lo.copy()
        for t in range(turn):
            mine = np.flatnonzero((parent == t) & (known == 0))
            draw, x = draws[t], d[mine]
            a, b = draw.base[x] + lo[mine], draw.base[x] + hi[mine]
            within = (draw.sums[b] - draw.sums[a]) / LOG_ONE
            goal = draw.sums[a] + np.floor(np.log1p(noise(x, 100 * turn) * np.expm1(within)) * LOG_ONE).astype(np.int64)
            falling = -draw.sums
            found = np.searchsorted(falling, -goal, "right") - 1
            last = np.searchsorted(falling, falling[b], "left") - 1  # the last edge that anything leaves at
            cut[mine] = np.clip(found, a, last) - draw.base[x]
        # At the edge where the set's best member leaves: any other edge of the node, by its share.
        taken = np.zeros((len(d), turn), np.int64)
        edge = np.empty(len(d), np.int64)
        word = np.empty(len(d), np.int64)
        for t in range(turn):
            has = np.flatnonzero(np.where(known == 0, parent == t, (known >> t) & 1 == 1))
            taken[has, t] = 1 + draws[t].edges[draws[t].base[d[has]] + cut[has]]
            mine = np.flatnonzero(parent == t)
            place = draws[t].base[d[mine]] + cut[mine]
            edge[mine], word[mine] = draws[t].edges[place], draws[t].word[place]
        at_node = lat.start[edge]
        gone = np.where(taken > 0, lat.share[taken - 1], 0).sum(axis=1)
        u = (noise(d, 100 * turn + 1) * (SHARE_ONE - gone)).astype(np.int64)
        other, last = np.full(len(d), -1), np.full(len(d), -1)
        e, rows = lat.first[at_node].copy(), np.arange(len(d))
        while len(rows):
            free = (taken[rows] != e[rows][:, None] + 1).all(axis=1) & (lat.share[e[rows]] > 0)
            hit = free & (u[rows] < lat.share[e[rows]])
            last[rows[free]] = e[rows[free]]
            other[rows[hit]] = e[rows[hit]]
            u[rows[free]] -= lat.share[e[rows[free]]]
            e[rows] += 1
            rows = rows[~hit & (e[rows] < lat.first[at_node[rows] + 1])]
        other = np.where(other < 0, last, other)
        # The new draw: the parent up to the edge, the other edge, and all that follows drawn anew.
        n_after = n_words[d] - word - 1
        roots = np.empty(len(d) + int(n_after.sum()), np.int64)
        places = np.empty(len(roots), np.int64)
        heads = np.cumsum(n_after + 1) - n_after - 1
        roots[heads], places[heads] = lat.stop[other], word
        tail = np.ones(len(roots), bool)
        tail[heads] = False
        roots[tail] = root[_ranges(begin[d] + word + 1, n_after)]
        places[tail] = _ranges(word + 1, n_after)
        fresh, fresh_word, n_fresh = drawn(d, roots, places, n_after + 1, 100 * turn + 2)
        n = cut + 1 + n_fresh
        edges, words_of = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
        base = np.cumsum(n) - n
        for t in range(turn):
            mine = np.flatnonzero(parent == t)
            to, source = _ranges(base[mine], cut[mine]), _ranges(draws[t].base[d[mine]], cut[mine])
            edges[to], words_of[to] = draws[t].edges[source], draws[t].word[source]
        edges[base + cut], words_of[base + cut] = other, word
        to = _ranges(base + cut + 1, n_fresh)
        edges[to], words_of[to] = fresh, fresh_word
        draws.append(_Draw(n_docs, d, edges, words_of, n, lat))
        logs.append(draws[turn].log_upto(d, n))
        value.append(top)
        # What is left of the set, and what leaves the new draw after the edge.
        for t in range(turn):
            whole = np.flatnonzero((parent == t) & (known == 0))
            x, c = d[whole], cut[whole]
            push(x, (t, lo[whole], c, 0), weight_of(t, x, lo[whole], c), top[whole], 100 * turn + 3)
            push(x, (t, c + 1, hi[whole], 0), weight_of(t, x, c + 1, hi[whole]), top[whole], 100 * turn + 4)
            mine = np.flatnonzero(parent == t)
            rest = SHARE_ONE - gone[mine] - lat.share[other[mine]]
            with np.errstate(divide="ignore"):
                weight = draws[t].log_upto(d[mine], cut[mine]) / LOG_ONE + np.log(np.maximum(rest, 0) / SHARE_ONE)
            mask = np.where(known[mine] == 0, 1 << t, known[mine]) | 1 << turn
            push(d[mine], (t, cut[mine], cut[mine] + 1, mask), weight, top[mine], 100 * turn + 5)
        push(d, (turn, cut + 1, n, 0), weight_of(turn, d, cut + 1, n), top, 100 * turn + 6)
    return lat, draws, logs, value, bound.max(axis=1)


def sample(texts: list[str], keys: np.ndarray, v: Vocabulary, k: int = SAMPLES):
    """For each of the draws 1 to k: (which texts, ids end to end, how many each, log-probability, perturbed value, log inclusion score).

    A text with fewer segmentations than k has all of them; an empty text has one, without pieces. The inclusion
    score is the log-probability that the segmentation's perturbed value exceeds the next one left out, and 0 if
    none is left out.
    """
    if not texts:
        return
    lat, draws, logs, value, left = _search([split_words(t) for t in texts], keys, v, k)
    for draw, lp, top in zip(draws, logs, value, strict=True):
        lp = lp / LOG_ONE
        with np.errstate(invalid="ignore", divide="ignore"):
            over = lp - left[draw.docs]
            score = np.where(left[draw.docs] == -np.inf, 0.0, np.where(over > -30, np.log(-np.expm1(-np.exp(np.minimum(over, 700)))), over))
        ids, n = _ids(lat.ident[draw.edges], draw.n[draw.docs], v)
        yield draw.docs, ids, n, lp, top, score


def _ids(ident: np.ndarray, n: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of edges, and how many there are of each row's n edges; an edge of a bare character gives the ids of its UTF-8 bytes."""
    if not len(ident) or ident.min() >= 0:
        return ident.astype("<u4"), n
    c = -1 - ident
    size = np.where(ident < 0, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 1)
    upto = np.r_[0, np.cumsum(size)]
    at = upto[:-1]
    out = np.empty(int(upto[-1]), "<u4")
    out[at[ident >= 0]] = ident[ident >= 0]
    for m, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        mine = np.flatnonzero((ident < 0) & (size == m))
        for k in range(m):
            bits = c[mine] >> 6 * (m - 1 - k)
            out[at[mine] + k] = v.byte_ids[bits | lead if k == 0 else bits & 0x3F | 0x80]
    ends = np.cumsum(n)
    return out, upto[ends] - upto[ends - n]


def _cut_up(data: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of n[i] bytes as binary or string values."""
    ends = np.r_[0, np.cumsum(n)].astype(np.int32)
    return pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def sample_segmentations(docs: DataFrame, model_file: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, rank, ids, log_prob, perturbed, log_inclusion): up to k distinct segmentations of each whole text.

    Drawn anew only if the id or the seed changes: the partition, the order and other rows play no part, in any
    bit. Repeated rows give the same rows again. A null text is empty; a null id is a key like any other. An empty
    table gives no rows; other columns are ignored. ids are little-endian uint32.
    """

    def run(batches):
        v = vocabulary(model_file)

        def flush(ids, texts):
            keys = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}".encode()) for i in ids], np.uint64)
            ids = pa.array(ids, pa.int64())
            for rank, (which, pieces, n, lp, value, score) in enumerate(sample(texts, keys, v, k)):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(np.full(len(which), rank, np.int32)), _cut_up(pieces, 4 * n, pa.binary()), pa.array(lp), pa.array(value), pa.array(score)], names=["doc_id", "rank", "ids", "log_prob", "perturbed", "log_inclusion"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_CHARS:
                    yield from flush(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield from flush(ids, texts)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, rank int, ids binary, log_prob double, perturbed double, log_inclusion double")


def decode_segmentations(df: DataFrame, model_file: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Add ``name``: the text that little-endian uint32 ids stand for, the blank before the first word left out.

    A column of that name is replaced; all others pass through. Null ids give null, no ids give an empty text, an id outside the
    vocabulary nothing; bytes that are no UTF-8 become replacement characters.
    """
    df = df.drop(name)
    names, at = [*df.columns, name], df.columns.index(ids_col)

    def text_of(v: Vocabulary, blobs: list[bytes | None]) -> pa.Array:
        flat = np.frombuffer(b"".join(b or b"" for b in blobs), "<u4")
        flat = np.where(flat < len(v.size), flat, 0)  # the unknown piece says nothing
        ends = np.cumsum([len(b or b"") // 4 for b in blobs])
        raw = v.blob[_ranges(v.place[flat], v.size[flat])]
        upto = np.r_[0, np.cumsum(v.size[flat])]
        a, b = upto[np.r_[0, ends[:-1]]], upto[ends]
        keep = np.ones(len(raw), bool)
        first = a[b > a]
        keep[first[raw[first] == 0x20]] = False
        left = np.r_[0, np.cumsum(keep)]
        text = _cut_up(raw[keep], left[b] - left[a], pa.binary())
        try:
            text = text.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in text.to_pylist()], pa.string())
        return pa.compute.if_else(pa.array([b is not None for b in blobs]), text, pa.scalar(None, pa.string())) if None in blobs else text

    def run(batches):
        v = vocabulary(model_file)
        for batch in batches:
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False) // 4)
            lo = 0
            while lo < batch.num_rows:
                done = int(sizes[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + DECODE_IDS, "right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, text_of(v, part.column(at).to_pylist())], names=names)
                lo = hi

    return df.mapInArrow(run, with_fields(df.schema, f"`{name}` string"))
