"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document's distinct word shingles are put in one global order, rarest first. Two sets that meet the
threshold must share at least ``l`` of their first ``n - t + l`` shingles, ``t`` being the least overlap that any
partner can have. The first ``n - t + 1`` generate candidates; a document whose generators are expected to meet
many others keeps a longer prefix and so demands more shared shingles before anything is verified.

The order comes from a sketch of shingle frequencies over the whole corpus; its counters are more on a larger corpus, and
keep the logarithm of what they counted. It only has to be the same for all documents: a poor estimate costs time,
never a link.

Sets that are equal are one class and take part once, under their smallest document id. Candidates come from 64-bit
hashes; what is linked is verified on the words themselves. Documents that share an id are one vertex, linked as any
of their texts is.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.graph import connected_components
from loglattice.llm.runtime import gather, hash_words, materialize, mix64, sum_slices

#: Counters of the frequency sketch: about one for so many bytes of text, within these powers of two. A counter is
#: two bytes in a task that counts, eight where the tasks are added up, and one (a logarithm) in what all tasks get.
SKETCH_BYTES, SKETCH_BITS = 32, (16, 25)
SLICES = 64
#: One-byte counter to count: eight steps to a doubling.
COUNT_OF = np.exp2(np.arange(256) / 8) - 1
#: Groups up to this size give their pairs at once; larger ones go by pivots and blocks.
SMALL = 8
BLOCK = 1024
#: Shingles whose rows are compared at once within two blocks.
COLUMNS = 4096


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of all shingles in order, with repeats; ASCII letters lower-cased, words split at ASCII white space."""
    h = hash_words((text or "").encode())
    if not len(h):
        return h
    size, n = min(words, len(h)), max(1, len(h) - words + 1)
    out = h[:n] + np.uint64(size)
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
    return mix64(out)


def sorted_set(hashes: np.ndarray) -> np.ndarray:
    out = np.sort(hashes)
    return out[np.diff(out, prepend=~out[:1]) != 0]


def least_overlap(n, percent: int):
    """The overlap that a set of n must have with any partner."""
    return (percent * n + 99) // 100


def pair_overlap(a, b, percent: int):
    """The overlap that sets of a and b must have: 100 * i >= percent * (a + b - i)."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def frequency_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Logarithms of counts of hashed shingles over all documents, as COUNT_OF reads them. Goes to the driver: 2^25 bytes at most."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], (size // SKETCH_BYTES).bit_length()))

    def count(batches):
        sums = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            held, size = [], 0
            for text in [*batch.column(0), None]:
                if text is not None:
                    held.append((shingles(text.as_py(), words) >> np.uint64(64 - bits)).astype(np.int64))
                    size += len(held[-1])
                if held and (text is None or size >= 1 << 20):
                    slots = np.sort(np.concatenate(held))
                    first = np.flatnonzero(np.diff(slots, prepend=-1))
                    at, n = slots[first], np.diff(first, append=len(slots))
                    sums[at] = np.minimum(65535, sums[at].astype(np.int64) + n)
                    held, size = [], 0
        for k, part in enumerate(np.split(sums, SLICES)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": pa.array([part.astype("<u2").tobytes()], pa.binary())})

    def logarithm(batches):
        for pdf in batches:
            pdf["counts"] = [np.minimum(255, np.rint(8 * np.log2(1.0 + np.frombuffer(c, "<i8")))).astype(np.uint8).tobytes() for c in pdf["counts"]]
            yield pdf

    parts = sum_slices(docs.select("text").mapInArrow(count, "slice int, counts binary"), "<u2").mapInPandas(logarithm, "slice int, counts binary")
    out = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for row in gather(parts):
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(-1)


def prefix_of(own: np.ndarray, sketch: np.ndarray, usual: float, percent: int) -> tuple[int, np.ndarray]:
    """(how many generate candidates, the prefix in global order) of a sorted shingle set; ``usual``: a counter's mean count."""
    n = len(own)
    if not n:
        return 0, own
    t = least_overlap(n, percent)
    est = sketch[(own >> np.uint64(65 - len(sketch).bit_length())).astype(np.int64)]
    order = np.argsort(est, kind="stable")  # ties by hash
    g = n - t + 1
    cost = np.maximum(0.0, COUNT_OF[est[order[:g]]] - 2 * usual).sum()
    l = int(min(t, 1 + round(g * min(1.0, np.log2(1 + cost) / 8))))  # noqa: E741
    return g, own[order[: n - t + l]]


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, gens, prefix): prefix holds little-endian hashes in global order, its first ``gens`` generate."""
    sketch = frequency_sketch(docs, words)
    usual = float(COUNT_OF[sketch[:: 1 << 8]].mean()) + 1
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for batch in batches:
            n_, sig, gens, prefix = [], [], [], []
            for text in batch.column(1):
                own = sorted_set(shingles(text.as_py(), words))
                g, first = prefix_of(own, shared.value, usual, percent)
                n_.append(len(own))
                gens.append(g)
                sig.append(xxhash.xxh3_128_digest(own.tobytes()))
                prefix.append(first.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_, pa.int32()), pa.array(sig, pa.binary()), pa.array(gens, pa.int32()), pa.array(prefix, pa.binary())], names=["doc_id", "n", "sig", "gens", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, sig binary, gens int, prefix binary")


def _explode(batches):
    """Generator shingles of each representative."""
    for batch in batches:
        rep, n, gens, prefix = (batch.column(k) for k in range(4))
        g = gens.to_numpy()
        token = np.concatenate([np.frombuffer(p.as_py(), "<i8")[:k] for p, k in zip(prefix, g, strict=True)]) if len(g) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(rep.to_numpy(), g)), pa.array(np.repeat(n.to_numpy(), g))], names=["token", "rep", "n"])


def _meetings(percent: int):
    """Rows sorted by token to meetings: kind 0 a pair of a small group, kind 1 a member b of a large group with its pivot a."""
    schema = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("a", pa.int64()), ("na", pa.int32()), ("b", pa.int64()), ("nb", pa.int32())])

    def batch_of(kind, token, a, na, b, nb):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(token), pa.array(a), pa.array(na), pa.array(b), pa.array(nb)], schema=schema)

    def run(batches):
        held, pivot = None, None  # rows of the last group so far; or (rep, n, token) of a large group that goes on
        for batch in batches:
            got = [batch.column(k).to_numpy() for k in range(3)]
            token, rep, n = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            held = None
            if pivot is not None and len(token):
                more = int(np.searchsorted(token != pivot[2], True))
                if more:
                    yield from large(token[:more], rep[:more], n[:more], pivot)
                token, rep, n = token[more:], rep[more:], n[more:]
                pivot = None if len(token) else pivot
            if not len(token):
                continue
            last = int(np.searchsorted(token == token[-1], True))
            yield from groups(token[:last], rep[:last], n[:last])
            tail = token[last:], rep[last:], n[last:]
            if len(tail[0]) > SMALL:
                pivot = rep[last], n[last], token[last]
                yield from large(*tail, pivot)
            else:
                held = tail
        if held is not None:
            yield from groups(*held)

    def large(token, rep, n, pivot):
        yield batch_of(1, token, np.full(len(rep), pivot[0], np.int64), np.full(len(rep), pivot[1], np.int32), rep, n)

    def groups(token, rep, n):
        if not len(token):
            return
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[start, len(token)])
        for s in range(1, SMALL):  # pairs at distance s within small groups
            i = np.flatnonzero(np.repeat((size > s) & (size <= SMALL), size))
            group = np.repeat(np.arange(len(size)), size)
            i = i[i + s < len(token)]
            i = i[group[i] == group[i + s]]
            j = i + s
            fits = (least_overlap(np.maximum(n[i], n[j]).astype(np.int64), percent) <= np.minimum(n[i], n[j])) & (rep[i] != rep[j])
            i, j = i[fits], j[fits]
            swap = rep[i] > rep[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                yield batch_of(0, token[i], rep[i], n[i], rep[j], n[j])
        big = np.repeat(size > SMALL, size)
        if big.any():
            at = np.repeat(start, size)[big]
            yield batch_of(1, token[big], rep[at], n[at], rep[big], n[big])

    return run


def _block_pairs(percent: int):
    """Rows sorted by (token, x, y): one pair of blocks of a group at a time, to the pairs that share enough."""

    def pairs_of(token, block, x, y, rep, n, label, gens, prefix):
        parts = [np.frombuffer(p, "<i8") for p in prefix]
        size = np.array([len(p) for p in parts])
        vocabulary, where = np.unique(np.concatenate(parts), return_inverse=True)
        common = np.bincount(where) > 1
        column = np.cumsum(common) - 1
        row = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
        mine = np.array([int(np.flatnonzero(p == token)[0]) for p in parts])
        use = common[where]
        early = use & (place < mine[row])
        a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
        n = n.astype(np.int64)
        # Shared shingles are counted some columns at a time, so memory is that of two blocks of rows, however long their prefixes.
        hits, before = np.zeros((2, len(a), len(b)), np.float32)
        order = np.argsort(column[where[use]], kind="stable")
        rows, columns, is_early = row[use][order], column[where[use]][order], early[use][order]
        for at in range(0, int(common.sum()), COLUMNS):
            lo, hi = np.searchsorted(columns, [at, at + COLUMNS])
            some = np.zeros((len(parts), COLUMNS), np.float32)
            some[rows[lo:hi], columns[lo:hi] - at] = 1
            hits += some[a] @ some[b].T
            some[rows[lo:hi][~is_early[lo:hi]], columns[lo:hi][~is_early[lo:hi]] - at] = 0
            before += some[a] @ some[b].T
        first = before == 0
        na, nb = n[a][:, None], n[b][None, :]
        o = pair_overlap(na, nb, percent)
        need = np.minimum(size[a][:, None] - na + o, size[b][None, :] - nb + o)
        fits = (least_overlap(np.maximum(na, nb), percent) <= np.minimum(na, nb)) & (label[a][:, None] != label[b][None, :])
        if x == y:
            fits &= rep[a][:, None] < rep[b][None, :]
        i, j = np.nonzero(fits & first & (hits >= need))
        return rep[a[i]], rep[b[j]]

    def run(batches):
        held: list[pd.DataFrame] = []
        key = None

        def flush():
            pdf = pd.concat(held)
            for (token, x, y), g in pdf.groupby(["token", "x", "y"], sort=False):
                if g["label"].nunique() > 1:
                    p, q = pairs_of(token, g["block"].to_numpy(), x, y, g["rep"].to_numpy(), g["n"].to_numpy(), g["label"].to_numpy(), g["gens"].to_numpy(), g["prefix"].tolist())
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            ends = pdf.iloc[-1][["token", "x", "y"]].tolist()
            tail = (pdf["token"] == ends[0]) & (pdf["x"] == ends[1]) & (pdf["y"] == ends[2])
            if key is not None and key != ends:
                held.append(pdf[~tail])
                yield from flush()
                held = []
            elif key is None and not tail.all():
                held.append(pdf[~tail])
                yield from flush()
                held = []
            held.append(pdf[tail])
            key = ends
        if held:
            yield from flush()

    return run


def demanded(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int) -> bool:
    """Whether two prefixes share as much as any pair that meets the threshold: the longer they are, the more."""
    o = pair_overlap(na, nb, percent)
    return len(np.intersect1d(a, b, assume_unique=True)) >= min(len(a) - na, len(b) - nb) + o


def _demand(percent: int):
    def run(batches):
        for batch in batches:
            na, nb, pa_, pb = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [demanded(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), m, n, percent) for p, q, m, n in zip(pa_, pb, na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def overlap_of_words(s: str | None, t: str | None, words: int) -> tuple[int, int, int]:
    """(size of either shingle set, size of their intersection), by the words themselves."""
    a, b = ((x or "").encode().lower().split() for x in (s, t))
    if len(a) < words or len(b) < words:  # the whole sequence is the only shingle of a short text, and no other text has it
        n = [min(1, len(x)) if len(x) < words else len(set(zip(*(x[k:] for k in range(words)), strict=False))) for x in (a, b)]
        return n[0], n[1], int(bool(a) and a == b)
    number = {w: k for k, w in enumerate(dict.fromkeys(chain(a, b)))}
    ids = [np.fromiter(map(number.__getitem__, x), np.uint64, len(x)) for x in (a, b)]
    bits = len(number).bit_length()
    keys = [x[: len(x) - words + 1] for x in ids]
    for k in range(1, words):
        keys = [key << np.uint64(bits) | x[k : len(x) - words + 1 + k] for key, x in zip(keys, ids, strict=True)]
        if (k + 2) * bits > 64 and k < words - 1:  # the next word would not fit: ranks take the keys' place
            _, rank = np.unique(np.concatenate(keys), return_inverse=True)
            keys = np.split(rank.astype(np.uint64), [len(keys[0])])
    p, q = map(np.unique, keys)
    return len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))


def _verify(words: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q, i = overlap_of_words(s, t, words)
                if i and 100 * i >= percent * (p + q - i):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

    return run


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, components): members(doc_id, rep, n) of every row; components(node, component) of linked ids.

    ``docs`` needs doc_id and text; other columns are ignored. Null or empty texts have n = 0 and no links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialize(prefixes(docs, words, percent), "jaccard-prefixes")
    reps = materialize(table.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")), "jaccard-reps")
    members = table.select("doc_id", "n", "sig").join(reps, "sig", "left").select("doc_id", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"), "n")
    members = materialize(members, "jaccard-members")
    own = table.where("n > 0").join(reps.withColumnRenamed("sig", "s"), (F.col("doc_id") == F.col("rep")) & (F.col("sig") == F.col("s"))).select("rep", "n", "gens", "prefix")
    own = materialize(own.dropDuplicates(["rep", "prefix"]), "jaccard-own", (table, reps))
    exploded = own.select("rep", "n", "gens", "prefix").mapInArrow(_explode, "token long, rep long, n int")
    met = exploded.repartition("token").sortWithinPartitions("token", "rep").mapInArrow(_meetings(percent), "kind int, token long, a long, na int, b long, nb int")
    met = materialize(met, "jaccard-met")

    # Small groups gave all their pairs: how many generators a pair shares, but for those of large groups.
    large = met.where("kind = 1").select("token", F.col("a").alias("pivot"), F.col("na").alias("n_pivot"), F.col("b").alias("rep"), F.col("nb").alias("n"))
    heavy = materialize(large.groupBy("rep").agg(F.count(F.lit(1)).alias("h")), "jaccard-heavy")
    counts = met.where("kind = 0").groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("hits"))
    counts = counts.join(heavy.select(F.col("rep").alias("a"), F.col("h").alias("ha")), "a", "left").join(heavy.select(F.col("rep").alias("b"), F.col("h").alias("hb")), "b", "left")
    t = lambda c: f"cast(floor(({percent} * {c} + 99) / 100) as bigint)"
    o = f"cast(floor(({percent} * (na + nb) + {99 + percent}) / {100 + percent}) as bigint)"
    need = F.expr(f"1 + {o} - greatest({t('na')}, {t('nb')})")
    direct = counts.where(F.col("hits") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= need).select("a", "b")
    small, big = F.least("n", "n_pivot"), F.greatest("n", "n_pivot")
    starred = large.where((F.col("pivot") != F.col("rep")) & (big * percent <= small * 100)).select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
    tried = materialize(direct.unionByName(starred).distinct(), "jaccard-tried")
    edges = verified(tried, own, docs, words, percent)
    linked = connected_components(edges)

    # What large groups still hold of different components: blocks against blocks, with the long prefixes.
    labelled = large.select("token", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("label"))
    labelled = materialize(labelled, "jaccard-labelled", (met, heavy, linked))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    mixed = materialize(mixed.select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "jaccard-mixed")
    rows = labelled.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    rows = rows.join(own, "rep").select("token", "x", "y", "block", "rep", "n", "label", "gens", "prefix")
    left = rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(_block_pairs(percent), "a long, b long").distinct()
    left = materialize(left.join(tried, ["a", "b"], "left_anti"), "jaccard-left", (labelled, mixed, tried))
    more = verified(left, own, docs, words, percent)
    several = members.where("n > 0").groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("dst")).where("src <> dst").select("src", "dst")
    return members, connected_components(edges.unionByName(more).unionByName(several))


def verified(pairs: DataFrame, own: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share what theirs must, and whose texts meet the threshold exactly, as (src, dst)."""
    side = lambda c: own.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_demand(percent), "a long, b long")
    pairs = materialize(close, "jaccard-close")
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    texts = materialize(docs.where("doc_id is not null").join(ids.withColumnRenamed("a", "doc_id"), "doc_id"), "jaccard-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, percent), "src long, dst long"), "jaccard-edges", (pairs, texts))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Null and empty texts, and texts without words, have no shingles and are alone. A null id is linked as its text is
    and may have a null component. Rows that share an id are one vertex. An empty table gives no rows; other columns
    are ignored.
    """
    members, linked = jaccard_links(docs, words, percent)
    out = members.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; of repeated ids one row stays.

    Rows with a null id stay, and so does each row of a null or empty text. An empty table stays empty.
    """
    # The decision is written once and small; the rows are then filtered by their own id.
    members, linked = jaccard_links(docs, words, percent)
    gone = members.join(linked.withColumnRenamed("node", "rep"), "rep", "left").where(F.col("doc_id") != F.coalesce("component", "rep")).select("doc_id").distinct()
    gone = materialize(gone, "jaccard-gone")
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null")).select(*docs.columns)
