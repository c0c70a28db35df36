"""Spelling variants: words one edit apart, by merging light subtrees of a trie into its heavy paths.

Each trie node has a heavy child: the one with the most words below it (ties: the smallest letter). A light subtree
is merged into the heavy one, never the other way, so a word is copied once for each light edge on its path, at most
log2(words) times. For a word ``u + c + rest`` that leaves node ``u`` by the light letter ``c``, with heavy letter ``h``, its
copies end at ``u + h + rest`` (replaced), ``u + rest`` (its letter skipped) and ``u + h + c + rest`` (the heavy letter skipped);
two light words with one ``rest`` end at the same place too. Where ends coincide, two words are one edit apart, and each pair
is found once, at the node where the two part.

On the cluster the trie is cut below its large nodes (more than ``SUBTREE`` words). A subtree below is merged inside one
task; large nodes are few (at most words / SUBTREE a depth), their heavy letters go to every task, and the copies that end
beyond a subtree meet the words by a join. A node's light words with one ``rest`` are at most one a letter, so no group is large,
and near words are counted and compared by aggregation.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.runtime import gather, materialize

#: Fixed by the definition of the misspelt runs.
EVERY = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of a subtree that one task merges.
SUBTREE = 100_000
#: Depths of prefixes counted in one pass over the words.
DEPTHS = 4
#: Distinct runs that a task holds while it counts, about 200 bytes each; then what it has goes on.
HELD = 600_000
#: A run of letters is [A-Za-z\u00C0-\u00FF]+, all of it in Latin-1: A-Z become a-z, whatever is no letter becomes a space.
LETTERS = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 0xC0 else 32 for k in range(256))


# --- counting the words ---


@lru_cache(maxsize=4096)
def _zeros(n: int) -> np.ndarray:
    """CRC-32 is linear: four tables, by byte of a register, of what it becomes when n zero bytes follow."""
    one = np.array([zlib.crc32(bytes(n), 1 << k) ^ zlib.crc32(bytes(n), 0) for k in range(32)], np.uint32)
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for value in range(1, 256):
            low = value & -value
            tables[byte, value] = tables[byte, value ^ low] ^ one[8 * byte + low.bit_length() - 1]
    return tables


class Runs(dict):
    """Numbers for runs of letters (Latin-1, in lower case) as they are met, with length and CRC-32 of each in UTF-8."""

    def __init__(self):
        self.words: list[str] = []
        self.crcs: list[int] = []
        self.sizes: list[int] = []

    def __missing__(self, run: bytes) -> int:
        k = self[run] = len(self.words)
        word = run.decode("latin-1")
        raw = word.encode()
        self.words.append(word)
        self.crcs.append(zlib.crc32(raw))
        self.sizes.append(len(raw))
        return k


def misspell(word: str, h: int) -> str:
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def letters(text: str) -> list[bytes]:
    """The maximal runs of letters of a text, in order."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def count_batch(keys: list, texts: list, runs: Runs, slips: dict[str, int], counts: np.ndarray) -> np.ndarray:
    """Add the runs of some documents: to ``counts`` by number, and to ``slips`` those that a letter is taken from."""
    found = [np.fromiter(map(runs.__getitem__, split), np.int32, len(split)) for split in map(letters, texts)]
    crcs, sizes = np.array(runs.crcs, np.uint32), np.array(runs.sizes, np.int64)
    if len(crcs) > len(counts):
        counts = np.r_[counts, np.zeros(len(crcs) - len(counts), np.int64)]
    longest = int(sizes.max(initial=0))
    for key, ids in zip(keys, found, strict=True):
        if not len(ids):
            continue
        prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
        of = sizes[ids]
        if longest <= 256:
            moved = _shifted(prefix, longest)[of]
        else:  # a run of no language: lengths one by one
            moved = np.array([_shift(prefix, int(n)) for n in of], np.uint32)
        h = moved ^ crcs[ids]
        for k in np.flatnonzero(h % EVERY == 0).tolist():
            n = int(ids[k])
            slip = misspell(runs.words[n], int(h[k]))
            slips[slip] = slips.get(slip, 0) + 1
            ids[k] = -1
    if found:
        every = np.concatenate(found)
        counts += np.bincount(every[every >= 0], minlength=len(counts))
    return counts


def _shift(crc: int, n: int) -> int:
    t = _zeros(n)
    return int(t[0, crc & 255] ^ t[1, crc >> 8 & 255] ^ t[2, crc >> 16 & 255] ^ t[3, crc >> 24])


@lru_cache(maxsize=8)
def _tables(longest: int) -> np.ndarray:
    return np.stack([_zeros(n) for n in range(longest + 1)])


def _shifted(crc: int, longest: int) -> np.ndarray:
    """The register after each number of zero bytes up to ``longest``."""
    t = _tables(longest)
    return t[:, 0, crc & 255] ^ t[:, 1, crc >> 8 & 255] ^ t[:, 2, crc >> 16 & 255] ^ t[:, 3, crc >> 24]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): how often each word stands in all documents, at least ``MIN_COUNT`` times; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            total: dict[str, int] = defaultdict(int, slips)
            for word, n in zip(runs.words, counts.tolist(), strict=True):
                if n:
                    total[word] += n
            kept = [w for w in total if len(w) >= MIN_LENGTH]
            return pa.RecordBatch.from_pydict({"word": pa.array(kept, pa.string()), "n": pa.array([total[w] for w in kept], pa.int64())})

        runs, slips, counts = Runs(), {}, np.zeros(0, np.int64)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                counts = count_batch(keys[at : at + 256], texts[at : at + 256], runs, slips, counts)
                if len(runs) + len(slips) > HELD:
                    yield out()
                    runs, slips, counts = Runs(), {}, np.zeros(0, np.int64)
        yield out()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- one subtree ---


def better(a: tuple[int, str], b: tuple[int, str] | None) -> bool:
    """Whether near word ``a`` (n, word) goes before ``b``: the larger n, then the smaller word."""
    return b is None or a[0] > b[0] or (a[0] == b[0] and a[1] < b[1])


def subtree_pairs(words: list[str], depth: int) -> Iterator[tuple[str, str]]:
    """All pairs one edit apart that part at ``depth`` letters or later, each once; ``words`` sorted, distinct, sharing ``depth`` letters."""
    here = set(words)
    # Nodes where words part are runs of the sorted words: a stack of open ones, closed as the common prefix shrinks.
    stack: list[tuple[int, int]] = []  # (depth of the node, its first word)
    for k in range(1, len(words) + 1):
        common = _common(words[k - 1], words[k]) if k < len(words) else depth - 1
        start = k - 1
        while stack and stack[-1][0] > common:
            at, start = stack.pop()
            yield from _merge(words, at, start, k, here)
        if common >= depth and (not stack or stack[-1][0] < common):
            stack.append((common, start))


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # the first difference is at low or later, at high or earlier
    while low < high:
        mid = (low + high) // 2
        if a[: mid + 1] == b[: mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


def _merge(words: list[str], at: int, start: int, end: int, here: set[str]) -> Iterator[tuple[str, str]]:
    """Merge the light children of the node of words[start:end] at depth ``at`` into its heavy one."""
    u = words[start][:at]
    own = len(words[start]) == at
    children, k = [], start + own
    while k < end:
        first, c = k, words[k][at]
        while k < end and words[k][at] == c:
            k += 1
        children.append((k - first, c, first))
    if not children:
        return
    heavy = max(children, key=lambda x: (x[0], -ord(x[1])))
    uh = u + heavy[1]
    if own and uh in here:
        yield u, uh
    rests: dict[str, list[str]] = {}
    for size, c, first in children:
        if c == heavy[1]:
            continue
        for word in words[first : first + size]:
            rest = word[at + 1 :]
            if uh + rest in here:
                yield word, uh + rest
            if rest[:1] != c and u + rest in here:
                yield word, u + rest
            if uh + word[at:] in here:
                yield word, uh + word[at:]
            if rest in rests:
                for other in rests[rest]:  # at most one a letter
                    yield word, other
                rests[rest].append(word)
            else:
                rests[rest] = [word]


# --- the whole trie ---


def large_nodes(words: DataFrame, subtree: int) -> dict[str, str]:
    """Heavy letter of every trie node with more than ``subtree`` words. There are at most words / subtree such nodes a depth."""
    heavy: dict[str, str] = {}
    open_, depth = [""] if words.limit(subtree + 1).count() > subtree else [], 0
    while open_:
        # The prefixes of the next few depths below open nodes; a depth below a small node is not asked for.
        below = words.join(F.broadcast(words.sparkSession.createDataFrame([(x,) for x in open_], "_u string")), F.substring("word", 1, depth) == F.col("_u")) if depth else words
        sizes = below.select(F.explode(F.transform(F.sequence(F.lit(depth + 1), F.lit(depth + DEPTHS)), lambda k: F.when(F.length("word") >= k, F.substring(F.col("word"), F.lit(1), k)))).alias("p")).where("p is not null")
        counted = sizes.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("u", F.expr("substring(p, 1, length(p) - 1)")).withColumn("c", F.expr("substring(p, length(p), 1)"))
        best = counted.groupBy("u").agg(F.sum("n").alias("below"), F.min(F.struct(-F.col("n"), "c"))["c"].alias("c"))
        last = counted.where((F.col("n") > subtree) & (F.length("p") == depth + DEPTHS)).select(F.col("p").alias("u"), F.lit(None).cast("string").alias("c"))
        # A large node's children, and itself as a word, are more than subtree: so is one less than that.
        found = gather(best.where(F.col("below") >= subtree).select("u", "c").unionByName(last))
        heavy |= {r["u"]: r["c"] for r in found if r["c"] is not None}
        open_ = [r["u"] for r in found if r["c"] is None]
        depth += DEPTHS
    # Nodes are large from the root down, so that a word's large nodes are its first letters.
    return {u: c for u, c in heavy.items() if all(u[:k] in heavy for k in range(len(u)))}


def near_words(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, n_near, best): how many words are one edit from each that has any, and the first of them as (-n, word)."""
    heavy = large_nodes(words, subtree)
    # Each word belongs to the subtree below its last large node; one that ends at a large node is alone in its own.
    top = max(map(len, heavy), default=-1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in range(min(top, len(word)) + 1):
                    u = word[:at]
                    h = heavy.get(u)
                    if h is None:
                        break
                    if at == len(word):
                        rows.append((word, n, u + h, False))
                        break
                    c, rest = word[at], word[at + 1 :]
                    if c == h:
                        continue
                    rows.append((word, n, u + h + rest, False))
                    if rest[:1] != c:
                        rows.append((word, n, u + rest, False))
                    rows.append((word, n, u + h + word[at:], False))
                    rows.append((word, n, f"{u} {rest}", True))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_pydict({"word": pa.array(cols[0], pa.string()), "n": pa.array(cols[1], pa.int64()), "at": pa.array(cols[2], pa.string()), "light": pa.array(cols[3], pa.bool_())})

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("word")
        words = group.column("word").to_pylist()
        counts = dict(zip(words, group.column("n").to_pylist(), strict=True))
        near: dict[str, list] = {}
        for a, b in subtree_pairs(words, len(group.column("below")[0].as_py())):
            for x, y in ((a, b), (b, a)):
                got = near.setdefault(x, [0, None])
                got[0] += 1
                if better((counts[y], y), got[1]):
                    got[1] = (counts[y], y)
        first = [v[1] for v in near.values()]
        return pa.table({
            "word": pa.array(list(near), pa.string()), "n_near": pa.array([v[0] for v in near.values()], pa.int64()),
            "minus": pa.array([-n for n, _ in first], pa.int64()), "other": pa.array([w for _, w in first], pa.string()),
        })

    sub = _subtree_of(words, heavy, top).groupBy("below").applyInArrow(merge, "word string, n_near long, minus long, other string")
    parts = sub.select("word", "n_near", F.struct("minus", "other").alias("best"))
    if heavy:
        ends = materialize(words.mapInArrow(deal, "word string, n long, at string, light boolean"), "trie-ends")
        best = lambda n, w: F.struct((-F.col(n)).alias("minus"), F.col(w).alias("other")).alias("best")
        met = ends.where("not light").join(words.select(F.col("word").alias("at"), F.col("n").alias("m")), "at")
        one, two = met.select("word", F.lit(1).alias("n_near"), best("m", "at")), met.select(F.col("at").alias("word"), F.lit(1).alias("n_near"), best("n", "word"))
        # Light words with one rest are at most one a letter.
        same = ends.where("light").groupBy("at").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col("word").alias("other")))).alias("all")).where(F.size("all") > 1)
        member = same.select("all", F.explode("all").alias("me"))
        light = member.select(F.col("me.other").alias("word"), (F.size("all") - 1).alias("n_near"), F.when(F.col("all")[0]["other"] == F.col("me.other"), F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
        for more in (one, two, light):
            parts = parts.unionByName(more)
    return parts.groupBy("word").agg(F.sum("n_near").cast("long").alias("n_near"), F.min("best").alias("best"))


def _subtree_of(words: DataFrame, heavy: dict[str, str], top: int) -> DataFrame:
    """Add ``below``: the prefix whose subtree a word is merged in, one letter longer than its last large node."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below = []
            for word in batch.column(0).to_pylist():
                at = 0
                while at <= top and at <= len(word) and word[:at] in heavy:
                    at += 1
                below.append(word[:at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(below, pa.string())], names=["word", "n", "below"])

    return words.mapInArrow(add, "word string, n long, below string")


def variant_roots(words: DataFrame, near: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): forms are followed by doubling, which ends as n doubles with every step."""
    told = words.join(near, "word", "left")
    form_n = -F.col("best.minus")
    has = F.coalesce(form_n >= 2 * F.col("n"), F.lit(False))
    told = materialize(told.select("word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, form_n).alias("form_n")), "trie-forms")
    step = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "trie-roots")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return told.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", subtree: int = SUBTREE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``MIN_LENGTH`` letters that stands ``MIN_COUNT`` times in all documents.

    Defined cases: a null text has no words, a null key is hashed as the empty string, repeated rows count each, an empty table gives
    no rows; columns other than key and text are not looked at. Two words are near if one inserted, deleted or replaced letter
    parts them; the form is the near word of largest n (ties: the smallest in code-point order) if that is at least twice the
    word's n, and the root follows forms to the last.
    """
    words = materialize(word_counts(docs, key, text), "trie-words")
    return variant_roots(words, near_words(words, subtree))
