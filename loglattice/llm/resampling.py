"""Quality by importance resampling.

Two hashed n-gram models are fitted: one of the target (labelled good text), one of the raw corpus. A document's
importance weight is the ratio of its probability under the two, tilted by a per-gram threshold that the labels
settle; Gumbel noise, keyed by the document, makes the k largest perturbed weights a sample without
replacement. k is a stated share of the documents or, without one, the number of those on the good side of the
threshold: either grows with the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.runtime import gather, hash_words, materialize, mix64, sum_slices, uniform

#: Half of the buckets are for words, half for word pairs.
BUCKETS = 1 << 20
SLICES = 64
#: Labelled rows used at most, taken in the order of a hash of their id.
LABELLED = 20_000
#: One labelled row in so many settles the threshold; the rest fit the target model.
HELD_OUT = 4
#: Counts at the raw model's rate that each bucket of the target model starts with.
PRIOR = 8.0
#: Log ratios are drawn towards 0 by so much: what all clean text gains on raw text says nothing of one document.
SHRINK = 0.3
#: Gumbel noise is added to weight / TEMPERATURE: at 1 documents are drawn by their importance weights.
TEMPERATURE = 1.0


def gram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all words and word pairs of the whole text, in lower case, without punctuation at their ends."""
    h = hash_words((text or "").lower().encode(), strip=b".,;:!?\"'()[]")
    with np.errstate(over="ignore"):
        pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    half = np.uint64(BUCKETS // 2)
    return np.concatenate([h % half, pairs % half + half]).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, threshold per gram). ``labels``: doc_id, quality, toxic; good is quality 1 and not toxic.

    The raw model counts every document; the target model the good ones among at most LABELLED labelled rows, but
    for those held out, on which the threshold is settled.
    Without good or without bad labels nothing can be told apart: the threshold is then below every score.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int") * (F.coalesce("toxic", F.lit(0)) == 0).cast("int")).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    # At most LABELLED ids go to the driver and to the tasks.
    marks = {r["doc_id"]: bool(r["good"]) for r in chosen.collect()}
    held_out = {i for i in marks if xxhash.xxh3_64_intdigest(str(i)) % HELD_OUT == 0}
    shared = spark.sparkContext.broadcast({i for i, good in marks.items() if good and i not in held_out})

    def count(batches):
        raw, good, held = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = gram_buckets(text.as_py())
                held.append(b)
                if i in shared.value:
                    np.add.at(good, b, 1)
                if len(held) >= 1000:
                    raw += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held = []
        raw += np.bincount(np.concatenate(held), minlength=BUCKETS) if held else 0
        for k, part in enumerate(np.split(np.stack([raw, good]), SLICES, axis=1)):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": pa.array([part.astype("<i8").tobytes()], pa.binary())})

    sums = np.zeros((2, SLICES, BUCKETS // SLICES))
    for row in gather(sum_slices(docs.select("doc_id", "text").mapInArrow(count, "slice int, counts binary"))):  # 2 * BUCKETS numbers
        sums[:, row["slice"]] = np.frombuffer(row["counts"], "<i8").reshape(2, -1)
    raw, good = sums.reshape(2, BUCKETS)
    # The target model is the raw model updated by the labelled text: a bucket that it says little of has a ratio near 1.
    ratio = np.log((good + PRIOR) / (raw * (good.sum() / max(raw.sum(), 1)) + PRIOR))
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - SHRINK)
    known = score(docs.where(_marked(spark.sparkContext.broadcast(held_out))(F.col("doc_id"))), ratio, 0.0).where("n_grams > 0").select("doc_id", (F.col("log_weight") / F.col("n_grams")).alias("mean"))
    rows = gather(known)  # a row for each held-out label
    x = np.array([r["mean"] for r in rows])
    y = np.array([marks[r["doc_id"]] for r in rows], bool)
    return ratio, _threshold(x, y)


def _marked(shared):
    @F.pandas_udf("boolean")
    def marked(ids):
        return ids.isin(shared.value)

    return marked


def _threshold(x: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least mistakes, a good document lost counting twice; in the middle of the gap there."""
    if good.all() or not good.any():
        return -np.inf if not len(x) or good.all() else float(x.min()) - 1
    order = np.argsort(x, kind="stable")
    x, good = x[order], good[order]
    lost = 2.0 * np.r_[0, np.cumsum(good)] + np.r_[np.cumsum(~good[::-1])[::-1], 0]
    k = int(np.argmin(lost))
    return float(x[0] - 1e-9) if k == 0 else float(x[-1] + 1e-9) if k == len(x) else float((x[k - 1] + x[k]) / 2)


def score(docs: DataFrame, ratio: np.ndarray, threshold: float, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key) of every row; a text without words has weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            n, w, key = _weigh(batch.column(0), batch.column(1), shared.value, threshold, temperature)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(w), pa.array(key)], names=["doc_id", "n_grams", "log_weight", "gumbel_key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double, gumbel_key double")


def _weigh(ids: pa.Array, texts: pa.Array, ratio: np.ndarray, threshold: float, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_grams, log_weight, gumbel_key) of rows: each row's are the same to the bit, whatever rows come with it."""
    n, w = np.zeros(len(ids), np.int64), np.zeros(len(ids))
    for k, text in enumerate(texts):
        b = gram_buckets(text.as_py())
        n[k], w[k] = len(b), ratio[b].sum()
    w = w - np.where(n > 0, n * max(threshold, -1e6), 0)
    hashed = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) for i in ids.to_pylist()], np.uint64)
    noise = np.array([-math.log(-math.log(u)) for u in uniform(mix64(hashed)).tolist()])
    return n, w, w / temperature + noise


def kth_largest(scored: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly, by counting values by 16 bits of their order at a time: four passes of bounded size."""
    def ordered(values: np.ndarray) -> np.ndarray:
        raw = values.view(np.uint64)
        return np.where(raw >> np.uint64(63) == 1, ~raw, raw | np.uint64(1 << 63))

    prefix, left = 0, k
    for step in range(4):
        shift = 48 - 16 * step

        def digits(batches, shift=shift, prefix=prefix, step=step):
            sums = np.zeros(1 << 16, np.int64)
            for batch in batches:
                u = ordered(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64))
                if step:
                    u = u[u >> np.uint64(shift + 16) == prefix]
                sums += np.bincount(((u >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["digit", "n"])

        counts = np.zeros(1 << 16, np.int64)
        for row in scored.select(column).mapInArrow(digits, "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n")).collect():
            counts[row["digit"]] = row["n"]
        above = np.cumsum(counts[::-1])
        at = int(np.searchsorted(above, left))
        if at == 1 << 16:
            return None
        digit = (1 << 16) - 1 - at
        left -= int(above[at] - counts[digit])
        prefix = prefix << 16 | digit
    bits = np.array([prefix], np.uint64)
    raw = np.where(bits >> np.uint64(63) == 1, bits & np.uint64((1 << 63) - 1), ~bits)
    return float(raw.astype(np.uint64).view(np.float64)[0])


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key) of the documents drawn: the k largest perturbed weights.

    k is ``share`` of the rows, rounded up, or the number of rows whose weight is not negative. Rows that tie with the last
    one are drawn too, so repeated rows stay or go together. A null or empty text weighs 0 and counts as good; a null id
    is drawn like any other. An empty table gives no rows; other columns are ignored.
    """
    ratio, threshold = fit(docs, labels)
    scored, cut = _scored(docs, ratio, threshold, share, temperature)
    return scored.where(F.col("gumbel_key") >= cut) if cut is not None else scored.limit(0)


def _scored(docs: DataFrame, ratio: np.ndarray, threshold: float, share: float | None = None, temperature: float = TEMPERATURE) -> tuple[DataFrame, float | None]:
    """The scores, written, and the least key that is drawn; None if nothing is."""
    scored = materialize(score(docs, ratio, threshold, temperature), "resampling-scores")
    k = scored.where("log_weight >= 0").count() if share is None else math.ceil(share * scored.count())
    return scored, kth_largest(scored, "gumbel_key", k) if k else None


def keep_resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns. Rows with a null id are kept: nothing identifies them.

    Rows that share an id stay if one of them is drawn. Texts are weighed a second time, where they lie, and not shuffled: only
    ids are, and the rows of an id of which some are drawn and some are not.
    """
    ratio, threshold = fit(docs, labels)
    scored, cut = _scored(docs, ratio, threshold)
    if cut is None:
        return docs.where("doc_id is null")
    is_drawn = F.col("gumbel_key") >= cut
    parted = scored.where("doc_id is not null").groupBy("doc_id").agg(F.min(is_drawn).alias("all"), F.max(is_drawn).alias("some")).where("some and not all").select("doc_id")
    parted = materialize(parted, "resampling-parted")
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            key = _weigh(ids, texts, shared.value, threshold, TEMPERATURE)[2]
            yield batch.filter(pc.or_(pa.array(key >= cut), ids.is_null()))

    kept = docs.mapInArrow(run, docs.schema)
    if parted.isEmpty():
        return kept
    return kept.join(parted, "doc_id", "left_anti").unionByName(docs.join(parted, "doc_id", "left_semi")).select(*docs.columns)
