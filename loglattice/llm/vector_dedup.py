"""Near-duplicate vectors by p-stable hashing for Euclidean distance, with exact cosine checks.

Normalised vectors at cosine c lie sqrt(2 - 2c) apart. Each table hashes a vector to several quantised random
projections; vectors that agree in all of them in some table, and in label, are compared in double precision. The
number of projections follows the logarithm of the largest label, so that unrelated vectors seldom meet however many
there are, and the number of tables follows from the share of pairs at the threshold that may be missed.

Equal vectors of a label are one class and hashed once. Buckets are counted by class alone; vectors travel only to
buckets where several classes meet. A bucket is worked off in blocks: however many members it has, a task holds two
blocks, and what leaves it is a sum per member and a spanning forest, not its pairs. A pair that meets in several
tables counts in the first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loglattice.llm.graph import connected_components
from loglattice.llm.runtime import materialize

WIDTH = 3.0
#: Unrelated (orthogonal) vectors that share a bucket with one vector, in the mean.
STRANGERS = 0.1
#: Share of the pairs at the threshold that no table finds.
MISSED = 1e-3
LEAST_HASHES = 8
#: Buckets up to this size are worked off side by side, larger ones in blocks of so many.
SMALL, BLOCK = 16, 1024


def agreement(distance: float) -> float:
    """The chance that one quantised projection of WIDTH is equal for two vectors so far apart."""
    c = WIDTH / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def shape_for(n: int, low: float) -> tuple[int, int]:
    """(tables, projections a table) for n classes in the largest label and a least cosine of ``low``."""
    hashes = max(LEAST_HASHES, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(agreement(math.sqrt(2)))))
    meet = agreement(math.sqrt(max(2 - 2 * low, 1e-9))) ** hashes
    return math.ceil(math.log(MISSED) / math.log1p(-min(meet, 0.999))), hashes


def codes_of(unit: np.ndarray, seed: int, tables: int, hashes: int) -> np.ndarray:
    """One 32-bit bucket code for each row and table; a bucket is defined by its code."""
    r = np.random.default_rng([seed, unit.shape[1]])
    a, b = r.standard_normal((unit.shape[1], tables * hashes)), r.uniform(0, WIDTH, tables * hashes)
    q = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), tables, hashes)
    r = np.random.default_rng([seed, 1]).integers(1, 1 << 62, hashes, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return ((q * r).sum(axis=2) >> 13).astype(np.int32)


def units(packed: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length, normalised, in double precision."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors, labels):
    """Rows that can link, as float64 arrays by position."""
    out = {}
    for k, (v, label) in enumerate(zip(vectors, labels, strict=True)):
        if v is None or label is None or not len(v) or None in v:
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0:
            out[k] = x
    return out


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, kind: str) -> DataFrame:
    """(vec_id, label, sig, dim, vector): sig is null for what links with nothing, else equal for equal vectors of one label."""

    def run(batches):
        for b in batches:
            label, vec = b.column(1).to_pylist(), b.column(2).to_pylist()
            use = _usable(vec, label)
            sig = [xxhash.xxh3_128_digest(repr(label[k]).encode() + b"\0" + (use[k] + 0.0).tobytes()) if k in use else None for k in range(len(vec))]
            packed = [use[k].astype(kind).tobytes() if k in use else None for k in range(len(vec))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.binary()), pa.array([len(use[k]) if k in use else None for k in range(len(vec))], pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "label", "sig", "dim", "vector"])

    rows = vectors.select(F.col(id_col).cast("long"), F.col(label_col), F.col(vector_col))
    return rows.mapInArrow(run, f"vec_id long, label {vectors.schema[label_col].dataType.simpleString()}, sig binary, dim int, vector binary")


def _hash(seed: int, tables: int, hashes: int, kind: str):
    """(cls, dim, vector) to (cls, codes)."""

    def run(batches):
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            for k, dim in enumerate(batch.column(1).to_pylist()):
                by_dim.setdefault(dim, []).append(k)
            for at in by_dim.values():
                codes = codes_of(units(batch.column(2).take(pa.array(at)).to_pylist(), kind), seed, tables, hashes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], names=["cls", "codes"])

    return run


def _links(low: float, kind: str):
    """Blocks of buckets, sorted, to (a, n): vectors linked with class a; and (a, b): edges of a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def work(t, x, y, block, rep, m, unit, codes):
        p, q = np.flatnonzero(block == x), np.flatnonzero(block == y)
        if not len(p) or not len(q):
            return None
        cosine = unit[p] @ unit[q].T
        i, j = np.nonzero((cosine >= low) & (rep[p][:, None] < rep[q][None, :] if x == y else rep[p][:, None] != rep[q][None, :]))
        i, j = p[i], q[j]
        for k in range(t):  # what met in an earlier table has been counted there
            fresh = codes[i, k] != codes[j, k]
            i, j = i[fresh], j[fresh]
        if not len(i):
            return None
        links = np.bincount(i, m[j], len(rep)) + np.bincount(j, m[i], len(rep))
        label = np.arange(len(rep))
        while True:
            least = label.copy()
            np.minimum.at(least, i, label[j])
            np.minimum.at(least, j, label[i])
            least = least[least]
            if (least == label).all():
                break
            label = least
        own, edge = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(np.r_[rep[own], rep[edge]]), pa.array(np.r_[rep[own], rep[label[edge]]]), pa.array(np.r_[links[own].astype(np.int64), np.zeros(len(edge), np.int64)])], schema=schema)

    def small(t, group, cls, m, unit, codes):
        """All pairs within small buckets, side by side."""
        for step in range(1, SMALL):
            i = np.flatnonzero(group[step:] == group[:-step])
            if not len(i):
                return
            j = i + step
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= low
            i, j = i[near], j[near]
            first = (codes[i] == codes[j]).argmax(axis=1) == t[i]  # what met in an earlier table has been counted there
            i, j = i[first], j[first]
            if len(i):
                a, b = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[cls[i], cls[j], b]), pa.array(np.r_[cls[i], cls[j], a]), pa.array(np.r_[m[j], m[i], np.zeros(len(i), np.int64)])], schema=schema)

    def run(batches):
        held, key = [], None

        def flush():
            block, cls, m, codes = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2, 4))
            return work(key[1], key[4], key[5], block, cls, m, units([v for h in held for v in h[3]], kind), codes)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in range(6)]
            changed = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                changed |= ~np.asarray(pa.compute.equal(c.slice(1), c.slice(0, batch.num_rows - 1)))
            starts = np.r_[0, np.flatnonzero(changed) + 1, batch.num_rows]
            size = np.diff(starts)
            few = (size <= SMALL) & (columns[5].to_numpy()[starts[:-1]] == 0)
            few[[0, -1]] = False  # may go on in another batch
            rows = np.flatnonzero(np.repeat(few, size))
            codes = batch.column(10).flatten().to_numpy().reshape(batch.num_rows, -1)
            cls, m, dim = batch.column(7).to_numpy(), batch.column(8).to_numpy(), batch.column(3).to_numpy()
            group = np.repeat(np.arange(len(size)), size)
            for d in np.unique(dim[rows]):
                at = rows[dim[rows] == d]
                yield from small(columns[1].to_numpy()[at], group[at], cls[at], m[at], units(batch.column(9).take(pa.array(at)).to_pylist(), kind), codes[at])
            for k in np.flatnonzero(~few):
                a, b = int(starts[k]), int(starts[k + 1])
                own = tuple(c[a].as_py() for c in columns)
                if key is not None and own != key:
                    if (out := flush()) is not None:
                        yield out
                    held = []
                key = own
                held.append((batch.column(6).to_numpy()[a:b], cls[a:b], m[a:b], batch.column(9).slice(a, b - a).to_pylist(), codes[a:b]))
        if held and (out := flush()) is not None:
            yield out

    return run


def vector_components(vectors: DataFrame, low: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Null, empty, zero, or non-finite vectors and null labels link with nothing. Vectors of different lengths
    never link. Equal vectors of a label are linked with each other. Rows that share an id are vectors of their own: each
    has its own label and links. A null id takes part, but is never a component's name; alone it has a null
    component and is kept. An empty table gives no rows; other columns are ignored.
    """
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    base = materialize(classes(vectors, id_col, vector_col, label_col, kind), "vectors")
    reps = base.where("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), *(F.any_value(c).alias(c) for c in ("label", "dim", "vector")))
    # Numbered once and written: a class's number is its key from here on.
    reps = materialize(reps.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    most = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    tables, hashes = shape_for(most, low)
    hashed = materialize(reps.select("cls", "dim", "vector").mapInArrow(_hash(seed, tables, hashes, kind), "cls long, codes array<int>"), "vector-codes")
    key = ["label", "t", "code", "dim"]
    placed = reps.select("cls", "label", "dim").join(hashed, "cls").select("cls", "label", "dim", F.posexplode("codes").alias("t", "code"))
    sizes = materialize(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "vector-buckets")
    rows = placed.join(sizes, key).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    rows = rows.join(reps.select("cls", "m", "vector").join(hashed, "cls"), "cls")
    rows = rows.select(*key, "x", "y", "block", "cls", "m", "vector", "codes").repartition(*key, "x", "y").sortWithinPartitions(*key, "x", "y")
    found = materialize(rows.mapInArrow(_links(low, kind), "a long, b long, n long"), "vector-links", (hashed, sizes))
    links = found.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    linked = connected_components(found.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "cls")
    info = reps.select("cls", "sig", "rep", "m").join(links, "cls", "left").join(linked, "cls", "left")
    info = materialize(info.select("sig", "rep", F.coalesce("component", "cls").alias("component"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "vector-info", (reps, found, linked))
    names = info.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = base.join(info.join(names, "component").select("sig", "n_links", "component_id"), "sig", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
