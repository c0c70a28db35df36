"""Variable-capacity best-fit packing.

The plan needs lengths alone, and lengths are bounded by the largest permitted sequence: the driver sees one
count per distinct length (at most ``max(capacities)`` numbers whatever the corpus), packs whole
multiplicities of lengths by best fit, and describes the result as runs: "documents r0..r1 of length n go to
bins b0.., so many in each". Executors then number the documents within their length and look their bin up.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.runtime import number_rows

CAPACITIES = (2048, 4096, 8192, 16384)
#: Cost of a bin besides its positions, in positions: what a sequence costs whatever its length.
BIN_COST = 64


@dataclass
class Group:
    """``count`` bins of one capacity with the same contents: (length, how many of it in each bin, first rank)."""

    capacity: int
    count: int
    items: list[tuple[int, int, int]] = field(default_factory=list)


#: Different lengths that an opening bin is reckoned to be filled with.
KINDS = 12


def fill_of(capacity: int, length: int, left: int, waiting: list[int], free: dict[int, int]) -> list[tuple[int, int]]:
    """(length, how many of it) that best fit would put into a bin: this length first, then the largest that still fit."""
    fill = [(length, min(capacity // length, left))]
    room = capacity - length * fill[0][1]
    k = len(waiting)
    while room > 0 and len(fill) < KINDS and (k := bisect.bisect_right(waiting, room, 0, k)):
        n = waiting[k - 1]
        k -= 1
        if m := min(room // n, free[n]):
            fill.append((n, m))
            room -= m * n
    return fill


def plan_bins(counts: dict[int, int], capacities: tuple[int, ...], bin_cost: int = BIN_COST) -> list[Group]:
    """Best fit over decreasing lengths; ranks of a length are used up in order, so each run is contiguous.

    A bin is opened in the capacity whose cost for each position is least, all permitted ones being filled on paper with
    the lengths still to be packed; at the end every bin is downsized to its contents.
    """
    sizes = sorted(capacities)
    open_bins: dict[int, list[Group]] = {}  # by room left
    rooms: list[int] = []  # its keys, sorted
    done: list[Group] = []

    def put(group: Group, room: int) -> None:
        if room == 0:
            done.append(group)
        elif room in open_bins:
            open_bins[room].append(group)
        else:
            open_bins[room] = [group]
            bisect.insort(rooms, room)

    waiting = sorted(n for n in counts if n > 0)
    free = {n: counts[n] for n in waiting}
    for length in waiting[::-1]:
        left, rank = counts[length], 0
        waiting = waiting[:-1]
        while left and (k := bisect.bisect_left(rooms, length)) < len(rooms):
            room = rooms[k]  # the tightest fit
            group = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[k]
            each = min(room // length, left)
            bins = min(group.count, left // each)
            if bins < group.count:
                # The items of a run go to its bins in order, so the other part continues each run further on.
                rest = [(n, m, first + m * bins) for n, m, first in group.items]
                put(Group(group.capacity, group.count - bins, rest), room)
            put(Group(group.capacity, bins, [*group.items, (length, each, rank)]), room - each * length)
            rank, left = rank + each * bins, left - each * bins
        while left:
            # The capacity that costs least for each position, as this length and what is still to come fill it.
            fills = [(fill_of(c, length, left, waiting, free), c) for c in sizes if c >= length]
            fill, capacity = min(fills, key=lambda f: ((f[1] + bin_cost) / sum(n * m for n, m in f[0]), -f[1]))
            each = fill[0][1]
            bins = max(1, min([left // each, *(free[n] // m for n, m in fill[1:])]))
            for n, m in fill[1:]:
                free[n] -= m * bins  # spoken for: the next bin opened reckons without it
            put(Group(capacity, bins, [(length, each, rank)]), capacity - each * length)
            rank, left = rank + each * bins, left - each * bins
    for groups in open_bins.values():
        done += groups
    for group in done:  # downsizing
        used = sum(n * m for n, m, _ in group.items)
        group.capacity = next(c for c in sizes if c >= used)
    return done


def pack_best_fit(docs: DataFrame, length_col: str = "length", id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """(doc_id, piece, n_pieces, length, bin_id, capacity, offset): the place of every piece of every document.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest. A row of null or
    non-positive length needs no place and is returned with a null bin. Repeated rows are packed each, in some order; a
    null id is like any other. An empty table gives no rows; other columns are ignored.
    """
    top = max(capacities)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    n_pieces = F.ceil(F.col("total") / top).cast("int")
    pieces = rows.where("total > 0").withColumn("n_pieces", n_pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("length", F.least(F.lit(top).cast("long"), F.col("total") - F.col("piece") * top)).drop("total")
    ranked = number_rows(pieces, ["length", "doc_id", "piece"], "place", "packing")
    # One row a distinct length, at most max(capacities) of them.
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = plan_bins(counts, capacities)
    before = {n: sum_ for n, sum_ in zip(sorted(counts), np.cumsum([0, *(counts[n] for n in sorted(counts))]), strict=False)}
    runs, base = [], 0
    for g in groups:
        offset = 0
        for n, m, first in g.items:
            runs.append((before[n] + first, m, base, g.capacity, offset))
            offset += n * m
        base += g.count
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)

    def place(batches):
        starts, each, base, capacity, offset = table.T
        for b in batches:
            at, length = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("place", "length"))
            k = np.searchsorted(starts, at, "right") - 1
            nth = at - starts[k]
            got = {"bin_id": base[k] + nth // each[k], "capacity": capacity[k], "offset": offset[k] + nth % each[k] * length}
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "n_pieces", "length")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(v, pa.int64()) for v in got.values())], names=["doc_id", "piece", "n_pieces", "length", *got])

    id_type = docs.schema[id_col].dataType.simpleString()
    placed = ranked.select("doc_id", "piece", "n_pieces", "length", "place").mapInArrow(place, f"doc_id {id_type}, piece int, n_pieces int, length long, bin_id long, capacity long, offset long")
    return placed.unionByName(rows.where("total = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_pieces"), F.lit(0).cast("long").alias("length")), allowMissingColumns=True)


def pack_sequences(docs: DataFrame, ids_col: str, width: int, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """(bin_id, capacity, used, ids, parts): the training sequences themselves.

    ``ids_col`` holds a document's token ids, ``width`` bytes each (null or empty: the document has no place). ``ids`` is a
    sequence's ids, end to end; ``parts`` says in order of offset which piece of which document stands where. Rows that
    share an id are packed each with its own ids; a null id is like any other. A sequence is at most the largest capacity
    long, whatever the corpus. An empty table gives no rows; other columns are ignored.
    """
    top = max(capacities)
    # A row is known by its id and a hash of its ids; of equal rows, where there are any, one gives its ids to all their places.
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(ids_col).alias("h")).alias("row"), F.col(ids_col).alias("_ids"))
    places = pack_best_fit(rows.select("row", F.floor(F.octet_length("_ids") / width).alias("length")), id_col="row", capacities=capacities).where("bin_id is not null").withColumnRenamed("doc_id", "row")
    part = F.struct("offset", F.col("row.doc_id").alias("doc_id"), "piece", "length", F.substring("_ids", (F.col("piece") * top * width).cast("int") + 1, (F.col("length") * width).cast("int")).alias("ids"))
    repeated = places.where("piece = 0").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    one = rows if repeated.isEmpty() else rows.withColumn("_k", F.row_number().over(Window.partitionBy("row").orderBy("row"))).where("_k = 1").drop("_k")
    bins = places.join(one, "row").select("bin_id", "capacity", part.alias("part")).groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    used = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return bins.select("bin_id", "capacity", used.alias("used"), whole.alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("parts"))


def unpack(sequences: DataFrame, width: int) -> DataFrame:
    """(doc_id, piece, bin_id, capacity, offset, length, ids): each piece as it stands in its sequence."""
    each = sequences.select("bin_id", "capacity", "ids", F.explode("parts").alias("p"))
    return each.select("p.doc_id", "p.piece", "bin_id", "capacity", "p.offset", "p.length", F.substring("ids", (F.col("p.offset") * width).cast("int") + 1, (F.col("p.length") * width).cast("int")).alias("ids"))
