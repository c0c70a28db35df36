"""Token ids in a binary store: bit-plane or byte-plane shuffled blocks, zstandard, chunk index.

A store is a folder with two Parquet tables. ``chunks`` holds one row per chunk: whole documents in
ascending id order, their ids cut into fixed-size blocks, each block transposed into planes (all bits, or all
bytes, of one significance together) and each plane compressed on its own. ``index`` holds one small row
per chunk with its place in the whole id stream, so that a reader finds any range without opening payloads.
"""

from __future__ import annotations

import array
from collections.abc import Iterator
from itertools import pairwise, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm.runtime import shard_offsets

CHUNKS = "shard int, chunk int, shard_offset long, n_ids long, block int, mode string, doc_ids array<long>, doc_lens array<long>, plane_bytes array<int>, payload binary"
CHUNK_ROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("shard_offset", pa.int64()), ("n_ids", pa.int64()), ("block", pa.int32()), ("mode", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("plane_bytes", pa.list_(pa.int32())), ("payload", pa.binary())])
#: Units kept per worker; beyond it the cache starts anew.
CACHE_PIECES = 800_000
CHUNK_IDS = 1 << 20
BLOCK_IDS = 1 << 16
#: Texts encoded at once; a longer text goes alone.
SLICE_BYTES, SLICE_TEXTS = 8 << 20, 1 << 16
#: Bytes that begin visible characters alone; those of others begin white space too.
_VISIBLE = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])
#: Kinds of bytes: 1 letters, 2 digits, 3 signs, 4 the apostrophe, 5 line ends and tabs, 0 all others.
_KIND = np.array([1 if bytes([b]).isalpha() else 2 if bytes([b]).isdigit() else 4 if b == 0x27 else 3 if 0x21 <= b < 0x7F else 5 if 0x09 <= b < 0x0E else 0 for b in range(256)], np.uint8)
#: By two kinds (first * 8 + second): a pre-token begins between them whatever else the text holds. Signs run on with the apostrophe, and a letter may belong to it.
_CHANGE = np.zeros(64, bool)
_CHANGE[[8 * a + b for a, b in product(range(1, 5), range(1, 6)) if a != b and (a, b) not in ((3, 4), (4, 3), (4, 1))]] = True


def _byte_letters() -> dict[int, str]:
    """Byte to letter of byte-level vocabularies: visible Latin-1 stands for itself, the rest follow from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder(dict):
    """Text to little-endian uint32 ids.

    A space before visible text always starts a new pre-token, and so do changes between kinds of ASCII characters,
    so texts are cut into units there, and units repeat: of a slice of texts each is looked up once. Where a unit is
    several pre-tokens still, its ids are those of all, and a pre-token is encoded by the library's model once per
    worker. A unit with rare white space, and a text with an added token, are encoded by the library as they are. An
    added token in a text has its own id, unless ``special`` is False.
    """

    def __init__(self, tokenizer_file: str, special: bool = True):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(tokenizer_file)
        self.whole.encode_special_tokens = not special
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # White space of any definition other than the six that all share.
        self.rare = regex.compile(r"[^\S \t\n\r\x0b\x0c]|[\x1c-\x1f\x85\u180e\u200b\ufeff]").search
        self.model = self.whole.model
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = {b: c for b, c in _byte_letters().items()}

    def __missing__(self, unit: bytes) -> bytes:
        word, text = unit.removeprefix(b" "), unit.decode()
        if not word.isalpha() and self.rare(text):
            out = _little(self.whole.encode(text, add_special_tokens=False).ids)
        elif not word.isalpha() and len(pieces := self.pieces(text)) > 1:
            out = b"".join([self[piece.encode()] for piece in pieces])
        else:
            out = _little([t.id for t in self.model.tokenize(unit.decode("latin-1").translate(self.letters))])
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(unit) <= 64:
            self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text in order (null: empty), some ``SLICE_BYTES`` of text at a time."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        alone = np.zeros(len(texts), bool)
        for content in self.added:
            alone |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy()
        lo = 0
        while lo < len(texts):
            if alone[lo]:
                yield _little(self.whole.encode(texts[lo].as_py(), add_special_tokens=False).ids)
                lo += 1
                continue
            fits = np.cumsum(size[lo : lo + SLICE_TEXTS]) <= SLICE_BYTES
            hi = lo + max(1, int(np.argmin(np.r_[fits & ~alone[lo : lo + SLICE_TEXTS], False])))
            yield from self._encode_slice(texts[lo:hi])
            lo = hi

    def _encode_slice(self, texts: pa.Array) -> Iterator[bytes]:
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if not len(raw):
            yield from [b""] * len(texts)
            return
        first = np.zeros(len(raw) + 1, bool)
        first[:-2] = (raw[:-1] == 0x20) & _VISIBLE[raw[1:]]
        first[at[at > 0] - 1] = False  # what follows the last byte of a text is not its own
        kind = _KIND[raw]
        first[1:-1] |= _CHANGE[kind[:-1] << 3 | kind[1:]]
        # After a line end or tab by itself; how a longer run of white space falls apart depends on what follows it.
        first[2:-1] |= (kind[:-2] % 5 > 0) & (kind[1:-1] == 5) & (kind[2:] % 5 > 0)
        first[at] = True
        edge = np.flatnonzero(first)
        units = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(raw)]).dictionary_encode()
        _, offsets, data = units.dictionary.buffers()
        blob, ends = data.to_pybytes(), np.frombuffer(offsets, np.int64)[: len(units.dictionary) + 1].tolist()
        ids = pa.array(list(map(self.__getitem__, [blob[a:b] for a, b in pairwise(ends)])), pa.large_binary()).take(units.indices)
        _, offsets, data = ids.buffers()
        blob, ends = data.to_pybytes() if data else b"", np.frombuffer(offsets, np.int64)[np.searchsorted(edge, at)].tolist()
        for a, b in pairwise(ends):
            yield blob[a:b]


def _little(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(tokenizer_file: str, special: bool = True) -> Encoder:
    if (tokenizer_file, special) not in _encoders:
        _encoders[tokenizer_file, special] = Encoder(tokenizer_file, special)
    return _encoders[tokenizer_file, special]


def shuffle_planes(ids: np.ndarray, mode: str, block: int = BLOCK_IDS) -> tuple[bytes, list[int]]:
    """Payload and the compressed size of each plane, block after block; the last block may be short."""
    press = zstandard.ZstdCompressor(level=1).compress
    out: list[bytes] = []
    for at in range(0, len(ids), block):
        raw = np.ascontiguousarray(ids[at : at + block], "<u4").view(np.uint8).reshape(-1, 4)
        planes = raw.T if mode == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
        out += [press(p.tobytes()) if p.any() else b"" for p in planes]  # an all-zero plane takes no bytes
    return b"".join(out), [len(x) for x in out]


def unshuffle_planes(payload: bytes, sizes: list[int], n_ids: int, mode: str, block: int = BLOCK_IDS) -> np.ndarray:
    unpress, out = zstandard.ZstdDecompressor().decompress, np.empty(n_ids, "<u4")
    per, at = (4 if mode == "byte" else 32), 0
    for k, first in enumerate(range(0, n_ids, block)):
        n = min(block, n_ids - first)
        width = n if mode == "byte" else -(-n // 8)
        planes = np.zeros((per, width), np.uint8)
        for p, size in enumerate(sizes[k * per : (k + 1) * per]):
            if size:
                planes[p] = np.frombuffer(unpress(payload[at : at + size], max_output_size=width), np.uint8)
            at += size
        raw = planes.T if mode == "byte" else np.packbits(np.unpackbits(planes, axis=1, count=n).T, axis=1, bitorder="little")
        out[first : first + n] = np.ascontiguousarray(raw).reshape(-1).view("<u4")
    return out


def write_token_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, mode: str = "byte", id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the store in ascending id order.

    Rows of one id are ordered by text; null ids come first. An empty table gives an empty store. An
    added token in a text has its own id, as the library gives it; with ``special`` False it is text like any other.
    Other columns are ignored.
    """

    def encode(batches):
        enc, shard = encoder(tokenizer_file, special), _partition()
        end = np.array([end_id], "<u4").tobytes()
        ids, lens, blobs, held, chunk, offset = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, lens, blobs, held, chunk, offset
            payload, sizes = shuffle_planes(np.frombuffer(b"".join(blobs), "<u4"), mode)
            row = {"shard": shard, "chunk": chunk, "shard_offset": offset, "n_ids": held, "block": BLOCK_IDS, "mode": mode, "doc_ids": ids, "doc_lens": lens, "plane_bytes": sizes, "payload": payload}
            chunk, offset = chunk + 1, offset + held
            ids, lens, blobs, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=CHUNK_ROW)

        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                blob += end
                ids.append(i)
                lens.append(len(blob) // 4)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= CHUNK_IDS:
                    yield flush()
        if ids:
            yield flush()

    spark = docs.sparkSession
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(encode, CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select(F.col("shard").alias("_shard"), "chunk", "shard_offset", "n_ids")
    totals = chunks.groupBy("_shard").agg(F.sum("n_ids").alias("n"))
    # One row per partition is broadcast.
    index = chunks.join(F.broadcast(shard_offsets(totals, "n", "base")), "_shard")
    index.select(F.col("_shard").alias("shard"), "chunk", (F.col("base") + F.col("shard_offset")).alias("start"), "n_ids", "base").write.parquet(f"{path}/index")


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian uint32, decoded from the stored planes; null and repeated ids as they were written.

    A store of an empty table gives no rows.
    """

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unshuffle_planes(row["payload"], row["plane_bytes"], row["n_ids"], row["mode"], row["block"])
                ends = np.cumsum(row["doc_lens"])
                raw = ids.tobytes()
                starts = ends - row["doc_lens"]
                for lo in range(0, len(ends), 500):
                    part = slice(lo, lo + 500)
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([row["shard"]] * len(ends[part]), pa.int32()), "doc_id": pa.array(row["doc_ids"][part], pa.int64()),
                        "at": pa.array(starts[part] + row["shard_offset"], pa.int64()), "n_tokens": pa.array(row["doc_lens"][part], pa.int64()),
                        "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(starts[part], ends[part], strict=True)], pa.binary()),
                    })

    rows = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(decode, "shard int, doc_id long, at long, n_tokens long, ids binary")
    bases = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.max("base").alias("base"))
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_id_range(spark: SparkSession, path: str, start: int, count: int) -> list[int]:
    """Ids [start, start + count) of the whole stream, opening only the chunks that hold them."""
    index = spark.read.parquet(f"{path}/index").where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start))
    out: list[int] = []
    for at in index.orderBy("start").toLocalIterator():
        row = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").where((F.col("shard") == at["shard"]) & (F.col("chunk") == at["chunk"])).first()
        ids = unshuffle_planes(bytes(row["payload"]), row["plane_bytes"], row["n_ids"], row["mode"], row["block"])
        out += ids[max(0, start - at["start"]) : start + count - at["start"]].tolist()
    return out


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
