"""Media columns: signature sniffing with carving.

An Aho-Corasick automaton finds every magic of the known formats in one pass; a validator per format then
confirms structure and gives the true length. What starts at byte 0 is the column's type (whatever was
declared), what is confirmed further in is carved out as embedded media.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.runtime import with_fields

WIDTH = 64
RATE = 8000
PIECE = 1 << 16


def wav_of(payload: bytes) -> bytes:
    """Lossless: each byte is one unsigned 8-bit mono sample."""
    pad = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def samples_at(media: bytes) -> tuple[int, int] | None:
    """(start, size) of the data chunk of a RIFF/WAVE file, wherever it stands."""
    return next(((start, size) for name, start, size in _riff_chunks(media, 0, len(media)) if name == b"data"), None)


def _riff_chunks(b: bytes, at: int, end: int):
    pos = at + 12
    while pos + 8 <= end:
        size = int.from_bytes(b[pos + 4 : pos + 8], "little")
        if pos + 8 + size > end:
            return
        yield b[pos : pos + 4], pos + 8, size
        pos += 8 + size + size % 2


def _riff(b: bytes, at: int) -> int:
    size = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    if b[at + 8 : at + 12] not in (b"WAVE", b"WEBP") or size < 20 or at + size > len(b):
        return 0
    names = [name for name, _, _ in _riff_chunks(b, at, at + size)]
    need = {b"fmt ", b"data"} if b[at + 8 : at + 12] == b"WAVE" else set()
    return size if names and need <= set(names) else 0


def _png(b: bytes, at: int) -> int:
    pos = at + 8
    while pos + 12 <= len(b):
        size, name = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        if pos + 12 + size > len(b) or pos == at + 8 and name != b"IHDR":
            return 0
        if zlib.crc32(b[pos + 4 : pos + 8 + size]) != int.from_bytes(b[pos + 8 + size : pos + 12 + size], "big"):
            return 0
        pos += 12 + size
        if name == b"IEND":
            return pos - at
    return 0


def _gif(b: bytes, at: int) -> int:
    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    if len(b) < at + 14:
        return 0
    pos = at + 13 + (3 * (2 << (b[at + 10] & 7)) if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21 and pos + 2 < len(b):
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos = blocks(pos + 11 + (3 * (2 << (b[pos + 9] & 7)) if b[pos + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if size < 2:
            return 0
        pos += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that is neither stuffing nor a restart
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return 0
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return pos + 2 - at if b[pos : pos + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = reserved == 0 and header in (12, 40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 26 <= start <= size
    return size if good and at + size <= len(b) else 0


class Marks:
    """Where patterns stand in a medium, each looked for once however many magics ask."""

    def __init__(self, b: bytes):
        self.b, self.known = b, {}

    def of(self, pattern: bytes) -> list[int]:
        if pattern not in self.known:
            at, found = self.b.find(pattern), []
            while at >= 0:
                found.append(at)
                at = self.b.find(pattern, at + 1)
            self.known[pattern] = found
        return self.known[pattern]

    def next(self, pattern: bytes, at: int) -> int:
        """The first place from ``at`` on, or -1."""
        found = self.of(pattern)
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def last(self, pattern: bytes, before: int) -> int:
        """The last place before ``before``, or -1."""
        k = bisect_left(self.of(pattern), before)
        return self.of(pattern)[k - 1] if k else -1


def _pdf(b: bytes, at: int, marks: Marks) -> int:
    """Up to the last end mark before the next header: a file that was saved again has several. An end mark follows the place of the cross-references."""
    head = marks.next(b"%PDF-", at + 5)
    end = marks.last(b"%%EOF", head if head >= 0 else len(b))
    if end < at + 8:  # a header inside the file's own data
        end = marks.last(b"%%EOF", len(b))
    good = b[at + 5 : at + 6].isdigit() and end >= at + 8 and at < marks.last(b"startxref", end)
    return end + 5 - at if good else 0


def _gzip(b: bytes, at: int) -> int:
    """What it unpacks to is read in pieces and let go."""
    try:
        d, pos = zlib.decompressobj(31), at
        while not d.eof and (pos < len(b) or d.unconsumed_tail):
            piece = d.unconsumed_tail or b[pos : pos + PIECE]
            pos += 0 if d.unconsumed_tail else len(piece)
            d.decompress(piece, PIECE)
        return pos - at - len(d.unused_data) if d.eof else 0
    except zlib.error:
        return 0


def _zip(b: bytes, at: int, marks: Marks) -> int:
    end = marks.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if start + size <= end - at and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b) else 0


def _ogg(b: bytes, at: int) -> int:
    pos = at
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b):
        n = b[pos + 26]
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos > len(b):
            return 0
    return pos - at


def _mp4(b: bytes, at: int) -> int:
    """``at`` is where ``ftyp`` stands; the box starts 4 bytes before. Gives the length from the box's start."""
    pos = start = at - 4
    seen = set()
    while 0 <= pos and pos + 8 <= len(b):
        size, name = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        if size < 8 or pos + size > len(b) or not name.isalnum():
            break
        seen.add(name)
        pos += size
    return pos - start if {b"ftyp", b"moov"} <= seen else 0


#: Magic bytes of public formats, with type, offset of the magic, validator.
FORMATS: list[tuple[bytes, str, int, Callable[..., int]]] = [
    (b"RIFF", "audio/wav", 0, _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", 0, _png),
    (b"GIF87a", "image/gif", 0, _gif),
    (b"GIF89a", "image/gif", 0, _gif),
    (b"\xff\xd8\xff", "image/jpeg", 0, _jpeg),
    (b"BM", "image/bmp", 0, _bmp),
    (b"%PDF-", "application/pdf", 0, _pdf),
    (b"\x1f\x8b\x08", "application/gzip", 0, _gzip),
    (b"PK\x03\x04", "application/zip", 0, _zip),
    (b"OggS", "audio/ogg", 0, _ogg),
    (b"ftyp", "video/mp4", 4, _mp4),
]


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(FORMATS):
        auto.add_word(magic.decode("latin-1"), (k, len(magic)))
    auto.make_automaton()
    return auto


def sniff(media: bytes, automaton: ahocorasick.Automaton | None = None) -> list[tuple[str, int, int]]:
    """(type, start, length) of each confirmed format, in order of start; none inside an earlier one but one at byte 0, and there no
    page of an Ogg stream, which are the stream's own."""
    found: list[tuple[str, int, int]] = []
    over, marks = 0, Marks(media)
    for last, (k, size) in (automaton or _automaton()).iter(media.decode("latin-1")):
        _, kind, back, valid = FORMATS[k]
        at = last + 1 - size
        start = at - back
        if start < 0 or found and start < over and start != 0:
            continue
        if kind == "audio/ogg" and found and found[0][:2] == (kind, 0) and start < found[0][2]:
            continue
        if length := valid(media, at, marks) if valid in (_pdf, _zip) else valid(media, at):
            if kind == "audio/wav" and media[at + 8 : at + 12] == b"WEBP":
                kind = "image/webp"
            found.append((kind, start, length))
            over = start + length if start else 0
    return found


def sniff_media(df: DataFrame, media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """Add detected_type, corrected, media_length, payload (start, size: the samples of a WAV) and embedded (type, start, length).

    A null or empty value, and one that no validator confirms at byte 0, has a null detected type and is not
    corrected. Extra columns pass through, but for those of the names added, which are replaced.
    """
    added = "detected_type string, corrected boolean, media_length long, payload struct<start:bigint,size:bigint>, embedded array<struct<type:string,start:bigint,length:bigint>>"
    new = ["detected_type", "corrected", "media_length", "payload", "embedded"]
    df = df.drop(*new)
    names = df.columns
    m, d = names.index(media_col), names.index(declared_col)
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    part = pa.struct([("start", pa.int64()), ("size", pa.int64())])

    def run(batches):
        auto = _automaton()
        for batch in batches:
            raw = [x.as_py() for x in batch.column(m)]
            got = [sniff(x, auto) if x else [] for x in raw]
            top = [next((f for f in fs if f[1] == 0), None) for fs in got]
            rest = [[{"type": t, "start": s, "length": n} for t, s, n in fs if s] for fs in got]
            place = [samples_at(x) if t and t[0] == "audio/wav" else None for t, x in zip(top, raw, strict=True)]
            declared = batch.column(d).to_pylist()
            columns = [*batch.columns, pa.array([t and t[0] for t in top], pa.string()), pa.array([bool(t and t[0] != x) for t, x in zip(top, declared, strict=True)], pa.bool_()), pa.array([t and t[2] for t in top], pa.int64())]
            columns += [pa.array([p and {"start": p[0], "size": p[1]} for p in place], part), pa.array(rest, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return df.mapInArrow(run, with_fields(df.schema, added))


def carve_media(sniffed: DataFrame, media_col: str = "media") -> DataFrame:
    """One row for each medium embedded in another: the row's other columns, ``carved`` (type, start, length) and its bytes as ``media_col``.

    Media without any give no row.
    """
    own = [c for c in sniffed.columns if c not in (media_col, "carved", "embedded", "detected_type", "corrected", "media_length", "payload")]
    each = sniffed.select(*own, media_col, F.explode("embedded").alias("carved"))
    return each.withColumn(media_col, F.substring(media_col, F.col("carved.start").cast("int") + 1, F.col("carved.length").cast("int")))


def text_to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``media`` (a WAV of the padded UTF-8 bytes; null is an empty text), ``n_bytes`` and a declared type that knows nothing.

    Columns of these names are replaced.
    """
    docs = docs.drop("n_bytes", "media", "declared_type")
    names = docs.columns
    t = names.index(text_col)

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for x in batch.column(t):
                raw = (x.as_py() or "").encode()
                sizes.append(len(raw))
                media.append(wav_of(raw + b"\0" * (-len(raw) % WIDTH or (WIDTH if not raw else 0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(["application/octet-stream"] * len(media))], names=[*names, "n_bytes", "media", "declared_type"])

    return docs.mapInArrow(run, with_fields(docs.schema, "n_bytes long, media binary, declared_type string"))


def media_features(sniffed: DataFrame) -> DataFrame:
    """Digest columns of stored media: what the data chunk holds, hashed, and a feature line.

    Media that are no WAV have null payload columns; their own digests stay. An empty table stays empty.
    """
    pcm = F.when(F.col("payload").isNotNull(), F.substring("media", F.col("payload.start").cast("int") + 1, F.col("payload.size").cast("int")))
    return (
        sniffed.withColumn("payload", pcm)
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("payload_sha256", F.sha2("payload", 256))
        .withColumn("tail_crc32", F.crc32(F.expr(f"substring(payload, payload_bytes - {WIDTH - 1}, {WIDTH})")))
        .withColumn("media_bytes", F.octet_length("media").cast("long"))
        .withColumn("media_sha256", F.sha2("media", 256))
        .withColumn("feature", F.concat_ws(";", "detected_type", F.concat(F.lit("ms="), (F.col("payload_bytes") * 1000 / RATE).cast("long")), F.concat(F.lit("crc32="), F.crc32("payload")), F.concat(F.lit("embedded="), F.concat_ws(",", F.transform("embedded", lambda e: F.concat_ws(":", e["type"], e["start"], e["length"]))))))
        .drop("payload")
    )
