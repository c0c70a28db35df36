"""Chat formatting with typed content parts.

A visitor walks the parts of each turn in order. Text is escaped into the template; an image, audio or document
part becomes an ordered placeholder, its reference is recorded as an attachment and its expanded token count is
added up. Control characters of the template never survive inside a text: the escape character and the
angle bracket are both replaced, so that a marker in the output is a marker of the template.

A conversation is written in pieces of whole turns, about PIECE_CHARS long, so that however long it is a task holds
a piece and one turn. Offsets of loss spans and ordinals of attachments run on from piece to piece.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OUT = "piece bigint, start bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, attachments array<struct<ordinal:int,type:string,ref:string,tokens:bigint>>, media_tokens bigint, n_turns bigint"
OPEN, MID, CLOSE = "<|turn ", "|>", "<|end|>\n"
PATCH = 14
PIECE_CHARS = 1 << 20
#: Pieces of short conversations that leave a task together, and their characters.
PIECES, BATCH_CHARS = 1000, 4 << 20
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 256


def escape(text: str) -> str:
    return text.replace("\\", "\\b").replace("<", "\\l")


def unescape(text: str) -> str:
    return text.replace("\\l", "<").replace("\\b", "\\")


def escape_role(role: str | None) -> str:
    """A role ends at the first bar, so it holds none; no role at all is told from an empty one."""
    return "\\0" if role is None else escape(role).replace("|", "\\p")


def unescape_role(role: str) -> str | None:
    return None if role == "\\0" else unescape(role.replace("\\p", "|"))


class Visitor:
    """Flattens the parts of one conversation; one method a part type, unknown types are kept as documents."""

    def __init__(self, first: int = 0):
        self.first = first
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part['type'] or 'text'}", self.visit_document)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict) -> str:
        return self.attach(part, max(1, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH)))

    def visit_audio(self, part: dict) -> str:
        return self.attach(part, max(1, math.ceil((part["seconds"] or 0) * AUDIO_TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> str:
        return self.attach(part, max(1, part["pages"] or 1) * DOCUMENT_TOKENS_PER_PAGE)

    def attach(self, part: dict, tokens: int) -> str:
        kind = part["type"]
        ordinal = self.first + len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "type": kind, "ref": part["ref"], "tokens": tokens})
        return f"<|{escape(kind)} {ordinal}|>"


def format_conversation(turns: list[dict], at: int = 0, first: int = 0) -> dict:
    """Turns in order, each {role, parts}. Loss spans are half-open code point ranges of assistant contents.

    ``at`` characters and ``first`` attachments of the conversation come before.
    """
    visitor, out, spans = Visitor(first), [], []
    for turn in turns:
        head = f"{OPEN}{escape_role(turn['role'])}{MID}"
        body = "".join(map(visitor.visit, turn["parts"] or []))
        if turn["role"] == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return {"formatted": "".join(out), "loss_spans": spans, "attachments": visitor.attachments, "media_tokens": sum(a["tokens"] for a in visitor.attachments), "n_turns": len(turns)}


def parse_formatted(formatted: str) -> list[tuple[str | None, str]]:
    """(role, text) of each turn, read from the output; placeholders stay as they stand in the text."""
    turns = []
    for piece in formatted.split(CLOSE)[:-1]:
        role, _, body = piece[len(OPEN) :].partition(MID)
        turns.append((unescape_role(role), unescape(body)))
    return turns


def text_parts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``parts``: the whole text (null: empty) as one text part."""
    return rows.withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text_col, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))))


def format_chats(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """The pieces of each conversation, in order within a partition: ``piece`` from 0, ``start`` its first character.

    Turns that tie are ordered by role, then by their parts; null keys are one conversation. A conversation's turns
    pass through one task, in a stream.
    """
    turns = rows.select(F.col(key).alias("key"), F.col(order).alias("turn"), F.col(role).alias("role"), F.col(parts).alias("parts"))
    turns = turns.repartition("key").sortWithinPartitions("key", "turn", "role", "parts").select("key", "role", "parts")
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = {"piece": pa.int64(), "start": pa.int64(), "formatted": pa.string(), "loss_spans": span, "attachments": kind, "media_tokens": pa.int64(), "n_turns": pa.int64()}

    def pieces(batches):
        """(key, piece) of each run of turns with one key."""
        now, held, size, place = None, [], 0, {"piece": 0, "start": 0, "first": 0}

        def flush():
            done = format_conversation(held, place["start"], place["first"]) | {"piece": place["piece"], "start": place["start"]}
            place["piece"] += 1
            place["start"] += len(done["formatted"])
            place["first"] += len(done["attachments"])
            return now, done

        for batch in batches:
            for k, who, what in zip(*batch.columns, strict=True):
                k, turn = k.as_py(), {"role": who.as_py(), "parts": what.as_py()}
                if held and k != now:
                    yield flush()
                    held, size, place = [], 0, {"piece": 0, "start": 0, "first": 0}
                elif size >= PIECE_CHARS:
                    yield flush()
                    held, size = [], 0
                now = k
                held.append(turn)
                size += sum(len(p["text"] or "") for p in turn["parts"] or [])
        if held:
            yield flush()

    def run(batches):
        keys, done, size, kt = [], [], 0, None

        def seen():
            nonlocal kt
            for batch in batches:
                kt = batch.schema.field(0).type
                yield batch

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys, kt), *(pa.array([d[n] for d in done], t) for n, t in types.items())], names=[key, *types])

        for k, d in pieces(seen()):
            keys.append(k)
            done.append(d)
            size += len(d["formatted"])
            if len(keys) >= PIECES or size >= BATCH_CHARS:
                yield out()
                keys, done, size = [], [], 0
        if keys:
            yield out()

    key_type = rows.schema[key].dataType.simpleString()
    return turns.mapInArrow(run, f"`{key}` {key_type}, {OUT}")


def read_back(formatted: DataFrame, key: str = "conv_id", ordered: bool = False) -> DataFrame:
    """Digests of what the formatted output and its loss mask say, one row per conversation; none for an empty table.

    A null role counts as an empty one in the digest, as a null text was an empty one from the start; a null key is a
    conversation of its own. Turns that tie or repeat stand as they were formatted.
    ``ordered``: the pieces come straight from ``format_chats``; else they are put in order first.
    """
    key_type = formatted.schema[key].dataType.simpleString()
    counts = ("n_turns", "loss_chars", "formatted_chars", "n_attachments", "media_tokens")

    def run(batches):
        keys, rows, kt = [], [], None

        def out():
            for r in rows:
                r |= {"turns_sha256": r["turns_sha256"].hexdigest(), "loss_sha256": r["loss_sha256"].hexdigest()}
            columns = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_attachments": pa.int64(), "media_tokens": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(keys, kt), *(pa.array([r[n] for r in rows], t) for n, t in columns.items())], names=[key, *columns])

        for batch in batches:
            kt = batch.schema.field(0).type
            for k, piece, start, text, spans, attached, media in zip(*(c for c in batch.columns), strict=True):
                k, start, text = k.as_py(), start.as_py(), text.as_py()
                if piece.as_py() == 0:
                    if len(rows) >= PIECES:
                        yield out()
                        keys, rows = [], []
                    keys.append(k)
                    rows.append(dict.fromkeys(counts, 0) | {"turns_sha256": hashlib.sha256(), "loss_sha256": hashlib.sha256()})
                turns = parse_formatted(text)
                masked = unescape("".join(text[s["start"] - start : s["end"] - start] for s in spans.as_py()))
                row = rows[-1]
                for n, v in zip(counts, (len(turns), len(masked), len(text), len(attached), media.as_py()), strict=True):
                    row[n] += v
                row["turns_sha256"].update("".join(f"{r or ''}\n{t}\n" for r, t in turns).encode())
                row["loss_sha256"].update(masked.encode())
        if rows:
            yield out()

    pieces = formatted.select(key, "piece", "start", "formatted", "loss_spans", "attachments", "media_tokens")
    if not ordered:
        pieces = pieces.repartition(key).sortWithinPartitions(key, "piece")
    return pieces.mapInArrow(run, f"`{key}` {key_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, media_tokens long")
