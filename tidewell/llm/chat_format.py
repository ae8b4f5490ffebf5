"""Chat formatting with typed content parts.

A turn is a role and a list of parts: text, image, audio or document. A visitor flattens the parts
in order: texts are escaped, the others become a placeholder each, and for every placeholder an
attachment is recorded with its reference, its place in the turn and the number of tokens that it
stands for. A formatted turn reads

    <|turn|>role<|text|>content<|end|>\\n

and its mask covers the content of assistant turns. Escaping puts one backslash behind the first
character of every control string in a text, also where backslashes stand there already; reading
takes one away, so any text comes back unchanged and no control string in a formatted
conversation was written by a user.

Turns are formatted one by one and never gathered: a conversation is read as a sorted stream, in
which only the digests of the conversation at hand are kept, so its length has no bound.

Defined cases: null texts and null roles are empty; null or empty part lists give an empty turn;
unknown kinds of parts count as documents; turns with equal numbers are ordered by role, then by
what they say; null conv_id is a conversation of its own; repeated rows are turns of their own; an
empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.runtime import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: What a text must not say in the open: this template's marks and those of common others.
CONTROL = (TURN, TEXT, END, *PLACEHOLDERS.values(), "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
_RAW = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))
_MARKS = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
FORMATTED = "conv_id long, turn long, piece string, mask array<struct<start: long, end: long>>, attachments array<struct<kind: string, ref: string, part: int, at: long, tokens: long>>"


def escape(text: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Flattener:
    """Visits the parts of one turn in order; ``pieces`` and ``attachments`` are what they become."""

    #: Side of an image tile, audio tokens a second, tokens a page.
    TILE, RATE, PAGE = 28, 25, 256

    def __init__(self):
        self.pieces, self.attachments, self.at, self.part = [], [], 0, 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_document)(part)
        self.part += 1

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or 1) / self.TILE) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.PAGE)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "part": self.part, "at": self.at, "tokens": max(1, tokens)})
        self._put(PLACEHOLDERS[kind])

    def _put(self, s: str) -> None:
        self.pieces.append(s)
        self.at += len(s)


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[dict], list[dict]]:
    """(piece, mask, attachments); mask and ``at`` count code points of the piece."""
    merged: list[dict] = []
    for p in parts:  # neighbouring texts are one text, so that no control string forms at their border
        if merged and (p.get("kind") or "text") == "text" and (merged[-1].get("kind") or "text") == "text":
            merged[-1] = merged[-1] | {"text": (merged[-1].get("text") or "") + (p.get("text") or "")}
        else:
            merged.append(p)
    f = Flattener()
    for p in merged:
        f.visit(p)
    head = f"{TURN}{escape(role or '')}{TEXT}"
    content = "".join(f.pieces)
    mask = [{"start": len(head), "end": len(head) + len(content)}] if role == LOSS_ROLE else []
    return f"{head}{content}{END}\n", mask, [a | {"at": a["at"] + len(head)} for a in f.attachments]


def read_turn(piece: str) -> tuple[str, str]:
    """(role, content) of a formatted turn, with placeholders left in the content."""
    if not (piece.startswith(TURN) and piece.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    role, content = piece[len(TURN) : -len(END) - 1].split(TEXT, 1)
    return unescape(role), unescape(content)


def format_turns(turns: DataFrame) -> DataFrame:
    """FORMATTED rows from (conv_id, turn, role) and ``parts`` (array of PART) or else ``text``."""
    if "parts" in turns.columns:
        d = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
    else:
        d = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("text").alias("parts"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, masks, attached = [], [], []
            for role, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                parts = [{"kind": "text", "text": parts}] if isinstance(parts, str) else [p for p in parts or [] if p]
                for col, v in zip((pieces, masks, attached), format_turn(role, parts), strict=True):
                    col.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            ref = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("tokens", pa.int64())]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(pieces, pa.string()), pa.array(masks, span), pa.array(attached, ref)], names=["conv_id", "turn", "piece", "mask", "attachments"])

    return d.mapInArrow(make, FORMATTED)


class _Digest:
    """What is known of the conversation at hand; of fixed size."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss = conv_id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, mask: list[dict]) -> None:
        role, content = read_turn(piece)
        self.n += 1
        self.chars += len(piece)
        self.turns.update(f"{role}\n{content}\n".encode())
        for m in mask:
            text = unescape(piece[m["start"] : m["end"]])
            self.loss += len(text)
            self.masked.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


DIGESTS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGESTS.values(), strict=True)], names=list(DIGESTS))
        now, done = None, []
        for b in batches:
            for conv_id, piece, mask in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(piece, mask)
            if done:
                yield pack(done)
                done = []
        if now:
            yield pack([now.row()])

    d = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").select("conv_id", "piece", "mask")
    return d.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversation_digests(format_turns(given.unionByName(extra)))
