"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn in order: text is escaped and written, images, audio and documents become
placeholders whose references and expanded token counts are recorded. Control strings cannot arise from content:
inside texts every `<|` gets a backslash more between its two characters, which reading takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, set_batches

START, END = "<|im_start|>", "<|im_end|>"
OPEN = re.compile(r"<(\\*)\|")
OPENED = re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
#: One part of a turn. Sizes are pixels for images, seconds for audio and pages for documents.
PARTS = "array<struct<type:string,text:string,uri:string,width:double,height:double,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<number:int,type:string,uri:string,tokens:long>>"


def size(part: dict, name: str) -> float:
    """A size of a part; one that is null, negative or not finite counts as 0."""
    value = part.get(name)
    return value if value is not None and isfinite(value) and value > 0 else 0


def escape(text: str) -> str:
    return OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles end at the first line feed, so theirs and the marks of control strings are written in hexadecimal."""
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


@dataclass
class Turn:
    """A formatted turn: its text, the spans under the loss mask, attachments, and tokens that placeholders expand to."""

    text: str
    loss: list[tuple[int, int]]
    attachments: list[dict]
    expanded: int


@dataclass
class Visitor:
    """Flattens typed parts in order. Costs: pixels of a patch side, tokens of a second of audio and of a page."""

    patch: int = 28
    audio_rate: float = 12.5
    page_tokens: int = 560
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part: {kind}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach(part, ceil(size(part, "width") / self.patch) * ceil(size(part, "height") / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, ceil(size(part, "seconds") * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach(part, size(part, "pages") * self.page_tokens)

    def _attach(self, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append({"number": number, "type": part["type"], "uri": part.get("uri"), "tokens": tokens})
        self.out.append(f"<|{part['type']}:{number}|>")


def format_turn(role: str | None, parts: list[dict] | None, trained: str = "assistant") -> Turn:
    """Format one turn. Null roles and texts are empty, null parts are left out; the loss mask holds the texts of the `trained` role."""
    visitor = Visitor()
    head = f"{START}{escape_role(role or '')}\n"
    at, loss = len(head), []
    for part in parts or ():
        if part is None:
            continue
        before = len(visitor.out)
        visitor.visit(part)
        written = sum(map(len, visitor.out[before:]))
        if role == trained and (part.get("type") or "text") == "text" and written:
            loss.append((at, at + written))
        at += written
    return Turn(f"{head}{''.join(visitor.out)}{END}\n", loss, visitor.attachments, sum(a["tokens"] for a in visitor.attachments))


def read(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Read turns back: role, and parts as (type, text or number of the attachment)."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        at, parts, last = found.end(), [], 0
        body = found[2]
        for mark in PLACEHOLDER.finditer(body):
            if mark.start() > last:
                parts.append(("text", unescape(body[last : mark.start()])))
            parts.append((mark[1], mark[2]))
            last = mark.end()
        if last < len(body):
            parts.append(("text", unescape(body[last:])))
        yield unescape_role(found[1]), parts


def turns(df: DataFrame, keep: list[str], role_col: str = "role", parts: Column | None = None) -> DataFrame:
    """`keep` columns of each row with `formatted, loss array<struct<start,end>>, attachments, expanded_tokens`.

    `parts` is an array of typed parts (see PARTS); by default the column `text` is the one part. A row is a turn, so
    turns are formatted where they lie, with no shuffle. Null parts are left out, sizes that are null, negative or not
    finite count as 0. Unknown types raise. An empty table gives an empty result.
    """
    text_part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    named = [df[c].alias(f"k{i}") for i, c in enumerate(keep)]
    types = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batch: dict[str, list]) -> dict[str, list]:
        made = [format_turn(r, p) for r, p in zip(batch["role"], batch["parts"], strict=True)]
        loss = [[{"start": a, "end": b} for a, b in t.loss] for t in made]
        own = {f"k{i}": batch[f"k{i}"] for i in range(len(keep))}
        return own | {"formatted": [t.text for t in made], "loss": loss, "attachments": [t.attachments for t in made], "expanded_tokens": [t.expanded for t in made]}

    source = df.select(*named, df[role_col].alias("role"), (parts if parts is not None else text_part).alias("parts"))
    out = map_batches(source, run, f"{types}, formatted string, loss array<struct<start:long,end:long>>, attachments {ATTACHMENTS}, expanded_tokens long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "formatted", "loss", "attachments", "expanded_tokens")


class _Digest:
    """What is read back from the turns of one conversation, one turn after the other."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, parts in read(formatted):
            text = "".join(p[1] for p in parts if p[0] == "text")
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.chars += len(formatted)


def digests(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """Per conversation, read back from its formatted turns in order: counts and digests of turns and of masked text.

    Turns are ordered by turn, role and text, nulls first; repeated rows are turns of their own; rows with a null id
    are one conversation. Conversations are dealt by a hash of the id and streamed turn by turn: a digest is a fold in
    order, so a conversation is one task's, but only a batch of its turns is held. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = turns(df.select(df[id_col].cast("long").alias("id"), df[turn_col].cast("long").alias("turn"), df[role_col].alias("role"), df["text"].alias("text")), ["id", "turn", "role", "text"])
    order = ["id", "turn", "role", "text"]
    sorted_rows = rows.select(*order, "formatted", "loss").repartition("id").sortWithinPartitions(*order)
    set_batches(spark)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for key, formatted, loss in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5)), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        done.append(_row(now, digest))
                    now, digest = key, _Digest()
                digest.add(formatted, loss)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([_row(now, digest)], schema)

    return sorted_rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _row(key: int | None, d: _Digest) -> dict:
    return {"conv_id": key, "n_turns": d.n, "turns_sha256": d.turns.hexdigest(), "loss_chars": d.loss_chars, "loss_sha256": d.loss.hexdigest(), "formatted_chars": d.chars}
