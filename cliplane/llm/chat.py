"""Chat formatting with typed content parts.

A turn is a role and a list of parts: text, image, audio or document. A visitor
flattens the parts in order: texts are escaped, every other part becomes a
placeholder, and its reference, place and expanded token count are recorded. The
template marks each turn with control strings. Inside texts and roles the start
of a control string, ``<|``, gets a backslash in between (``<\\|`` gets one more,
and so on), so the output can be read back to the same turns.

Turns are formatted row by row, so a conversation of any length is formatted in
parallel; reading back streams the sorted turns of a conversation and holds one
turn at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm.runtime import ship

# The template's control strings
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "other": "<|other|>"}

PATCH = 28  # an image takes a token for each patch of so many pixels a side
AUDIO_RATE = 25  # tokens a second
MAX_SECONDS = 1e9  # a length beyond that, or none at all, is no length
PAGE_TOKENS = 256

LEARNED_ROLE = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TURN = "conv_id long, turn long, formatted string, loss_start int, loss_end int, n_tokens_expanded long, attachments array<struct<kind:string,ref:string,at:int,tokens:long>>"

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


class Flatten:
    """Visits the parts of a turn; ``out`` is the content so far, ``attachments`` what it refers to."""

    def __init__(self, strict: bool = True) -> None:
        self.strict = strict
        self.out, self.size, self.tokens = [], 0, 0
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (-(-max(part[k] or 1, 1) // PATCH) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"] or 0
        self._attach("audio", part, max(1, math.ceil(seconds * AUDIO_RATE)) if 0 < seconds < MAX_SECONDS else 1)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, PAGE_TOKENS * max(part["pages"] or 1, 1))

    def visit_other(self, part: dict) -> None:
        if self.strict:
            raise ValueError(f"unknown content part: {part['type']}")
        self._attach("other", part, 1)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part["ref"], "at": self.size, "tokens": tokens})
        self.tokens += tokens
        self._add(PLACEHOLDER[kind])


def format_turn(role: str | None, parts: list[dict], strict: bool = True) -> tuple[str, int | None, int | None, Flatten]:
    """A turn's text, the span of its content if it is learned from, and what the visitor recorded; if ``strict``, unknown parts are an error."""
    flat = Flatten(strict)
    for part in parts:
        flat.visit(part)
    head = f"{START}{escape_role(role or '')}\n"
    for a in flat.attachments:
        a["at"] += len(head)
    learned = role == LEARNED_ROLE
    return f"{head}{''.join(flat.out)}{END}\n", len(head) if learned else None, len(head) + flat.size if learned else None, flat


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    role, _, content = formatted[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(content)


def text_parts(text_col: str = "text"):
    """A plain text as a list of one text part; a null text is empty."""
    fields = {"type": F.lit("text"), "text": F.coalesce(F.col(text_col), F.lit(""))}
    kinds = [f.split(":") for f in PARTS[len("array<struct<") : -2].split(",")]
    return F.array(F.struct(*(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds)))


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted row for each row of ``turns`` (conv_id, turn, role, parts).

    ``formatted`` is the turn's text, ``loss_start`` and ``loss_end`` the code
    points of the content to learn from (null for other roles), ``attachments``
    the non-text parts in order with their place. Null roles are empty; null
    parts are none, and null elements among them are left out. A part of another or no type is one
    placeholder and token; so is audio whose length is missing, not a number, infinite, negative or over
    MAX_SECONDS. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [format_turn(r, p or [], strict=False) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            attached = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3].tokens for r in rows], pa.int64()),
                    pa.array([r[3].attachments for r in rows], attached),
                ],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "n_tokens_expanded", "attachments"],
            )

    ship(turns.sparkSession)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(PARTS).alias("parts")).mapInArrow(run, TURN)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: counts and digests of what they hold.

    Turns are taken by number; turns with one number by their text. Null
    conversation ids make one conversation. The digests are updated turn by turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state, done = None, None, []

        def ended() -> tuple:
            n, turns, chars, loss, size = state
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for batch in batches:
            for conv, text, lo, hi in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(ended())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = read_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode())
                if lo is not None:
                    learned = unescape(text[lo:hi])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if state is not None:
            done.append(ended())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    ordered = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
