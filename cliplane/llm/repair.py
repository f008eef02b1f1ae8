"""Repair of conversations at least cost, by block tables after the Four Russians.

A conversation is to be an optional system turn and then pairs of a user's and an
assistant's turn, or nothing. Every turn may be kept (``K``, 0), given the role that is due
(``R``, 2) or deleted (``D``, 3; blank and repeated turns must be), and an empty turn with the
role that is due may be inserted anywhere (``I``, 2). A truncated turn that stays costs 1 more.
Of the cheapest repairs the one with the ASCII-least string of edits is taken.

What matters of a turn is one of nine symbols; where a repair stands is one of four
states. The costs to go of the four states, less their minimum, form one of a few dozen
vectors. A table holds, for each vector and each block of ``BLOCK`` symbols, the vector
before the block. So a conversation is read from its end, a lookup for each block; then it
is traced from its start, and only here a block is expanded, backward from the vector
behind it, so that at each turn the least letter that is still cheapest can be told.

In Spark, turns are sorted by ranges of (conversation, turn), so that a conversation
of any length is spread, and numbered in that order. First occurrences are found by an
aggregate and marked by a join on the unique number, where no key is hot. The symbols, a byte a
turn, then stream backward through the task of their conversation and leave it in
segments of ``SEGMENT`` turns with the vector behind each; turns stream forward behind
their segments. No task holds a conversation, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.llm.runtime import ship, stash

BLOCK = 4
SEGMENT_BITS = 10
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# States: nothing yet, after the system's turn, after a user's, after an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DUE = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
END = (0, 2 * INSERT, INSERT, 0)
INITIALS = " sua"  # any other one is the first
GONE = 0  # the symbol of a turn that must go; others are 1 + 2 * initial + truncated
SYMBOLS = 1 + 2 * len(INITIALS)
AT_END = ("", "II", "I", "")


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a turn."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        initial, cut = INITIALS[(symbol - 1) // 2], (symbol - 1) % 2 * TRUNCATED
        if (state, initial) in KEPT:
            out.append(("K", KEEP + cut, KEPT[state, initial]))
        out.append(("R", RENAME + cut, DUE[state][0]))
    return out


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to go before a turn from those after it; turns may be inserted before it."""
    v = [min(cost + after[to] for _, cost, to in choices(symbol, q)) for q in range(4)]
    for _ in range(4):
        v = [min(v[q], INSERT + v[DUE[q][0]]) for q in range(4)]
    return tuple(v)


class Tables:
    """Normalised cost vectors, and what a symbol and a block of symbols make of them."""

    def __init__(self) -> None:
        ids, self.vectors, steps = {END: 0}, [END], []
        while len(steps) < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                v = before(self.vectors[len(steps)], symbol)
                least = tuple(x - min(v) for x in v)
                if least not in ids:
                    ids[least] = len(ids)
                    self.vectors.append(least)
                row.append(ids[least])
            steps.append(row)
        self.step = np.array(steps, np.uint16)
        # A block's number has its first symbol in the highest place; the last one is taken first.
        block = self.step
        for _ in range(BLOCK - 1):
            block = self.step[block].transpose(0, 2, 1).reshape(len(steps), -1)
        self.block = block
        self.edits: dict[tuple[int, int, int], tuple[str, int]] = {}

    def past(self, symbols: bytes, after: int) -> list[int]:
        """The vector behind each block of ``symbols`` and, at last, the one before them all; from the end."""
        whole = len(symbols) // BLOCK * BLOCK
        out = [after]
        if whole < len(symbols):
            for s in reversed(symbols[whole:]):
                after = int(self.step[after, s])
            out.append(after)
        digits = np.frombuffer(symbols, np.uint8, whole).astype(int).reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK)[::-1]
        for b in digits[::-1].tolist():
            after = int(self.block[after, b])
            out.append(after)
        return out

    def edit(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """The ASCII-least cheapest letters of a turn, inserted ones first, and the state behind it."""
        key = (after, symbol, state)
        if key not in self.edits:
            to_go, v, letters = self.vectors[after], before(self.vectors[after], symbol), ""
            while True:
                options = [(letter, to) for letter, cost, to in choices(symbol, state) if cost + to_go[to] == v[state]]
                if INSERT + v[DUE[state][0]] == v[state]:
                    options.append(("I", DUE[state][0]))
                letter, state = min(options)
                letters += letter
                if letter != "I":
                    break
            self.edits[key] = letters, state
        return self.edits[key]

    def trace(self, symbols: bytes, after: int, state: int) -> tuple[list[str], int]:
        """The letters of each turn of ``symbols`` from ``state`` on, and the state behind them; ``after`` is the vector behind them."""
        out = []
        for start, behind in zip(range(0, len(symbols), BLOCK), self.past(symbols, after)[-2::-1], strict=True):
            own = symbols[start : start + BLOCK]
            inner = [behind]
            for s in reversed(own[1:]):
                inner.append(int(self.step[inner[-1], s]))
            for s, w in zip(own, reversed(inner), strict=True):
                letters, state = self.edit(w, s, state)
                out.append(letters)
        return out, state


@cache
def tables() -> Tables:
    return Tables()


def _symbol(role: Column, text: Column, new: Column) -> Column:
    initial = F.substring(role, 1, 1)
    place = F.lit(0)
    for i in range(1, len(INITIALS)):
        place = F.when(initial == INITIALS[i], i).otherwise(place)
    return F.when(~text.rlike(BLANK) | ~new, GONE).otherwise(1 + 2 * place + F.when(text.rlike(ENDED), 0).otherwise(1))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of symbols with the vector behind each, from turns in falling order."""
    t = tables()
    now, after, symbols, done = None, 0, bytearray(), []

    def close() -> int:
        own = bytes(reversed(symbols))
        done.append((*now, own, after))
        symbols.clear()
        return t.past(own, after)[-1]

    def made() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv", "seg", "symbols", "after"])

    for batch in batches:
        for conv, gid, symbol in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key = (conv, gid >> SEGMENT_BITS)
            if key != now:
                if now is not None:
                    before_it = close()
                    after = before_it if now[0] == conv else 0
                now = key
            symbols.append(symbol)
        if len(done) > 1000:
            yield made()
            done.clear()
    if now is not None:
        close()
        yield made()


STEP = "conv_id long, edit string, turn long, role string, text string, old_role string, fault string"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order, from each conversation's segments, each before its turns. A conversation without turns has one row without an edit."""
    t = tables()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    now, state, any_, out, letters, at, symbols = None, NOTHING, False, [], [], 0, b""

    def insert() -> None:
        nonlocal state
        state, role = DUE[state]
        out.append((now[0], "I", None, role, "", None, None))

    def close() -> None:
        for _ in AT_END[state]:
            insert()
        if not any_:
            out.append((now[0], None, None, None, None, None, None))

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in STEP.split(", ")])

    for batch in batches:
        for conv, kind, own, after, blank, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now, state, any_ = (conv,), NOTHING, False
            if kind == 0:
                letters, _ = t.trace(own, after, state)
                at, symbols = 0, own
            elif kind == 1:
                any_ = True
                symbol = symbols[at]
                fault = ("blank" if blank else "duplicate") if symbol == GONE else "truncated" if (symbol - 1) % 2 else None
                for letter in letters[at]:
                    if letter == "I":
                        insert()
                    else:
                        kept = {"K": role, "R": DUE[state][1], "D": None}[letter]
                        state = {"K": lambda: KEPT[state, role[:1]], "R": lambda: DUE[state][0], "D": lambda: state}[letter]()
                        out.append((conv, letter, turn, kept, None if letter == "D" else text, role, fault))
                at += 1
        if len(out) > 10000:
            yield made()
            out.clear()
    if now is not None:
        close()
    if out:
        yield made()


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The edits of all conversations of ``turns`` (conv_id, turn, role, text): conv_id, edit, turn, role, text, old_role, fault.

    Rows of one conversation come in one partition, in order. ``role`` and ``text`` are the
    repaired ones (null for deleted turns), ``fault`` is blank, duplicate, truncated or null. A conversation of
    ``ids`` (conv_id) without turns has one row without an edit. Null roles and
    texts count as one space; null turns come first; turns with one number are in order of role and
    text, equal rows next to each other. Null conversation ids make one conversation.
    A role with no or another initial than s, u, a can't be kept. Other columns are ignored; empty tables give no rows.
    """
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    # The start of a text orders like the text, and keeps the sample that ranges are made from small.
    ranged = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 16))
    ordered = ranged.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").withColumn("gid", F.monotonically_increasing_id())
    kept = stash(ordered, "repair-turns")
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    firsts = kept.groupBy("conv", name.alias("name")).agg(F.min("gid").alias("gid")).select("gid", F.lit(True).alias("new"))
    facts = kept.select("conv", "gid", *(_symbol(F.col("role"), F.col("text"), F.lit(new)).alias(n) for new, n in ((True, "as_new"), (False, "as_old"))))
    marked = facts.join(firsts, "gid", "left").select("conv", "gid", F.when(F.col("new"), F.col("as_new")).otherwise(F.col("as_old")).alias("symbol"))
    ship(turns.sparkSession)
    segments = marked.repartition("conv").sortWithinPartitions("conv", F.desc("gid")).mapInArrow(_backward, "conv long, seg long, symbols binary, after int")
    null = lambda kind: F.lit(None).cast(kind)
    parts = [
        segments.select("conv", "seg", F.lit(0).alias("kind"), null("long").alias("gid"), "symbols", "after", null("boolean").alias("blank"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text")),
        kept.select("conv", F.shiftright("gid", SEGMENT_BITS).alias("seg"), F.lit(1).alias("kind"), "gid", null("binary").alias("symbols"), null("int").alias("after"), (~F.col("text").rlike(BLANK)).alias("blank"), "turn", "role", "text"),
    ]
    if ids is not None:
        named = ids.select(F.col("conv_id").cast("long").alias("conv")).distinct()
        parts.append(named.select("conv", F.lit(-1).cast("long").alias("seg"), F.lit(-1).alias("kind"), null("long").alias("gid"), null("binary").alias("symbols"), null("int").alias("after"), null("boolean").alias("blank"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    streamed = every.repartition("conv").sortWithinPartitions("conv", "seg", "kind", "gid")
    return streamed.select("conv", "kind", "symbols", "after", "blank", "turn", "role", "text").mapInArrow(_forward, STEP)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by a checksum of conversation and turn: rows are dropped, emptied, stripped of their ends, repeated, made the user's."""
    space = F.lit(" ")
    at = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))), F.lit(20))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), at.alias("_at")).filter("_at <> 0")
    copies = F.explode(F.when(F.col("_at") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    hurt = F.when(F.col("_at") == 1, "").when(F.col("_at") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_at") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), copies.alias("_copy")).drop("_copy")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(edits: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of each conversation of repair(), from its rows as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 7 + (pa.string(),) * 2
        now, s, done = None, None, []

        def close() -> None:
            gaps = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
            done.append((now[0], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], s["audit"].decode(), s["sha"].hexdigest()))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [f.split()[0] for f in DIGEST.split(", ")])

        for batch in batches:
            for conv, edit, turn, role, text, old, fault in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = (conv,)
                    s = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(), "sha": hashlib.sha256(), "any": False, "first": None, "last": None, "turns": 0, "old": None}
                if edit is None:
                    continue
                s["audit"] += edit.encode()
                s["cost"] += {"K": KEEP, "R": RENAME, "D": DELETE, "I": INSERT}[edit]
                if edit != "D":
                    s["sha"].update(("\n" if s["any"] else "").encode() + f"{role}:{text}".encode())
                    s["any"] = True
                if edit == "I":
                    continue
                if fault is not None:
                    s[fault] += 1
                    s["cost"] += TRUNCATED if fault == "truncated" and edit != "D" else 0
                if s["old"] is not None:
                    s["illegal"] += s["old"] + old[:1] not in ("su", "ua", "au")
                s["old"] = old[:1]
                if turn is not None and turn != s["last"]:
                    s["first"] = turn if s["first"] is None else s["first"]
                    s["last"] = turn
                    s["turns"] += 1
            if len(done) > 1000:
                yield made()
                done.clear()
        if now is not None:
            close()
        if done:
            yield made()

    return edits.mapInArrow(run, DIGEST)
