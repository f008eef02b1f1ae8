"""Substring dedup by recompression.

A document's words are compressed in rounds. Each round first names maximal runs
of one symbol (block step), then splits the symbols into a left and a right class
by a bit of their name and names each left-right pair (pair step). A name is made
from what it stands for, so equal content has the same name in every task. A symbol
carries the span of words that decides it: wherever these words occur, the parse
holds this symbol, so two equal stretches of words have the same symbols in their
interior, whatever surrounds them.

Spark groups the names of the whole corpus in three steps, each on what the one
before has left over:

1. The symbols of ``LOW`` rounds (about six words). A window whose interior holds a
   symbol that occurs once in the corpus cannot occur twice and is ruled out for
   good; so words outside of shared stretches take no part in what follows.
2. In the stretches that are left, each parsed by itself, the symbols of the ``HIGH`` rounds that span a
   window or more. If such a symbol occurs twice, all windows inside it are repeated.
   One of its occurrences goes on to tell other places; the others are settled.
3. The windows that are neither ruled out nor settled. Each gets a 96-bit name, and
   names that start at two or more places mark their words for removal.

Windows that a symbol cannot judge (its deciding span does not fit) are never
ruled out, so the result is that of comparing all windows.

Names are counted by partial sums, and a task tells only whether a name occurs once
or more often in a chunk of its texts. The names that occur twice are written, so that
Spark knows their size, and joined: small ones are broadcast, and of others the
partitions of frequent names are split, which Spark doesn't do while one side is still an aggregate.
Equal texts are one text throughout, known by 96 bits of
its MD5. Words have quick hashes in step 1, which only selects, and XXH64 names in
the steps that decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm import kernels
from cliplane.llm.runtime import bucketed, buckets_for, settle, ship, stash

WINDOW = 35
LOW = 6
HIGH = (9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 22, 24)
FAR = 1 << 40
# Names of step 1 travel with 48 bits: a chance meeting only makes a candidate, which is verified.
SENT = np.uint64(0xFFFFFFFFFFFF0000)
SEED = 101
MIXERS = (101, 202)  # of the two halves of a name


class Symbols:
    """Symbols of some texts: name, words [start, end), deciding words [left, right), text."""

    def __init__(self, name, start, end, left, right, text):
        self.name, self.start, self.end, self.left, self.right, self.text = name, start, end, left, right, text


def _blocks(x: Symbols, word: np.ndarray) -> Symbols:
    """Name each maximal run of a symbol; every symbol now also depends on its neighbours being different."""
    same = x.text[1:] == x.text[:-1]
    left, right = x.left.copy(), x.right.copy()
    first, last = np.ones(len(x.name), bool), np.ones(len(x.name), bool)
    first[1:], last[:-1] = ~same, ~same
    i = np.flatnonzero(~last)
    # A next symbol that starts with another word is another symbol: one word of it decides.
    told = word[x.start[i]] != word[x.end[i]]
    right[i] = np.maximum(right[i], np.where(told, x.end[i] + 1, x.right[i + 1]))
    i = np.flatnonzero(~first)
    told = word[x.end[i] - 1] != word[x.start[i] - 1]
    left[i] = np.minimum(left[i], np.where(told, x.start[i] - 1, x.left[i - 1]))
    left[first], right[last] = -FAR, FAR
    head = np.ones(len(x.name), bool)
    head[1:] = ~(same & (x.name[1:] == x.name[:-1]))
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(x.name)))
    name = x.name[at]
    run = size > 1
    name[run] = kernels.mixed(name[run] * np.uint64(0x9E3779B97F4A7C15) + size[run].astype(np.uint64))
    return Symbols(name, x.start[at], x.end[at + size - 1], np.minimum.reduceat(left, at), np.maximum.reduceat(right, at), x.text[at])


def _pairs(x: Symbols, salt: int) -> Symbols:
    """Name each pair of a left-class symbol and a right-class symbol after it."""
    is_left = (kernels.mixed(x.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    same = x.text[1:] == x.text[:-1]
    n = len(x.name)
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    opens[:-1] = is_left[:-1] & ~is_left[1:] & same
    closes[1:] = opens[:-1]
    left, right = x.left.copy(), x.right.copy()
    # A symbol that stays alone depends on the neighbour that it didn't join.
    i = np.flatnonzero(is_left & ~opens)
    has = np.zeros(n, bool)
    has[:-1] = same
    right[i] = np.where(has[i], np.maximum(right[i], x.right[np.minimum(i + 1, n - 1)]), FAR)
    i = np.flatnonzero(~is_left & ~closes)
    has[:] = False
    has[1:] = same
    left[i] = np.where(has[i], np.minimum(left[i], x.left[np.maximum(i - 1, 0)]), -FAR)
    i = np.flatnonzero(opens)
    name, end = x.name.copy(), x.end.copy()
    name[i] = kernels.mixed(kernels.mixed(x.name[i] + np.uint64(salt)) * np.uint64(3) + x.name[i + 1])
    end[i] = x.end[i + 1]
    left[i], right[i] = np.minimum(left[i], left[i + 1]), np.maximum(right[i], right[i + 1])
    keep = ~closes
    return Symbols(name[keep], x.start[keep], end[keep], left[keep], right[keep], x.text[keep])


def parsed(x: Symbols, word: np.ndarray, rounds: range) -> Symbols:
    """``x`` after more rounds."""
    for r in rounds:
        if len(x.name):
            x = _pairs(_blocks(x, word), 2 * r + 1)
    return x


def recompress(word: np.ndarray, first: np.ndarray, rounds: int = LOW) -> Symbols:
    """The symbols after some rounds; ``first`` bounds the words of each text."""
    at = np.arange(len(word))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return parsed(Symbols(word.copy(), at, at + 1, at, at + 1, text), word, range(rounds))


def span_names(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the names of the runs ``word[start:end]``."""
    values = (kernels.mixed(word + np.uint64(m)) for m in MIXERS)
    return tuple(kernels.spans_hash(x, start, end, m).view(np.int64) for x, m in zip(values, MIXERS, strict=True))


def occurrences(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each different key, how often it occurs (2 stands for more), and which key each row has."""
    order = np.lexsort(keys[::-1])
    head = np.ones(len(order), bool)
    head[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return order[at], np.minimum(np.diff(np.append(at, len(order))), 2).astype(np.int8), which


KEY = ["u1", "u2"]  # of a text


def _chunks(batches: Iterator[pa.RecordBatch], lists: int = 0) -> Iterator[tuple]:
    """(keys, words, columns of lists) of chunks of the texts in (u1, u2, text, lists...)."""
    for batch in batches:
        texts = kernels.texts_of(batch.column(2))
        for a, b in kernels.row_chunks(texts):
            words = kernels.words_of(kernels.part_of(texts, a, b))
            if len(words):
                keys = [batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (0, 1)]
                yield keys, words, [batch.column(3 + i).slice(a, b - a) for i in range(lists)]


def flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists, and the row of each."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def _low(window: int, count: bool):
    """(name, n) of the symbols of a chunk, or (u1, u2, name) of those of each text, odd where the chunk knows that they are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (u1, u2), words, _ in _chunks(batches):
            x = recompress(kernels.word_hashes(words, SEED), words.first)
            name = x.name & SENT
            one, n, which = occurrences(name)
            if count:
                yield _batch("name n", name[one].view(np.int64), n)
                continue
            name |= (n[which] > 1).astype(np.uint64)
            one, _, _ = occurrences(name, x.text)
            # A text with windows that no symbol judges is asked for in any case.
            start = open_windows(x, np.zeros(len(x.name), bool), words.first, window)
            blind = np.unique(np.searchsorted(words.first, start, side="right") - 1)
            name, text = np.append(name[one], np.ones(len(blind), np.uint64)), np.append(x.text[one], blind)
            yield _batch("u1 u2 name", u1[text], u2[text], name.view(np.int64))

    return run


def open_windows(x: Symbols, known: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold no deciding span of a symbol that isn't known to be shared."""
    n = int(first[-1])
    out = np.zeros(n + 1, np.int64)
    rules = ~known & (x.right - x.left <= window)
    lo = np.maximum(x.right[rules] - window, first[x.text[rules]])
    hi = x.left[rules]
    ok = lo <= hi
    np.add.at(out, lo[ok], 1)
    np.add.at(out, hi[ok] + 1, -1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero((np.cumsum(out[:-1]) == 0) & (np.arange(n) + window <= first[text + 1]))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _open(window: int):
    """(u1, u2, runs): where the windows start that aren't ruled out, by text; ``names`` are the text's shared symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (u1, u2), words, (shared,) in _chunks(batches, 1):
            x = recompress(kernels.word_hashes(words, SEED), words.first)
            names, row = flat(shared)
            names = names.to_numpy(zero_copy_only=False).view(np.uint64) & SENT
            # A name together with its text, so that one search answers for all texts of the chunk.
            key = lambda name, text: kernels.mixed(name ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            known = np.isin(key(x.name & SENT, x.text), key(names, row))
            still = np.zeros(len(words), bool)
            still[open_windows(x, known, words.first, window)] = True
            # A run ends with its text: the last window of a text is never followed by one of the next.
            at, many = runs_of(still)
            text = np.searchsorted(words.first, at, side="right") - 1
            cut = np.searchsorted(text, np.arange(len(u1) + 1))
            runs = pa.StructArray.from_arrays([pa.array((at - words.first[text]).astype(np.int32)), pa.array(many.astype(np.int32))], ["pos", "many"])
            some = np.flatnonzero(np.diff(cut))
            yield _batch("u1 u2 runs", u1[some], u2[some], pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), runs).take(pa.array(some)))

    return run


class Stretches:
    """The words of a chunk that windows cover which aren't ruled out.

    ``still`` marks the windows' first words; ``at`` are the words, ``first`` bounds
    the stretches among them, ``name`` are their XXH64.
    """

    def __init__(self, words: kernels.Words, runs: pa.ListArray, window: int):
        found, row = flat(runs)
        begin, many = (found.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        begin = begin + words.first[row]
        mark = np.zeros((2, len(words) + 1), np.int64)
        np.add.at(mark[0], begin, 1)
        np.add.at(mark[0], begin + many, -1)
        np.add.at(mark[1], begin, 1)
        np.add.at(mark[1], begin + many + window - 1, -1)
        self.still, covered = np.cumsum(mark, 1)[:, :-1] > 0
        self.at = np.flatnonzero(covered)
        text = np.searchsorted(words.first, self.at, side="right")
        new = np.append(True, (np.diff(self.at) > 1) | (np.diff(text) > 0)) if len(self.at) else np.zeros(0, bool)
        self.first = np.append(np.flatnonzero(new), len(self.at))
        self.name = kernels.xxh64(words.buf, words.start[self.at], words.end[self.at], SEED)

    def names(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of the names of runs of words of the chunk."""
        return span_names(self.name, np.searchsorted(self.at, start), np.searchsorted(self.at, end - 1) + 1)


def high_symbols(name: np.ndarray, first: np.ndarray, still: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the symbols of HIGH rounds that span a window or more, none of whose windows is ruled out."""
    left = np.concatenate([[0], np.cumsum(still)])
    x, done = recompress(name, first), LOW
    found = [np.zeros((0, 2), np.int64)]
    for rounds in HIGH:
        x = parsed(x, name, range(done, rounds))
        done = rounds
        last = x.end - window + 1
        fits = np.flatnonzero(last > x.start)
        fits = fits[left[last[fits]] - left[x.start[fits]] == last[fits] - x.start[fits]]
        found.append(np.stack([x.start[fits], x.end[fits]], 1))
    return tuple(np.unique(np.concatenate(found), axis=0).T)


def _high(window: int, count: bool):
    """Of long symbols, (g1, g2, n, u1, u2, start) with the smallest place in a chunk, or (g1, g2, u1, u2, start, stop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (u1, u2), words, (runs,) in _chunks(batches, 1):
            own = Stretches(words, runs, window)
            if not len(own.at):
                continue
            start, end = high_symbols(own.name, own.first, own.still[own.at], window)
            g1, g2 = span_names(own.name, start, end)
            start, end = own.at[start], own.at[end - 1] + 1
            text = np.searchsorted(words.first, start, side="right") - 1
            start, end = ((a - words.first[text]).astype(np.int32) for a in (start, end))
            if count:
                order = np.lexsort((start, u2[text], u1[text]))
                one, n, _ = occurrences(g1[order], g2[order])
                one = order[one]
                yield _batch("g1 g2 n u1 u2 start", g1[one], g2[one], n, u1[text[one]], u2[text[one]], start[one])
            else:
                yield _batch("g1 g2 u1 u2 start stop", g1, g2, u1[text], u2[text], start, end)

    return run


def _windows(window: int, count: bool):
    """(f1, f2, n) of a chunk's windows, or (f1, f2, u1, u2, pos, many): those that ask, and, without a name, runs of repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (u1, u2), words, (runs, sure) in _chunks(batches, 2):
            first, own = words.first, Stretches(words, runs, window)
            if not len(own.at):
                continue
            symbols, row = flat(sure)
            begin, stop = (symbols.field(i).to_numpy(zero_copy_only=False) + first[row] for i in (0, 1))
            tells = symbols.field(2).to_numpy(zero_copy_only=False).astype(bool)
            inside = np.zeros((2, len(words) + 1), np.int64)
            for i, some in enumerate((~tells, tells)):
                np.add.at(inside[i], begin[some], 1)
                np.add.at(inside[i], stop[some] - window + 1, -1)
            settled, telling = np.cumsum(inside, 1)[:, :-1] > 0
            repeated = settled | telling
            start = np.flatnonzero(own.still & (telling | ~settled))
            f1, f2 = own.names(start, start + window)
            f2 = f2.astype(np.int32)
            one, n, which = occurrences(f1, f2)
            if count:
                many = np.maximum(n, np.where(np.bincount(which, telling[start], len(one)) > 0, 2, 1)).astype(np.int8)
                yield _batch("f1 f2 n", f1[one], f2[one], many)
                continue
            repeated[start[n[which] > 1]] = True
            at, many = runs_of(repeated)
            text = np.searchsorted(first, at, side="right") - 1
            none = (pa.nulls(len(at), kind) for kind in (pa.int64(), pa.int32()))
            yield _batch("f1 f2 u1 u2 pos many", *none, u1[text], u2[text], (at - first[text]).astype(np.int32), many.astype(np.int32))
            ask = ~repeated[start]
            f1, f2, start = f1[ask], f2[ask], start[ask]
            text = np.searchsorted(first, start, side="right") - 1
            yield _batch("f1 f2 u1 u2 pos many", f1, f2, u1[text], u2[text], (start - first[text]).astype(np.int32), np.ones(len(start), np.int32))

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.texts_of(batch.column(2))
            copies = batch.column(3).to_numpy(zero_copy_only=False)
            for a, b in kernels.row_chunks(texts):
                digests, kept_texts = [], []
                words = kernels.words_of(kernels.part_of(texts, a, b))
                first = words.first
                size = np.diff(first)
                cover = np.zeros(len(words) + 1, np.int64)
                runs, row = flat(batch.column(4).slice(a, b - a))
                begin, many = (runs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                begin = begin + first[row]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + many + window - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                gone |= np.repeat((copies[a:b] > 1) & (size >= window), size)
                left = np.flatnonzero(~gone)
                kept_first = np.searchsorted(left, first)
                buf, _, end = kernels.joined_by_space(kernels.Words(*_kept_words(words, left), kept_first))
                stop = np.concatenate([[0], end + 1]) if len(end) else np.zeros(1, np.int64)
                for i in range(b - a):
                    lo, hi = kept_first[i], kept_first[i + 1]
                    kept = buf[stop[lo] : stop[hi] - 1].tobytes() if hi > lo else b""
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode("utf-8", "replace"))
                yield _batch("u1 u2 n_words n_removed kept_sha256 kept_text", *(batch.column(i).slice(a, b - a) for i in (0, 1)), size, size - np.diff(kept_first), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string()))

    return run


def _kept_words(words: kernels.Words, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the words that stay, one space apart, with their new places."""
    length = (words.end - words.start)[left]
    inside = np.zeros(len(words.buf) + 1, np.int64)
    np.add.at(inside, words.start[left], 1)
    np.add.at(inside, words.end[left], -1)
    flat = words.buf[np.cumsum(inside[:-1]) > 0]
    end = np.cumsum(length + 1) - 1
    buf = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    place = np.ones(len(buf), bool)
    place[end] = False
    buf[place] = flat
    return buf, end - length, end


def repeated_runs(texts: DataFrame, window: int) -> DataFrame:
    """(u1, u2, runs): where repeated windows start in each of the different texts (u1, u2, text), as runs of (pos, many)."""
    row = [*KEY, "text"]
    texts = texts.select(*row)
    counts = texts.mapInArrow(_low(window, True), "name long, n tinyint").groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1").select("name")
    # The lowest bit tells what the chunk knows; those names are among the counted ones in any case, but for the marks of blind texts.
    own = texts.mapInArrow(_low(window, False), "u1 long, u2 int, name long")
    blind = F.col("name") == 1
    own = own.withColumn("sent", F.when(blind, F.col("u1")).otherwise(F.col("name").bitwiseAND(F.lit(-2))))
    named = stash(counts.withColumnRenamed("name", "sent"), "repeats-low")
    shared = own.join(named.withColumn("there", F.lit(True)), "sent", "left").filter(blind | F.col("there")).select(*KEY, "name")
    shared = shared.groupBy(*KEY).agg(F.collect_list("name").alias("names"))
    opened = texts.join(shared, KEY).select(*row, "names").mapInArrow(_open(window), "u1 long, u2 int, runs array<struct<pos: int, many: int>>")

    opened = stash(opened, "repeats-open")
    settle(texts.sparkSession)
    left = texts.join(opened, KEY).select(*row, "runs")
    place = F.struct(*KEY, "start")
    counts = left.mapInArrow(_high(window, True), "g1 long, g2 long, n tinyint, u1 long, u2 int, start int").groupBy("g1", "g2").agg(F.sum("n").alias("n"), F.min(place).alias("one")).filter("n > 1").select("g1", "g2", "one")
    counts = stash(counts, "repeats-high")
    sure = left.mapInArrow(_high(window, False), "g1 long, g2 long, u1 long, u2 int, start int, stop int").join(counts, ["g1", "g2"])
    sure = sure.select(*KEY, F.struct("start", "stop", (place == F.col("one")).alias("tells")).alias("symbol")).groupBy(*KEY).agg(F.collect_list("symbol").alias("sure"))
    sure = stash(sure, "repeats-sure")
    settle(texts.sparkSession)

    left = left.join(sure, KEY, "left").select(*row, "runs", "sure")
    counts = left.mapInArrow(_windows(window, True), "f1 long, f2 int, n tinyint").groupBy("f1", "f2").agg(F.sum("n").alias("n")).filter("n > 1").select("f1", "f2", F.lit(True).alias("there"))
    counts = stash(counts, "repeats-windows")
    # Runs without a name are known; a name of their text spreads them in the join.
    asked = left.mapInArrow(_windows(window, False), "f1 long, f2 int, u1 long, u2 int, pos int, many int")
    asked = asked.select(F.coalesce("f1", "u1").alias("f1"), F.coalesce("f2", "u2").alias("f2"), F.col("f1").isNull().alias("known"), *KEY, "pos", "many")
    told = asked.join(counts, ["f1", "f2"], "left").filter(F.col("known") | F.col("there"))
    return told.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "many")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text, and the columns in ``keep``.

    Words are ``[^\\x20\\x09-\\x0D]+``. Each word that a repeated window of
    ``window`` words covers is removed; ``kept_text`` holds the others, one space
    apart. Null and empty texts have no words. Texts shorter than the window lose
    nothing. Rows with equal texts repeat each other's windows and lose them all,
    whatever their ids. Null ids are kept as null. Other columns are ignored unless
    kept. Words and windows are the same if their names of 64 and 96 bits are.
    """
    ship(docs.sparkSession)
    rest = F.struct(F.lit(0).cast("tinyint").alias("_"), *keep).alias("rest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits = lambda at, n: F.conv(F.substring(F.md5(text), at, n), 16, -10).cast("long")
    keyed = docs.select(digits(1, 16).alias("u1"), (digits(17, 8) - F.lit(1 << 31)).cast("int").alias("u2"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), rest)
    texts = bucketed(keyed.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies")), KEY, "texts", buckets_for(docs))
    settle(docs.sparkSession)
    found = texts.join(repeated_runs(texts, window), KEY, "left").select(*KEY, "text", "copies", "runs")
    cut = found.mapInArrow(_cut(window), "u1 long, u2 int, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return keyed.drop("text").join(cut, KEY).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *(f"rest.{c}" for c in keep))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words removed from their texts; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = remove_repeats(docs, keep=others).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)
