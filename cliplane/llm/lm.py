"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model is an interpolated trigram model over all training documents:

    p(w | u v) = (c(u v w) + PRIOR * p(w | v)) / (c(u v) + PRIOR)
    p(w | v)   = (c(v w) + PRIOR * p(w)) / (c(v) + PRIOR)
    p(w)       = (c(w) + 0.1) / (N + 0.1 * (V + 1))

so after any two words the probabilities of all known words and of one unknown sum
to one. Neither the model nor its vocabulary is ever whole in one place. All
triples of neighbouring tokens are dealt out by their middle word v: the task that
gets v has all that is known of it, builds the trie of its range of words in
memory-mapped levels and scores the triples of all documents there. A document's
score is the sum of what the tasks return. A word's own count is its count as a
middle word, so unigram scores come from the same tasks.

The ``FREQUENT`` most frequent words are known beforehand with their counts, so
that tasks have their p(w). What is asked of other words is finished by a join with
the counts. A frequent word with over ``CROWD`` times ``SHARD_TOKENS`` tokens is dealt out by
both words u v, and a pair u v (one of the ``FREQUENT`` most frequent) with so many
by all three; then the task lacks c(v w), and the triple is finished by a join with
the counts of the pairs after such words. So a shard outgrows its size only by words
that are not among the frequent ones, which have a share of under 1 / FREQUENT each.

Words are known by 62 bits of their XXH64. Triples travel packed: a chunk of
documents sends each task one binary row with the words (frequent ones by their
steps in the table, others by name), runs of middle words, and numbers for the
other words and the documents; there are never more rows than triples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm import kernels
from cliplane.llm.elias_fano import Trie
from cliplane.llm.runtime import ship, stash

PRIOR = 3.0
FREQUENT = 1 << 17
SHARD_TOKENS = 2_000_000
CROWD = 1.5
CHUNK = 8 << 20
CHUNK_ROWS = 32_000
SEED = 404
START, STOP = np.uint64(1), np.uint64(2)  # names of what comes before a text and of its end
KINDS = {
    "rid": pa.int64(), "doc_id": pa.int64(), "held": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(),
    "v": pa.int64(), "w": pa.int64(), "a": pa.float32(), "b": pa.float32(), "p": pa.float32(), "c": pa.int64(),
}
OUT = "rid long, doc_id long, held boolean, n_tokens long, known long, base double, score double, v long, w long, a float, b float, p float, c long"


def tokens(texts: kernels.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Names of the texts' words in order, and the first of each text (one more entry)."""
    names, first = [], [np.zeros(1, np.int64)]
    for a, b in kernels.row_chunks(texts):
        words = kernels.words_of(kernels.part_of(texts, a, b))
        names.append((kernels.word_names(words, SEED, lower=True) >> np.uint64(2)) | np.uint64(4))
        first.append(words.first[1:] + first[-1][-1])
    return np.concatenate(names) if names else np.zeros(0, np.uint64), np.concatenate(first)


def triples(texts: kernels.Texts) -> tuple[np.ndarray, ...]:
    """Different names, and for each token the number of the word two before, before, and its own, and its text."""
    h, first = tokens(texts)
    many = np.diff(first)
    names, number = np.unique(np.concatenate([h, [START, STOP]]), return_inverse=True)
    n = len(h) + len(many)
    text = np.repeat(np.arange(len(many)), many + 1)
    begin = first[:-1] + np.arange(len(many))
    w, v = np.empty(n, np.int64), np.empty(n, np.int64)
    last, head = np.zeros(n, bool), np.zeros(n, bool)
    last[begin + many], head[begin] = True, True
    w[last], w[~last] = number[-1], number[:-2]
    v[head], v[~head] = number[-2], number[:-2]
    u = np.append(number[-2:-1], v[:-1])
    u[head] = number[-2]
    return names, u, v, w, text


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return kernels.mixed(kernels.mixed(u) + np.uint64(3) * v)


class Table:
    """Counts by sorted key."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't in the table."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, -1 where it isn't in the table."""
        at = self.place(keys)
        return np.where(at >= 0, self.counts[at], -1) if len(self.keys) else at


def narrow(x: np.ndarray) -> np.ndarray:
    """The numbers in two bytes each if they fit, else in four."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(10)) == 0, F.lit(False))


def word_counts(rows: DataFrame) -> DataFrame:
    """(w, c): the count of every token of the training documents, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.texts_of(batch.column(0))
            h, _ = tokens(texts)
            w, c = np.unique(h, return_counts=True)
            w, c = np.append(w, STOP), np.append(c, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])

    return rows.filter(~F.col("held")).select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def crowded_pairs(rows: DataFrame, words: Table, least: int) -> Table:
    """Counts of the pairs u v with ``least`` tokens or more after them, FREQUENT of them at most."""
    crowded = Table(words.keys[words.counts >= least], words.counts[words.counts >= least])
    if not len(crowded.keys):
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.texts_of(batch.column(0))
            for a, b in kernels.row_chunks(texts, CHUNK, CHUNK_ROWS):
                names, u, v, _, _ = triples(kernels.part_of(texts, a, b))
                big = crowded.of(names) >= 0
                both = big[u] & big[v]
                key, n = np.unique(pair_key(names[u[both]], names[v[both]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = rows.filter(~F.col("held")).select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    return Table(found["key"].to_numpy().view(np.uint64), found["n"].to_numpy())


def _deal(shards: int, words: Table, pairs: Table, least: int):
    """(shard, first document number, documents, packed triples) for each chunk and shard, and document facts."""

    def pack(base: int, texts: kernels.Texts, held: np.ndarray, facts: dict) -> Iterator[pa.RecordBatch]:
        names, u, v, w, doc = triples(texts)
        listed = words.place(names)
        spread = kernels.mixed(names)[v]
        hot = np.flatnonzero((words.of(names) >= least)[v])
        by_two = pair_key(names[u[hot]], names[v[hot]])
        spread[hot] = kernels.mixed(by_two)
        packed = pairs.of(by_two) >= 0
        spread[hot[packed]] = kernels.mixed(by_two[packed] ^ kernels.mixed(names[w[hot[packed]]]))
        shard = ((spread >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        order = np.argsort(shard * np.uint64(len(names)) + v.astype(np.uint64))
        shard, u, v, w, doc = shard[order], u[order], v[order], w[order], doc[order]
        code = doc.astype(np.uint16) | (held[doc].astype(np.uint16) << np.uint16(15))
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        rows = []
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(shard)).tolist(), strict=True):
            used, local = np.unique(np.concatenate([v[a:b], u[a:b], w[a:b]]), return_inverse=True)
            # Frequent words come first, in the order of the table.
            place = listed[used]
            order = np.lexsort((place, place < 0))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            local = narrow(back[local])
            n, frequent = b - a, int((place >= 0).sum())
            at = np.flatnonzero(np.append(True, local[1:n] != local[: n - 1]))
            parts = [narrow(np.diff(place[order[:frequent]], prepend=0)), names[used[order[frequent:]]], local[:n][at], narrow(np.diff(np.append(at, n))), local[n:], code[a:b]]
            sizes = np.array([x for p in parts for x in (p.itemsize, len(p))], np.int32)
            rows.append((int(shard[a]), base, len(texts), sizes.tobytes() + b"".join(p.tobytes() for p in parts)))
        yield batch_of(rows)
        # What is known of the documents themselves goes to any shard.
        n_tokens = np.bincount(doc, minlength=len(texts))
        yield batch_of([(base % shards, base, -len(texts), n_tokens.astype(np.int64).tobytes() + held.astype(np.int8).tobytes() + facts["null"].tobytes() + facts["id"].tobytes())])

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "base", "docs", "triples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = kernels.texts_of(batch.column(1))
            ids, held = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in kernels.row_chunks(texts, CHUNK, CHUNK_ROWS):
                yield from pack(next_id, kernels.part_of(texts, a, b), held[a:b], {"null": null[a:b], "id": ids[a:b]})
                next_id += b - a

    return run


def unpacked(row: bytes, words: Table) -> tuple[np.ndarray, ...]:
    """Names, and of each triple the numbers of v, u and w among them, and its document's code."""
    sizes = np.frombuffer(row, np.int32, 12).tolist()
    at, parts = 48, []
    for width, many in zip(sizes[::2], sizes[1::2], strict=True):
        parts.append(np.frombuffer(row, f"u{width}", many, at))
        at += many * width
    steps, rare, v, runs, rest, code = parts
    names = np.concatenate([words.keys[np.cumsum(steps, dtype=np.int64)], rare])
    return names, np.repeat(v, runs), rest[: len(code)], rest[len(code) :], code


def table(rid: np.ndarray, **given) -> pa.Table:
    columns = {"rid": rid} | given
    return pa.table([pa.nulls(len(rid), t) if columns.get(k) is None else pa.array(columns[k], t) for k, t in KINDS.items()], names=list(KINDS))


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(key, return_inverse=True)
    return found, at.astype(np.int32)


def _score(words: Table, pairs: Table, least: int, z: float):
    def facts(base: int, docs: int, raw: bytes) -> dict:
        held, null = np.frombuffer(raw, np.int8, docs, 8 * docs), np.frombuffer(raw, np.int8, docs, 9 * docs)
        ids = pa.array(np.frombuffer(raw, np.int64, docs, 10 * docs), mask=null.astype(bool))
        return {"rid": base + np.arange(docs), "n_tokens": np.frombuffer(raw, np.int64, docs), "held": held.astype(bool), "doc_id": ids}

    def run(rows: pa.Table) -> Iterator[pa.Table]:
        parts, names, rids, docs_before, names_before = [], [], [], 0, 0
        for base, docs, raw in zip(rows["base"].to_pylist(), rows["docs"].to_pylist(), (x.as_buffer() for x in rows["triples"]), strict=True):
            if docs < 0:
                yield table(**facts(base, -docs, raw))
                continue
            own, v, u, w, code = unpacked(raw, words)
            parts.append([x.astype(np.int32) + names_before for x in (v, u, w)] + [(code & np.uint16(0x7FFF)).astype(np.int32) + docs_before, code >> np.uint16(15) == 0])
            names.append(own)
            rids.append(base + np.arange(docs))
            docs_before, names_before = docs_before + docs, names_before + len(own)
        if not parts:
            return
        names, number = numbered(np.concatenate(names))
        v, u, w, slot, learned = (np.concatenate([p[i] for p in parts]) for i in range(5))
        v, u, w, rids, size = number[v], number[u], number[w], np.concatenate(rids), len(names)
        del parts, number
        listed = words.of(names)
        crowded = listed >= least
        c1 = np.where(listed >= 0, listed, np.bincount(v[learned], minlength=size))
        # Each token but the last is a middle word, so its count is at hand here.
        real = names[v] != START
        base = np.bincount(slot[real], (np.log10(c1 + 0.1) - np.log10(z))[v[real]], docs_before)
        known = np.bincount(slot[real], c1[v[real]] > 0, docs_before)
        context, at = numbered(v.astype(np.int64) * size + u)
        context_v, context_u = context // size, context % size
        c2 = np.bincount(at[learned], minlength=len(context))
        told = pairs.of(pair_key(names[context_u], names[context_v]))
        c2 = np.where(crowded[context_v] & (told >= 0), told, c2)
        triple, at = numbered(at.astype(np.int64) * size + w)
        triple_c, triple_w = triple // size, triple % size
        triple_u, triple_v = context_u[triple_c], context_v[triple_c]
        c3 = np.bincount(at[learned], minlength=len(triple))
        seen = np.flatnonzero(c3)
        pair, of_pair = numbered(triple_v[seen] * size + triple_w[seen])
        pair_v, pair_w, cp = pair // size, pair % size, np.bincount(of_pair, c3[seen], len(pair)).astype(np.int64)
        whole = ~crowded[pair_v]
        trie = Trie(
            names,
            (pair_v[whole], pair_w[whole], np.log10(cp[whole] / (c1[pair_v[whole]] + PRIOR))),
            (context_v, context_u, np.log10(PRIOR / (c2 + PRIOR))),
            (triple_c[seen], triple_w[seen], np.log10(c3[seen] / (c2[triple_c[seen]] + PRIOR))),
            np.log10(PRIOR / (c1 + PRIOR)),
        )
        a3, b3, a2, b2 = trie.parts(triple_u, triple_v, triple_w)
        p = np.where(listed >= 0, (listed + 0.1) / z, np.nan)[triple_w]
        split = crowded[triple_v]
        with np.errstate(invalid="ignore"):
            value = np.log10(a3 + b3 * (a2 + b2 * p))
        done = ~split & ~np.isnan(p)
        value[~done] = 0
        there = np.bincount(slot, minlength=docs_before) > 0
        yield table(rids[there], known=known[there].astype(np.int64), base=base[there], score=np.bincount(slot, value[at], docs_before)[there])
        token = np.flatnonzero(~done[at])
        one = at[token]
        a, b = np.where(split, a3, a3 + b3 * a2)[one], np.where(split, b3 / (c1[triple_v] + PRIOR), b3 * b2)[one]
        alone = ~split[one]
        yield table(rids[slot[token]], v=pa.array(names.view(np.int64)[triple_v[one]], mask=alone), w=names.view(np.int64)[triple_w[one]], a=a, b=b, p=pa.array(p[one], pa.float32(), from_pandas=True))
        pair_v, pair_w, cp = (x[~whole] for x in (pair_v, pair_w, cp))
        yield table(np.zeros(len(cp), np.int64), v=names.view(np.int64)[pair_v], w=names.view(np.int64)[pair_w], c=cp)

    return run


def _by_shard(scored):
    """Hands the rows of each shard of a partition to ``scored``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            rows = pa.Table.from_batches(parts)
            shards = sorted(set(rows["shard"].to_pylist()))
            for shard in shards:
                own = rows if len(shards) == 1 else rows.filter(pc.equal(rows["shard"], shard))
                for found in scored(own):
                    yield from found.to_batches(max_chunksize=100_000)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod 10 is 0 are scored but not learned from; a
    null id is learned from. Null and empty texts are the end token alone. Rows
    that repeat a document count and are scored each. Other columns are ignored.
    Without training documents all counts are zero and every token is as likely.
    Documents are numbered by where they are read, so ``docs`` is to be a table that
    is read from files; write what comes out of a shuffle first.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    counts = stash(word_counts(rows), "lm-words")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("w") == int(STOP), F.col("c"))).alias("stops")).first()
    n, v, stops = total["n"] or 0, total["v"], total["stops"] or 0
    z = n + 0.1 * (v + 1)
    most = counts.orderBy(F.desc("c"), "w").limit(FREQUENT).toArrow()
    # A text begins as often as it ends.
    words = Table(np.append(most["w"].to_numpy().view(np.uint64), START), np.append(most["c"].to_numpy(), stops))
    least = int(CROWD * SHARD_TOKENS)
    pairs = crowded_pairs(rows, words, least)
    # Shards follow all tokens: those that are only scored take room, too.
    size = rows.agg(F.sum(F.when(F.col("held"), F.length("text"))).alias("held"), F.sum(F.when(~F.col("held"), F.length("text"))).alias("learned")).first()
    shards = int(max(n, n * (size["held"] or 0) / max(size["learned"] or 0, 1) + n, (size["held"] or 0) / 4 if not n else 0) // SHARD_TOKENS) + 1
    dealt = rows.mapInArrow(_deal(shards, words, pairs, least), "shard int, base long, docs int, triples binary")
    # One task for each shard, so that no task holds more than one.
    found = stash(dealt.repartitionById(shards, F.col("shard")).mapInArrow(_by_shard(_score(words, pairs, least, z)), OUT), "lm-parts")
    asked = found.filter("a is not null").select("rid", "v", "w", "a", "b", "p")
    rare = asked.filter("p is null").drop("p").join(counts, "w", "left").withColumn("p", ((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(z)).cast("float")).drop("c")
    asked = asked.filter("p is not null").unionByName(rare)
    after = found.filter("c is not null").groupBy("v", "w").agg(F.sum("c").alias("c"))
    lower = F.coalesce("c", F.lit(0)) + F.lit(PRIOR) * F.col("p")
    both = asked.filter("v is not null").join(after, ["v", "w"], "left").select("rid", F.log10(F.col("a") + F.col("b") * lower).alias("score"))
    one = asked.filter("v is null").select("rid", F.log10(F.col("a") + F.col("b") * F.col("p")).alias("score"))
    parts = found.filter("a is null and c is null").select("rid", "doc_id", "held", "n_tokens", "known", "base", "score").unionByName(both, allowMissingColumns=True).unionByName(one, allowMissingColumns=True)
    sums = parts.groupBy("rid").agg(F.max("doc_id").alias(id_col), F.max("held").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    end = float(np.log10(stops + 0.1) - np.log10(z))
    return sums.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.coalesce("known", F.lit(0)) + F.lit(1 if stops else 0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.coalesce("base", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        "score",
    )
