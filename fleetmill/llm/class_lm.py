"""LM scoring: a class-based bigram model; exchange clustering assigns every word of the training texts to a class.

Words are known by 64-bit hashes. The number of classes grows as the fourth root of the vocabulary, that of core words
as its square root. Core words are the most frequent ones; they are clustered in sweeps: half of them (by turns) have
their neighbours' classes counted over all training texts, each then moves to the class in which the class bigrams'
likelihood is greatest, with the counts updated at once. It ends when the likelihood hardly grows. Every other word of the training texts,
whatever its count, then has its neighbours' classes gathered by Spark and moves to the class in which they are most likely. Class
bigrams are counted over all tokens of the training texts after that. With classes c of words w, after the class b of
the word before (the end's class at the start of a text),

    p(w | b) = (N(b, c) + A) / (N(b) + A * C) * (n(w) + D) / (N(c) + D * (V(c) + 1)),

n, N and V being counts of the word, of tokens and of different words; one unit of D per class is for words not seen.
A word not seen is taken to be of the class that has most words seen once.

A bounded number of frequent words is held by each task; all others are met by a join on the word. How many are held
changes the work, never the result.

Defined cases: a null text is an empty one, of which the end is the only token; a row without id counts as held out;
equal rows each count; without training texts all words are unseen; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

A, D = 0.1, 0.1

#: Tokens that a task gathers before it adds them up and hands them on.
HELD_TOKENS = 1_000_000


class Sizes(NamedTuple):
    """head: words held by each task at most. Classes: class_factor times the fourth root of the vocabulary; core words:
    core_factor times its square root. sweeps: at most so many; still: they end when the likelihood grows by a smaller share."""

    head: int = 400_000
    class_factor: float = 2.0
    core_factor: float = 4.0
    sweeps: int = 8
    still: float = 1e-4

    def classes(self, vocabulary: int) -> int:
        return max(2, round(self.class_factor * vocabulary**0.25))

    def core(self, vocabulary: int) -> int:
        return min(self.head, max(4, round(self.core_factor * vocabulary**0.5)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts, number of words of each text); A-Z count as lower case."""
    parts = [(raw or b"").lower().split() for raw in texts.cast(pa.binary()).to_pylist()]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter((h for p in parts for h in map(xxhash.xxh3_64_intdigest, p)), np.uint64, int(size.sum())).view(np.int64), size


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): counts of all words of the training texts, added up in each task first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate([np.empty(0, np.int64), *parts]), return_counts=True)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(value), pa.array(times.astype(np.int64))], ["h", "n"])

        for batch in sliced(batches):
            parts.append(word_keys(_column(batch, "text"))[0])
            if sum(map(len, parts)) > 2 * HELD_TOKENS:
                yield out()
        yield out()

    return texts.where("not held_out").select("text").mapInArrow(of, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest words, the commonest first: `most` at most, `least` at least (if there are so many).

    Counts fall into groups by their logarithm; as many whole groups as fit are taken, so no task sorts all words.
    """
    place = F.floor(F.log("n") * 256)
    sizes = counted.groupBy(place.alias("place")).agg(F.count("*").alias("words")).collect()  # some thousand groups
    cut, total = 0, 0
    for r in sorted(sizes, key=lambda r: -r.place):
        if total + r.words > most:
            cut = r.place + 1
            break
        total += r.words
    chosen = counted.where(place >= cut) if total >= min(least, sum(r.words for r in sizes)) else counted.orderBy(F.desc("n"), "h").limit(least)
    top = chosen.toArrow()
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((h, -n))
    return h[order], n[order]


class Held(NamedTuple):
    """Held words, sorted by hash, with the rank of each in order of frequency."""

    sorted: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray) -> Held:
        order = np.argsort(h)
        return cls(h[order], order.astype(np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for words that aren't held."""
        if not len(self.sorted) or not len(h):
            return np.full(len(h), -1, np.int32)
        order = np.argsort(h)
        asked = h[order]
        at = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
        out = np.empty(len(h), np.int32)
        out[order] = np.where(self.sorted[at] == asked, self.rank[at], -1)
        return out


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over stretches of the given sizes, each 1 or more."""
    return np.add.reduceat(values, np.cumsum(size) - size, axis=0) if len(size) else values


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))


def tokenised(texts: DataFrame, h: np.ndarray) -> DataFrame:
    """(doc_id, held_out, units, tail): ranks of the held words, -1 for others, whose hashes are in tail in order."""
    held = texts.sparkSession.sparkContext.broadcast(Held.of(h))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, size = word_keys(_column(batch, "text"))
            unit = held.value.find(keys)
            rare = unit < 0
            text = np.repeat(np.arange(len(size)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(unit, size), _lists(keys[rare], np.bincount(text[rare], minlength=len(size)))], ["doc_id", "held_out", "units", "tail"])

    return texts.select("doc_id", "held_out", "text").mapInArrow(of, "doc_id long, held_out boolean, units array<int>, tail array<long>")


def _streams(batch: pa.RecordBatch, end: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(all units of the batch with an end before and behind every text, places of the ends)."""
    col = _column(batch, name)
    size = col.value_lengths().to_numpy()
    ends = np.cumsum(np.concatenate([[0], size + 1]))
    out = np.full(int(ends[-1]) + 1, end, np.int32)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = col.flatten().to_numpy()
    return out, ends


def _lookup(classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Classes by unit: those of the core, then of the end (-2 from behind), then of all other words (-1)."""
    return np.concatenate([classes, [n_classes, n_classes + 1]]).astype(np.int32)


def _around(rows: DataFrame, classes: np.ndarray, n_classes: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(class bigrams, around[core word, side, class]) over the training texts; around of one half of the core words."""
    core, width = len(classes), n_classes + 2
    held = rows.sparkSession.sparkContext.broadcast(_lookup(classes, n_classes))
    first = width * width

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(first + core * 2 * width, np.int32)
        for batch in sliced(batches):
            u, _ = _streams(batch, -2, "units")
            u[u >= core] = -1
            c = held.value[u].astype(np.int64)
            total[:first] += np.bincount(c[:-1] * width + c[1:], minlength=first).astype(np.int32)
            mine = np.flatnonzero((u >= 0) & (u % 2 == half))  # never the first or last place: those are ends
            for side, other in ((0, mine - 1), (1, mine + 1)):
                cell, n = np.unique(first + (u[mine].astype(np.int64) * 2 + side) * width + c[other], return_counts=True)
                total[cell] += n.astype(np.int32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    t = rows.where("not held_out").select("units").mapInArrow(of, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # cells grow as the vocabulary to 3/4
    out = np.zeros(first + core * 2 * width)
    out[t.column("cell").to_numpy()] = t.column("n").to_numpy()
    return out[:first].reshape(width, width), out[first:].reshape(core, 2, width)


def _xlx(v: np.ndarray) -> np.ndarray:
    v = np.maximum(v, 0)  # counts of neighbours that moved in the same sweep are a little out of date
    return v * np.log(np.maximum(v, 1e-300))


def exchange(big: np.ndarray, around: np.ndarray, classes: np.ndarray, targets: int) -> np.ndarray:
    """New classes, of 0 to targets - 1, of the words that have counts in around[word, side, class]; big: class bigrams, updated as words move."""
    out, big = classes.copy(), big.copy()
    row, col = big.sum(1), big.sum(0)
    total = around[:, 0].sum(1)
    for u in np.argsort(-total, kind="stable"):
        n = total[u]
        if not n:
            break
        before, behind, old = around[u, 0], around[u, 1], out[u]
        a, b = np.flatnonzero(before), np.flatnonzero(behind)
        to, of = behind[b], before[a]
        for new, sign in ((old, -1), (None, 1)):
            if new is None:
                with_b, with_a = big[:targets, b], big[a][:, :targets]
                gain = (_xlx(with_b + to) - _xlx(with_b)).sum(1) + (_xlx(with_a + of[:, None]) - _xlx(with_a)).sum(0)
                gain -= (_xlx(row[:targets] + n) - _xlx(row[:targets])) + (_xlx(col[:targets] + n) - _xlx(col[:targets]))
                new = out[u] = int(np.argmax(gain))
            big[new, b] += sign * to
            big[a, new] += sign * of
            row[new] += sign * n
            col[new] += sign * n
    return out


def cluster(rows: DataFrame, core: int, n_classes: int, z: Sizes) -> np.ndarray:
    """The class of every core word."""
    classes = (np.arange(core) % n_classes).astype(np.int32)
    past: list[float] = []
    for sweep in range(z.sweeps if core else 0):
        big, around = _around(rows, classes, n_classes, sweep % 2)
        past.append(float(_xlx(big).sum() - _xlx(big.sum(0)).sum() - _xlx(big.sum(1)).sum()))
        if len(past) > 2 and past[-1] - past[-3] <= z.still * abs(past[-1]):  # of both halves
            break
        classes = exchange(big, around, classes, n_classes)
    return classes


def assigned(rows: DataFrame, h: np.ndarray, n: np.ndarray, classes: np.ndarray, n_classes: int) -> DataFrame:
    """(h, n, c): every word of the training texts with its count and class."""
    spark, core = rows.sparkSession, len(classes)
    held = spark.sparkContext.broadcast((h, _lookup(classes, n_classes)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each word that isn't of the core: the classes before and behind each of its places, two bytes each."""
        words, class_of = held.value
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key = np.concatenate([np.empty(0, np.int64), *(k for k, _ in parts)])
            cells = np.concatenate([np.empty((0, 2), np.uint16), *(c for _, c in parts)])
            parts.clear()
            order = np.argsort(key)
            key, cells = key[order], cells[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            at = np.append(first, len(key)).astype(np.int32) * 4
            packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(cells))])
            return pa.RecordBatch.from_arrays([pa.array(key[first]), packed], ["h", "cells"])

        for batch in sliced(batches):
            u, _ = _streams(batch, -2, "units")
            mine = np.flatnonzero((u >= core) | (u == -1))
            key = np.empty(len(mine), np.int64)
            rare = u[mine] < 0
            key[rare] = _column(batch, "tail").flatten().to_numpy()
            key[~rare] = words[u[mine][~rare]]
            u[u >= core] = -1
            c = class_of[u].astype(np.uint16)
            parts.append((key, np.column_stack([c[mine - 1], c[mine + 1]])))
            if sum(len(k) for k, _ in parts) > HELD_TOKENS:
                yield out()
        yield out()

    big, _ = _around(rows, classes, n_classes, 2)
    log = np.log(big + A)
    likely = spark.sparkContext.broadcast((log[:, :n_classes].astype(np.float32), log[:n_classes].T.astype(np.float32), (np.log(big.sum(1) + A * len(big)) + np.log(big.sum(0) + A * len(big)))[:n_classes]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before, own = likely.value  # [class before, c], [class behind, c], [c]
        for batch in sliced(batches, 20_000):
            packed = _column(batch, "cells").flatten()
            times = _sums(pc.binary_length(packed).to_numpy() // 4, _column(batch, "cells").value_lengths().to_numpy()).astype(np.int64)
            cells = np.frombuffer(b"".join(packed.to_pylist()), np.uint16).reshape(-1, 2)
            chosen = np.empty(len(times), np.int32)
            ends = np.cumsum(times)
            at = 0
            while at < len(times):  # so many places at once that their gains stay small
                base = ends[at] - times[at]
                to = max(at + 1, int(np.searchsorted(ends, base + 50_000, "right")))
                part = cells[base : ends[to - 1]]
                gain = _sums(after[part[:, 0]] + before[part[:, 1]], times[at:to]) - times[at:to, None] * own
                chosen[at:to] = np.argmax(gain, 1)
                at = to
            yield pa.RecordBatch.from_arrays([_column(batch, "h"), pa.array(times.astype(np.int64)), pa.array(chosen)], ["h", "n", "c"])

    others = rows.where("not held_out").select("units", "tail").mapInArrow(contexts, "h long, cells binary").groupBy("h").agg(F.collect_list("cells").alias("cells"))
    known = spark.createDataFrame(pa.table({"h": h[:core], "n": n[:core], "c": classes}), "h long, n long, c int")  # core words
    return others.mapInArrow(best, "h long, n long, c int").union(known)


def classed(rows: DataFrame, words: DataFrame, h: np.ndarray, n_classes: int, unseen: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, classes): known tokens, sum of log10(count + D), classes of all words but the end."""
    spark = rows.sparkSession
    held = Held.of(h)
    of_held = spark.sparkContext.broadcast(held)

    def only_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = of_held.value.find(_column(batch, "h").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(unit), *batch.columns[1:]], ["unit", "n", "c"]).filter(pa.array(unit >= 0))

    t = words.select("h", "n", "c").mapInArrow(only_held, "unit int, n long, c int").toArrow()  # held words
    logs, classes = np.zeros(len(h)), np.zeros(len(h), np.int16)
    at = t.column("unit").to_numpy()
    logs[at], classes[at] = np.log10(t.column("n").to_numpy() + D), t.column("c").to_numpy()
    model = spark.sparkContext.broadcast((logs, classes))

    tail = rows.where("size(tail) > 0").select("row", F.posexplode("tail").alias("i", "h")).join(words, "h", "left")
    per = tail.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "n", "c"))).alias("t")).select("row", F.col("t.n").alias("tail_n"), F.col("t.c").alias("tail_c"))  # of one text

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_of, class_of = model.value
        for batch in sliced(batches):
            col = _column(batch, "units")
            size = col.value_lengths().to_numpy()
            u = col.flatten().to_numpy()
            rare = u < 0
            n, c = (_column(batch, x).flatten().to_numpy(zero_copy_only=False) for x in ("tail_n", "tail_c"))
            n, seen = np.nan_to_num(n.astype(float)), ~np.isnan(c.astype(float))
            log, kind = np.empty(len(u)), np.empty(len(u), np.int16)
            log[~rare], kind[~rare] = log_of[u[~rare]], class_of[u[~rare]]
            log[rare], kind[rare] = np.log10(n + D), np.where(seen, np.nan_to_num(c.astype(float)), unseen)
            known = np.ones(len(u), np.int64)
            known[rare] = seen
            text = np.repeat(np.arange(len(size)), size)
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "doc_id"), _column(batch, "held_out"), pa.array(size.astype(np.int64) + 1), pa.array(np.bincount(text, known, len(size)).astype(np.int64)), pa.array(np.bincount(text, log, len(size))), _lists(kind, size)],
                ["doc_id", "held_out", "n_tokens", "n_known", "logs", "classes"])

    return rows.select("row", "doc_id", "held_out", "units").join(per, "row", "left").mapInArrow(of, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, classes array<short>")


def bigrams(known: DataFrame, n_classes: int) -> np.ndarray:
    """Class bigrams of the training texts, the end's class being the last."""
    width = n_classes + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in sliced(batches):
            c = _streams(batch, n_classes, "classes")[0].astype(np.int64)
            total += np.bincount(c[:-1] * width + c[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    t = known.where("not held_out").select("classes").mapInArrow(of, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # one for each pair of classes
    out = np.zeros(width * width)
    out[t.column("cell").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(width, width)


def scores(docs: DataFrame, z: Sizes = Sizes()) -> DataFrame:  # noqa: B008  immutable
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, base_perplexity, perplexity).

    Scores are log10 probabilities by the unigram and the class model; perplexities are per token.
    """
    texts = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    spark = docs.sparkSession
    counted = written(word_counts(texts))
    size = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = texts.where("not held_out").count()
    n_all, v_all = (size.n or 0) + ends, size.v + (ends > 0)
    n_classes = z.classes(size.v)
    h, n = frequent(counted, z.head, z.core(size.v))
    # Rows are told apart by a key of their own, as ids may repeat; written once, it stays as it is.
    rows = written(tokenised(texts, h).withColumn("row", F.monotonically_increasing_id()))
    core = min(len(h), z.core(size.v))
    words = written(assigned(rows, h, n, cluster(rows, core, n_classes, z), n_classes))
    width = n_classes + 1
    n_class, v_class, once = np.zeros(width), np.zeros(width), np.zeros(width)
    for r in words.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).collect():  # a row for each class
        n_class[r.c], v_class[r.c], once[r.c] = r.n, r.v, r.once
    n_class[n_classes], v_class[n_classes] = ends, ends > 0
    known = written(classed(rows, words, h, n_classes, int(np.argmax(once[:n_classes]))))
    big = bigrams(known, n_classes)
    step = np.log10((big + A) / (big.sum(1, keepdims=True) + A * width)) - np.log10(n_class + D * (v_class + 1))
    model = spark.sparkContext.broadcast(step)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            c, ends_at = _streams(batch, n_classes, "classes")
            path = np.add.reduceat(model.value[c[:-1], c[1:]], ends_at[:-1]) if len(ends_at) > 1 else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(path)], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "path"])

    scored = known.mapInArrow(paths, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, path double")
    logs = F.col("logs") + F.lit(float(np.log10(ends + D)))
    base = logs - F.col("n_tokens") * F.lit(float(np.log10(n_all + D * (v_all + 1))))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (logs + F.col("path")).alias("score"),
        F.pow(F.lit(10.0), -base / F.col("n_tokens")).alias("base_perplexity"), F.pow(F.lit(10.0), -(logs + F.col("path")) / F.col("n_tokens")).alias("perplexity"))
