"""Substring dedup: lines, and the sentences within lines, are hashed; repeats after the earliest go, by their offsets.

Units are whole lines and, in lines of several sentences, each sentence (passages often start in the middle of a line,
where hashes of lines alone can't find them). A unit is normalised (A-Z lower-cased, white space runs to one space) and
hashed with 128 bits. Of equal units the earliest by (rank, id, place in the text) is kept. A later whole line goes if
it has min_words or more; later sentences go where a run of them side by side has run_words or more. Sentences of fewer
than min_words words neither count nor part a run. Both are 1 unless given: every repeated line and sentence goes.

Passages that begin or end inside a sentence are found by fingerprints: of each WIDE windows of GRAM words side by side
the one with the least hash is taken, so equal stretches of PASSAGE_WORDS words have one in common wherever they start.
Windows that occur earlier are joined to runs, and a run grows at both sides, word by word, as far as the first
occurrence of one of its outer windows goes on alike, by WIDE - 1 words at most (an equal stretch has a taken window no
further from its end). Runs of PASSAGE_WORDS words or more go. In scripts without blanks each character counts as a word.

First 64-bit hashes are counted; only units whose hash may be repeated (a bounded Bloom filter) are then grouped by
their 128 bits, with partial aggregation, and joined back (a join that Spark can split if a unit is very common).

Defined cases: null or blank texts have no units; a row is known by its doc_id and the hash of its text, so rows that
share an id keep apart, and rows that repeat both have the same units at the same place, which are one occurrence; a
row without doc_id is never changed and keeps nothing; a row without rank comes last; an empty table gives an empty
result; other columns are ignored here and kept by removed().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap
from .common import checked_broadcast, sliced, written

#: What a row is known by; text_key is a hash of its text.
ROW = ["doc_id", "text_key"]

#: Words of a window; windows of which one is taken; words of a stretch that surely holds a taken window.
GRAM, WIDE = 26, 25
PASSAGE_WORDS = GRAM + WIDE - 1

#: Bytes of text that a task takes at once: some hundred bytes of arrays are made for each.
SLICE = 1 << 20

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

#: Pieces of a line: to the end of a sentence and the blanks behind it, or the rest.
_PIECE = re.compile(r".*?[.!?]+[ \t]+|.+")


def _digest(piece: str, min_words: int) -> tuple[int, int]:
    """(hash, number of words) of a normalised unit."""
    w = piece.encode().lower().split()
    return (xxhash.xxh3_128_intdigest(b" ".join(w)), len(w)) if len(w) >= min_words else (0, len(w))


def _keyed(docs: DataFrame, rank: str) -> DataFrame:
    """(doc_id, text_key, rank, text) of the rows that have an id."""
    last = F.lit((1 << 63) - 1)
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col(rank).cast("long"), last).alias("rank"), "text")


def units(text: str | None, min_words: int = 1) -> list[tuple[int, int, int, int, int, int]]:
    """(128-bit hash, words, start, end, ordinal, line) of the hashed units; line: 1 for a whole line, else 0.

    Ordinals count the hashed sentences of the text; a line of several has the ordinal of its first one and line 2,
    a line that is one sentence is both (line 1).
    """
    out, at, ordinal = [], 0, 0
    for line in (text or "").split("\n"):
        pieces = _PIECE.findall(line)
        if len(pieces) == 1:
            h, n = _digest(line, min_words)
            if n >= min_words:
                out.append((h, n, at, at + len(line), ordinal, 1))
                ordinal += 1
        elif pieces:
            h, n = _digest(line, min_words)
            if n >= min_words:
                out.append((h, n, at, at + len(line), ordinal, 2))
            start = at
            for piece in pieces:
                h, n = _digest(piece, min_words)
                if n >= min_words:
                    out.append((h, n, start, start + len(piece), ordinal, 0))
                    ordinal += 1
                start += len(piece)
        at += len(line) + 1
    return out


def _hashes(found: list[tuple]) -> np.ndarray:
    return np.fromiter((u[0] & 0xFFFFFFFFFFFFFFFF for u in found), np.uint64, len(found))


def repeats(docs: DataFrame, rank: str = "doc_id", min_words: int = 1) -> DataFrame:
    """(doc_id, text_key, start, end, words, ordinal, line, keep_doc_id): units of docs (doc_id, text) that occur earlier."""
    spark = docs.sparkSession
    docs = _keyed(docs, rank)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=SLICE):
            parts = [_hashes(units(t, min_words)) for t in batch.column(3).to_pylist()]
            value, times = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])

    twice = written(docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    held = spark.sparkContext.broadcast(bitmap.build(twice, "h", twice.count()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=SLICE):
            cols: list[list] = [[] for _ in range(10)]
            for doc, key, rank, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                found = units(text, min_words)
                for i in np.flatnonzero(bitmap.passes(held.value, _hashes(found))).tolist():
                    h, n, start, end, ordinal, line = found[i]
                    for c, v in zip(cols, (doc, key, rank, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), n, start, end, ordinal, line), strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*ROW, "rank", "d1", "d2", "words", "start", "end", "ordinal", "line"])

    found = written(docs.mapInArrow(of, "doc_id long, text_key long, rank long, d1 long, d2 long, words int, start int, end int, ordinal int, line int"))
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("rank", *ROW, "start", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written, so that both sides of the join are shuffled for it and Spark can split a very common unit.
    first = written(first.select("d1", "d2", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.text_key").alias("keep_key"), F.col("first.start").alias("keep_start")))
    return found.join(first, ["d1", "d2"]).where("doc_id <> keep_doc_id or text_key <> keep_key or start <> keep_start").select(
        *ROW, "start", "end", "words", "ordinal", "line", "keep_doc_id").distinct()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, np.uint64))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, start, end in code points) of all words; characters of scripts without blanks are words."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    b = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    if not len(b):
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    space = (b == 32) | ((b >= 9) & (b <= 13))
    nxt = np.append(b[1:], np.uint8(0))
    wide = (b == 0xF0) & (nxt >= 0xA0) & (nxt <= 0xAF)  # ideographs of four bytes
    three = ((b >= 0xE3) & (b <= 0xE9)) | ((b == 0xE0) & (nxt >= 0xB8) & (nxt <= 0xBB)) | ((b == 0xE1) & (((nxt >= 0x80) & (nxt <= 0x82)) | (nxt == 0x9E) | (nxt == 0x9F)))
    begins = np.zeros(len(b) + 5, bool)
    begins[0] = True
    begins[1 : len(b)] = space[1:] != space[:-1]
    for lead, n in ((np.flatnonzero(three), 3), (np.flatnonzero(wide), 4)):
        begins[lead] = begins[lead + n] = True
    at = np.flatnonzero(begins[: len(b)])
    end = np.append(at[1:], len(b))
    inside = np.arange(len(b)) - np.repeat(at, end - at)
    h = _mixed(np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * _powers(0x9E3779B97F4A7C15, int(inside.max()) + 1)[inside], at))
    word = ~space[at]
    h, at, end = h[word], at[word], end[word]
    text = np.searchsorted(base, at, "right") - 1
    before = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return h, text, before[at] - before[base[text]], before[end] - before[base[text]]


def fingerprints(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, second hash) of the windows taken from the words of texts."""
    if len(h) < PASSAGE_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    n, by = len(h) - GRAM + 1, _powers(0xD6E8FEB86659FD93, GRAM)
    whole = np.zeros(n, np.uint64)
    for j in range(GRAM):
        whole += h[j : j + n] * by[j]
    whole = _mixed(whole)
    least = np.lib.stride_tricks.sliding_window_view(whole, WIDE).argmin(1) + np.arange(n - WIDE + 1)
    taken = np.unique(least[text[: len(least)] == text[PASSAGE_WORDS - 1 :]])
    again = _mixed(h ^ np.uint64(0xA0761D6478BD642F))
    second = (again[taken[:, None] + np.arange(GRAM)] * _powers(0xE7037ED1A0B428DB, GRAM)).sum(1, dtype=np.uint64)
    return taken, whole[taken], _mixed(second)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def _ids(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    """doc_id, text_key and rank of the rows."""
    return [batch.column(i).take(pa.array(rows)) for i in range(3)]


def passages(docs: DataFrame, rank: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, start, end, keep_doc_id): stretches of PASSAGE_WORDS words or more that occur earlier."""
    spark = docs.sparkSession
    docs = _keyed(docs, rank)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=SLICE):
            h, text, _, _ = tokens(_texts(batch))
            value, times = np.unique(fingerprints(h, text)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])

    twice = written(docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    held = spark.sparkContext.broadcast(bitmap.build(twice, "h", twice.count()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=SLICE):
            h, text, start, end = tokens(_texts(batch))
            at, d1, d2 = fingerprints(h, text)
            may = bitmap.passes(held.value, d1)
            at, d1, d2 = at[may], d1[may], d2[may]
            place = at - np.searchsorted(text, text[at])
            yield pa.RecordBatch.from_arrays(
                [*_ids(batch, text[at]), *[pa.array(x) for x in (d1.view(np.int64), d2.view(np.int64), place.astype(np.int32), start[at].astype(np.int32), end[at + GRAM - 1].astype(np.int32))]],
                [*ROW, "rank", "d1", "d2", "at", "start", "end"])

    found = written(docs.mapInArrow(of, "doc_id long, text_key long, rank long, d1 long, d2 long, at int, start int, end int"))
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("rank", *ROW, "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written, so that both sides of the join are shuffled for it and Spark can split a very common window.
    first = written(first.select("d1", "d2", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.text_key").alias("keep_key"), F.col("first.at").alias("keep_at")))
    # Within one text, a window that overlaps its own first occurrence stays, as that one would go with it.
    hits = found.join(first, ["d1", "d2"]).where(f"doc_id <> keep_doc_id or text_key <> keep_key or at >= keep_at + {GRAM}").select(*ROW, "at", "start", "end", "keep_doc_id", "keep_key", "keep_at").distinct()
    by_doc = Window.partitionBy(*ROW).orderBy("at", "start", "keep_doc_id", "keep_key", "keep_at")  # the repeats of one text
    hits = hits.withColumn("new", F.when(F.col("at") <= F.lag("at").over(by_doc) + GRAM, 0).otherwise(1))
    run = Window.partitionBy(*ROW, "run")
    hits = written(hits.withColumn("run", F.sum("new").over(by_doc)).withColumn("lo", F.min("at").over(run)).withColumn("hi", F.max("at").over(run)))
    grown = _grown(docs, hits).groupBy(*ROW, "run").agg(
        F.min(F.when(F.col("side") == 0, F.struct("word", "char"))).alias("left"), F.max(F.when(F.col("side") == 1, F.struct("word", "char"))).alias("right"))
    runs = hits.groupBy(*ROW, "run").agg(F.min(F.struct("at", "start")).alias("first"), F.max(F.struct("at", "end")).alias("last"), F.collect_set("keep_doc_id").alias("keep"))  # of one text
    runs = runs.join(grown, [*ROW, "run"], "left")
    words = F.coalesce("right.word", F.col("last.at") + GRAM) - F.coalesce("left.word", "first.at")
    return runs.where(words >= PASSAGE_WORDS).select(*ROW, F.coalesce("left.char", "first.start").alias("start"), F.coalesce("right.char", "last.end").alias("end"), F.explode("keep").alias("keep_doc_id"))


def _grown(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, text_key, run, side, word, char): how far the ends of runs grow beyond their outer windows.

    side 0: the first word, and where it begins; side 1: the word behind the last one, and where that one ends. Windows
    of one end that lie on one diagonal with one earlier text grow alike: the outermost of them stands for all.
    """
    kept = ["keep_doc_id", "keep_key"]
    diagonal = (F.col("at") - F.col("keep_at")).alias("diagonal")
    end = lambda side, near, outermost: hits.where(near).groupBy(*ROW, "run", *kept, diagonal).agg(outermost("at").alias("at")).withColumn("side", F.lit(side))
    ends = end(0, f"at < lo + {WIDE - 1}", F.min).union(end(1, f"at > hi - {WIDE - 1}", F.max))
    ends = written(ends.withColumn("keep_at", F.col("at") - F.col("diagonal")).drop("diagonal"))
    asked = ends.select(*ROW, "at", "side").union(ends.select(*kept, "keep_at", "side")).distinct()
    asked = written(asked.groupBy(*ROW).agg(F.collect_list(F.struct("at", "side")).alias("asked")))  # of one text
    few = docs.join(checked_broadcast(asked.select(*ROW), asked.count(), 500_000), ROW, "left_semi").dropDuplicates(ROW)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to WIDE - 1 words beside each place, from it outwards: hashes of 32 bits and where each begins (side 0) or ends."""
        for batch in sliced(batches, size=SLICE):
            h, text, start, end = tokens(_texts(batch))
            list_ = batch.column(batch.schema.get_field_index("asked"))
            of = np.repeat(np.arange(batch.num_rows), list_.value_lengths().to_numpy())
            at, side = (list_.flatten().field(i).to_numpy() for i in (0, 1))
            first = np.searchsorted(text, of)
            step = np.arange(WIDE - 1)
            word = (first + at)[:, None] + np.where(side[:, None] == 1, GRAM + step, -1 - step)
            there = (word >= 0) & (word < len(h))
            word = np.where(there, word, 0)
            there &= (text[word] if len(h) else word) == of[:, None]
            size = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
            word = word[there]
            char = np.where(np.repeat(side, np.diff(size)) == 1, end[word], start[word])
            lists = [pa.ListArray.from_arrays(pa.array(size), pa.array(x)) for x in (h[word].astype(np.uint32).view(np.int32), char.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(of)) for i in (0, 1)], pa.array(at.astype(np.int32)), pa.array(side.astype(np.int32)), *lists], [*ROW, "at", "side", "words", "chars"])

    near = written(few.join(asked, ROW).select(*ROW, "text", "asked").mapInArrow(beside, "doc_id long, text_key long, at int, side int, words array<int>, chars array<int>"))
    other = near.select(F.col("doc_id").alias("keep_doc_id"), F.col("text_key").alias("keep_key"), F.col("at").alias("keep_at"), "side", F.col("words").alias("kept_words"))
    both = ends.join(near, [*ROW, "at", "side"]).join(other, [*kept, "keep_at", "side"])
    alike = F.zip_with("words", "kept_words", lambda x, y: F.coalesce(x == y, F.lit(False)))
    unlike = F.array_position(alike, F.lit(False)).cast("int")
    more = F.when(unlike == 0, F.size(alike)).otherwise(unlike - 1)
    # Within one text neither occurrence grows into the other.
    own = (F.col("doc_id") == F.col("keep_doc_id")) & (F.col("text_key") == F.col("keep_key"))
    more = F.when(own, F.least(more, F.greatest(F.col("at") - F.col("keep_at") - GRAM, F.lit(0)))).otherwise(more)
    both = both.withColumn("more", more.cast("int")).where("more > 0")
    return both.select(*ROW, "run", "side", F.when(F.col("side") == 0, F.col("at") - F.col("more")).otherwise(F.col("at") + GRAM + F.col("more")).alias("word"), F.get("chars", F.col("more") - 1).alias("char"))


def _spans(docs: DataFrame, rank: str, min_words: int, run_words: int) -> DataFrame:
    """spans() with text_key."""
    by_doc = Window.partitionBy(*ROW)  # the repeats of one text
    dup = repeats(docs, rank, min_words)
    sentences = dup.where("line < 2").withColumn("run", F.col("ordinal") - F.row_number().over(by_doc.orderBy("ordinal")))
    sentences = sentences.withColumn("run_words", F.sum("words").over(Window.partitionBy(*ROW, "run")))
    place = [*ROW, "start", "end", "keep_doc_id"]
    gone = sentences.where((F.col("run_words") >= run_words) | (F.col("line") == 1)).select(*place).union(dup.where("line = 2").select(*place)).union(passages(docs, rank).select(*place))
    # Stretches that touch or overlap, but for a line end between them, are one.
    before = F.max("end").over(by_doc.orderBy("start", "end", "keep_doc_id").rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("new", F.when(F.col("start") <= before + 1, 0).otherwise(1))
    gone = gone.withColumn("island", F.sum("new").over(by_doc.orderBy("start", "end", "keep_doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    return gone.groupBy(*ROW, "island").agg(
        F.min("start").cast("long").alias("span_start"), F.max("end").cast("long").alias("span_end"), F.count("*").alias("n_units"),
        F.array_sort(F.collect_set("keep_doc_id")).alias("kept_in")).drop("island")


def spans(docs: DataFrame, rank: str = "doc_id", min_words: int = 1, run_words: int = 1) -> DataFrame:
    """(doc_id, span_start, span_end, n_units, kept_in): stretches to remove, in code points; kept_in: where they stay."""
    return _spans(docs, rank, min_words, run_words).drop("text_key")


def removed(docs: DataFrame, rank: str = "doc_id", min_words: int = 1, run_words: int = 1) -> DataFrame:
    """docs with the spans cut out of text, and n_chars, if there, set anew; every row stays."""
    cuts = _spans(docs.select(*dict.fromkeys(["doc_id", rank, "text"])), rank, min_words, run_words).groupBy(*ROW).agg(
        F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("__cuts"))  # of one text
    cuts = written(cuts.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}))
    rows = docs.join(checked_broadcast(cuts, cuts.count(), 100_000), (docs.doc_id == F.col("__id")) & (F.xxhash64(docs.text) == F.col("__key")), "left")
    c, t = F.col("__cuts"), F.col("text")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(c, i - 1)["span_end"])
    end = lambda i: F.when(i == F.size(c), F.length(t)).otherwise(F.get(c, i)["span_start"])
    left = F.array_join(F.transform(F.sequence(F.lit(0), F.size(c)), lambda i: F.substring(t, (start(i) + 1).cast("int"), (end(i) - start(i)).cast("int"))), "")
    rows = rows.withColumn("text", F.when(c.isNull() | t.isNull(), t).otherwise(left))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(c.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
