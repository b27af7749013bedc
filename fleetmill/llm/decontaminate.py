"""Benchmark decontamination by spaced seeds: masks over word windows ignore some places, so substitutions survive.

Windows of test items and of training texts are hashed at the places of each mask. A text's windows first meet a
bounded Bloom filter of the items' hashes; those that pass form islands: the text's words from the length of the
longest item before their first hit to as much behind their last. Equal islands are one passage, however many texts
share it. Passages are joined with the items on (mask, hash); for each joined diagonal, passage and item are laid side
by side: the longest stretch in which at least AGREE of PART words agree is an overlap if it has LEAST words (or is the
whole of a shorter item). Equal items are verified once.

MASKS find 0.997 or more of all placements of the substitutions that an overlap of LEAST words or more may have, at
any length (enumerated in the tests). A shorter item is sought with masks made for its length, which find all.

Defined cases: null or blank texts and items have no windows; repeated rows each count, rows that share an id but not
the text are apart in clean(); rows without an id are never reported or dropped; of equally long overlaps the one that
agrees most, then the first in the text, is reported; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import checked_broadcast, sliced, written
from .shingles import window_hashes, word_hashes

#: Fixed masks: 1 counts, 0 is ignored.
MASKS = ("110110011", "1110111", "100101111", "111111")

LEAST, AGREE, PART = 13, 4, 5

_PLACES = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]


@cache
def short_masks(n: int) -> list[tuple[int, ...]]:
    """Places that count, for whole items of n < LEAST words: whichever words may be substituted, one mask ignores them all."""
    lost = n * (PART - AGREE) // PART
    if not lost:
        return [tuple(range(n))]
    cuts = np.linspace(0, n, (5 if lost > 1 else min(n, 4)) + 1).round().astype(int).tolist()
    parts = [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [tuple(i for p in parts if p not in gone for i in p) for gone in combinations(parts, lost)]


def _raw(batch: pa.RecordBatch, i: int) -> list:
    return batch.column(i).cast(pa.binary()).to_pylist()


def seeds(h: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(mask, hash at each place): the masks, then those for short items of the given lengths."""
    for m, places in [*enumerate(_PLACES), *((100 * n + i, p) for n in lengths for i, p in enumerate(short_masks(n)))]:
        yield m, window_hashes(h, places) ^ np.uint64(m)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, mask, h, at): the hashes of every window of the items (item, item_words)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list] = [[], [], [], []]
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.array(words, np.int64).view(np.uint64)
                for m, s in seeds(h, (len(h),) if 0 < len(h) < LEAST else ()):
                    if m >= 100 or len(h) >= LEAST:
                        for c, v in zip(out, ([item] * len(s), [m] * len(s), s.view(np.int64).tolist(), list(range(len(s)))), strict=True):
                            c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], ["item", "mask", "h", "at"])

    return items.mapInArrow(of, "item long, mask int, h long, at int")


def _hit_islands(docs: DataFrame, filtered: np.ndarray, lengths: tuple[int, ...], longest: int) -> DataFrame:
    """(doc_id, text_key, low, k1, k2, words, hits): stretches of a text's word hashes around windows that pass the filter, with their digest."""
    held = docs.sparkSession.sparkContext.broadcast(filtered)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            for doc, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _raw(batch, 2), strict=True):
                h = word_hashes(raw)
                found = []
                for m, s in seeds(h, lengths):
                    at = np.flatnonzero(bitmap.passes(held.value, s))
                    found.append((at, np.full(len(at), m), s[at].view(np.int64)))
                at, mask, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((mask, at))
                at, mask, hashed = at[order], mask[order], hashed[order]
                cuts = [0, *(np.flatnonzero(np.diff(at) > 2 * longest) + 1).tolist(), len(at)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if i < j:
                        low = max(0, int(at[i]) - longest)
                        words = h[low : int(at[j - 1]) + longest]
                        digest = xxhash.xxh3_128_intdigest(words.tobytes())
                        for c, v in zip(out, (doc, key, low, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), words.view(np.int64), [{"at": a, "mask": m, "h": x} for a, m, x in zip((at[i:j] - low).tolist(), mask[i:j].tolist(), hashed[i:j].tolist(), strict=True)]), strict=True):
                            c.append(v)
            hit = pa.list_(pa.struct([("at", pa.int32()), ("mask", pa.int32()), ("h", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), hit)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "text_key", "low", "k1", "k2", "words", "hits"])

    return docs.mapInArrow(of, "doc_id long, text_key long, low int, k1 long, k2 long, words array<long>, hits array<struct<at:int,mask:int,h:long>>")


def longest_overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start, words, agreeing) of the longest stretch of two aligned sequences with AGREE of PART words or more alike."""
    same = a == b
    total = np.concatenate([[0], np.cumsum(np.where(same, PART - AGREE, -AGREE))])
    best = np.maximum.accumulate(total[::-1])[::-1]  # falls from left to right
    ends = len(best) - np.searchsorted(best[::-1], total, side="left") - 1
    i = int(np.argmax(ends - np.arange(len(total))))
    n = int(ends[i] - i)
    return i, n, int(same[i : i + n].sum())


def _overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """overlaps() with text_key, the hash of the text."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    items = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = [word_hashes(r) for r in _raw(batch, 1)]
            key = [xxhash.xxh3_64_intdigest(w.tobytes()) - (1 << 63) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64()))], ["item_id", "item", "item_words"])

    # Equal items are sought once: item is the digest of their words.
    each = written(items.mapInArrow(hashed, "item_id long, item long, item_words array<long>").where("size(item_words) > 0"))
    member = written(each.select("item_id", "item").distinct())
    whole = written(each.groupBy("item").agg(F.first("item_words").alias("item_words")))
    sought = written(item_seeds(whole))
    sizes = whole.select(F.size("item_words").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    lengths = tuple(sorted(r.n for r in sizes.where(F.col("n") < LEAST).distinct().collect()))  # fewer than LEAST
    islands = written(_hit_islands(docs, bitmap.build(sought, "h", sought.count(), per=512), lengths, longest))
    passages = written(islands.groupBy("k1", "k2").agg(F.first("words").alias("words"), F.first("hits").alias("hits")))
    hits = passages.select("k1", "k2", F.explode("hits").alias("x")).select("k1", "k2", F.col("x.mask").alias("mask"), F.col("x.h").alias("h"), F.col("x.at").alias("passage_at"))
    laid = hits.join(sought, ["mask", "h"]).select("k1", "k2", "item", (F.col("passage_at") - F.col("at")).alias("diagonal")).distinct()
    laid = laid.join(whole, "item").join(passages.select("k1", "k2", "words"), ["k1", "k2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = batch.to_pydict()
            out: list[tuple] = []
            for k1, k2, item, diagonal, w, t in zip(*(rows[c] for c in ("k1", "k2", "item", "diagonal", "item_words", "words")), strict=True):
                first, last = max(0, diagonal), min(len(t), diagonal + len(w))
                i, n, agree = longest_overlap(np.array(t[first:last]), np.array(w[first - diagonal : last - diagonal]))
                if n >= min(LEAST, len(w)):
                    out.append((k1, k2, item, first + i, first + i - diagonal, n, agree))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k1", "k2", "item", "at", "item_word", "n_words", "n_agree"])

    found = laid.select("k1", "k2", "item", "diagonal", "item_words", "words").mapInArrow(verify, "k1 long, k2 long, item long, at long, item_word long, n_words long, n_agree long")
    found = written(found.groupBy("k1", "k2", "item").agg(F.max(F.struct("n_words", "n_agree", (-F.col("at")).alias("first"), (-F.col("item_word")).alias("item_first"))).alias("o")).select("k1", "k2", "item", "o.*"))
    placed = islands.select("doc_id", "text_key", "low", "k1", "k2").join(checked_broadcast(found, found.count(), 100_000), ["k1", "k2"])
    best = placed.groupBy("doc_id", "text_key", "item").agg(F.max(F.struct("n_words", "n_agree", (F.col("first") - F.col("low")).alias("first"), "item_first")).alias("o"))
    return best.join(checked_broadcast(member, member.count(), 100_000), "item").select(
        "doc_id", "text_key", "item_id", (-F.col("o.first")).alias("doc_word"), (-F.col("o.item_first")).alias("item_word"), F.col("o.n_words").alias("n_words"), F.col("o.n_agree").alias("n_agree"))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_agree): the longest verified overlap of each leaked item in each row of docs."""
    return _overlaps(docs, items).drop("text_key")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that have a verified overlap with an item."""
    bad = written(_overlaps(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    return docs.join(checked_broadcast(bad, bad.count()), (docs.doc_id == F.col("__id")) & (F.xxhash64(docs.text) == F.col("__key")), "left_anti")
