"""Periodic runs of words: longest common extensions over a difference cover, on a harmonic grid of places.

Two places i and i + q of a text extend each other as far as the words there agree. A run of period q is a zone of places
i with word i = word i + q; if the zone is at least `stride` long, it holds a multiple of `stride`, so only those places
are asked: all periods together ask n log n times. Most places differ within few words. The others need the suffix
structure: only suffixes at places of a difference cover are sorted; two suffixes compare words until both are at such
places, less than MOD words on, and a sparse table over the sorted ones' common prefixes gives the rest.

Texts of an Arrow batch are laid out in one array of word numbers, an own number behind each text, so that nothing
extends past an end. All steps work on arrays; the grid is asked in pieces of GRID places, which bounds memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

#: Differences of these residues give every residue: whatever i and j are, one shift below MOD takes both into the cover.
MOD, COVER = 13, (0, 1, 3, 9)

#: Places asked at once.
GRID = 1 << 19


def _shifts() -> np.ndarray:
    """[i mod MOD, j mod MOD]: the least shift after which both are in the cover."""
    inside = np.isin(np.arange(2 * MOD) % MOD, COVER)
    return np.array([[next(d for d in range(MOD) if inside[i + d] and inside[j + d]) for j in range(MOD)] for i in range(MOD)])


SHIFTS = _shifts()


def agree(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """How many words from i and from j on are equal, up to most; the last word of w must occur once."""
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    most = np.broadcast_to(most, len(i))
    k = 0
    while len(live):
        live = live[most[live] > k]
        a, b = i[live] + k, j[live] + k
        inside = b < len(w)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[w[a] == w[b]]
        k += 1
        out[live] = k
    return out


class Extensions:
    """Longest common extensions to the right, of any two places of w; w's last word must occur nowhere else."""

    def __init__(self, w: np.ndarray):
        self.w = w
        n = len(w)
        places = np.flatnonzero(np.isin(np.arange(n) % MOD, COVER))
        self.of = np.full(n + 1, -1, np.int64)  # a place's number among the sampled ones
        self.of[places] = np.arange(len(places))
        levels, step = [self._blocks(w, places)], MOD
        while levels[-1].max(initial=-1) + 1 < len(places):  # a round doubles the length by which suffixes are sorted
            r = levels[-1]
            behind = places + step
            second = np.where(behind < n, r[self.of[np.minimum(behind, n)]], -1)
            levels.append(self._ranks((second + 1) + (r + 1) * (len(places) + 2)))
            step *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        a, b = places[order[:-1]], places[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in reversed(range(len(levels))):
            r, step = levels[k], MOD << k
            x, y = a + common, b + common
            ok = (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            same[ok] = r[self.of[x[ok]]] == r[self.of[y[ok]]]
            common += np.where(same, step, 0)
        common += agree(w, a + common, b + common, MOD)
        self.least = [common]  # least[k][i]: the least of common[i : i + 2 ** k]
        while 2 << (len(self.least) - 1) <= len(common):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _ranks(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.int64)

    def _blocks(self, w: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ranks of the sampled suffixes by their first MOD words; several words share a key."""
        padded = np.concatenate([w + 1, np.zeros(MOD, np.int64)])
        bits = max(1, int(padded.max()).bit_length())
        per = max(1, 62 // bits)
        rank = np.zeros(len(places), np.int64)
        for k in range(0, MOD, per):
            key = np.zeros(len(places), np.int64)
            for d in range(k, min(k + per, MOD)):
                key = (key << bits) | padded[places + d]
            key = self._ranks(key)
            rank = self._ranks(rank * (key.max(initial=0) + 1) + key)
        return rank

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFTS[i % MOD, j % MOD]
        out = agree(self.w, i, j, shift)
        n = len(self.w)
        far = np.flatnonzero((out == shift) & (np.maximum(i, j) + shift < n) & (i != j))
        a, b = self.rank[self.of[i[far] + shift[far]]], self.rank[self.of[j[far] + shift[far]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            t = self.least[k]
            out[far[at]] += np.minimum(t[lo[at]], t[hi[at] - (1 << int(k))])
        return out


def _grid(lengths: np.ndarray, starts: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) to ask, in pieces: for each period the multiples of the least length of a zone."""
    texts = np.flatnonzero(lengths >= max(least, times))
    most = lengths[texts] // times
    for at in _pieces(most, GRID):
        text = np.repeat(texts[at], most[at])
        q = np.arange(len(text)) - np.repeat(np.cumsum(most[at]) - most[at], most[at]) + 1
        stride = np.maximum(least - q, (times - 1) * q)
        n = (lengths[text] - q + stride - 1) // stride
        for part in _pieces(n, GRID):
            m = n[part]
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            t, p = np.repeat(text[part], m), np.repeat(q[part], m)
            yield t, starts[t] + k * np.repeat(stride[part], m), p


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to most or little more."""
    if not len(sizes):
        return
    part = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(sizes)], strict=True):
        yield slice(lo, hi)


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run of every text, by text, start and period.

    words: the word numbers of all texts, one behind the other. A run is a stretch of consecutive words whose smallest
    period is q, of at least `least` words and `times` periods, that no neighbouring word extends.
    """
    n = len(lengths)
    w = np.empty(len(words) + n, np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    w[ends] = words.max(initial=-1) + 1 + np.arange(n)
    w[np.delete(np.arange(len(w)), ends)] = words
    back = w[::-1].copy()
    found = []
    open_ones: list[tuple[np.ndarray, ...]] = []
    for t, i, q in _grid(lengths, starts, least, times):
        at = np.flatnonzero(w[i] == w[i + q])
        t, i, q = t[at], i[at], q[at]
        ahead = agree(w, i, i + q, MOD)
        behind = _behind(back, i, q, t, starts, lambda x, y: agree(back, x, y, MOD))
        decided = (ahead < MOD) & (behind < MOD)
        found.append((t[decided], (i - behind)[decided], (ahead + behind)[decided], q[decided]))
        open_ones.append((t[~decided], i[~decided], q[~decided]))
    if open_ones and sum(len(x[0]) for x in open_ones):
        found += _far(w, starts, ends, open_ones)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    t, start, zone, q = (np.concatenate(x) for x in zip(*found, strict=True))
    length = zone + q
    ok = length >= np.maximum(least, times * q)
    t, start, length, q = t[ok], start[ok] - starts[t[ok]], length[ok], q[ok]
    order = np.lexsort((q, length, start, t))  # of the periods of one stretch the smallest counts; the others are its multiples
    t, start, length, q = t[order], start[order], length[order], q[order]
    first = np.ones(len(t), bool)
    first[1:] = (np.diff(t) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    t, start, length, q = t[first], start[first], length[first], q[first]
    order = np.lexsort((q, start, t))
    return t[order], start[order], length[order], q[order]


def _behind(back: np.ndarray, i: np.ndarray, q: np.ndarray, t: np.ndarray, starts: np.ndarray, ask) -> np.ndarray:
    """How many words before i and before i + q are equal; none before a text's start."""
    out = np.zeros(len(i), np.int64)
    at = np.flatnonzero(i > starts[t])
    last = len(back) - 1
    # Before a text stands another's end; it occurs once, so words agree up to the start at most.
    out[at] = ask(last - (i[at] + q[at] - 1), last - (i[at] - 1))
    return out


def _far(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, asked: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Zones that a few words don't bound; suffixes of the texts concerned are sorted, forwards and backwards."""
    texts = np.unique(np.concatenate([x[0] for x in asked]))
    sizes = ends[texts] - starts[texts] + 1
    base = np.cumsum(sizes) - sizes  # where these texts start among themselves
    short = w[np.repeat(starts[texts] - base, sizes) + np.arange(sizes.sum())]
    short = np.unique(short, return_inverse=True)[1].reshape(-1).astype(np.int64)
    back = short[::-1].copy()
    right = Extensions(short)
    left = Extensions(np.append(back, back.max() + 1))
    for t, i, q in asked:
        k = np.searchsorted(texts, t)
        j = i - starts[t] + base[k]
        ahead = right(j, j + q)
        behind = _behind(back, j, q, k, base, left)
        yield t, i - behind, ahead + behind, q


def _words(text: str | None, doc_id: int | None, planted: bool) -> list[bytes]:
    """The words of a text; where planted, some texts go on periodically from some word on, as the contract of the query has it."""
    out = (text or "").encode("utf-8", "surrogatepass").split()  # blanks: space and \t to \r
    if planted and out and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(out)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out = out[:a] + (out[a : a + p] * ((n - a) // p + 1))[: n - a]
    return out


def _digest(runs: list[tuple[int, int, int]], words: list[bytes]) -> tuple:
    """The columns of a text, from its runs (start, length, period) in order."""
    drop = np.zeros(len(words) + 1, np.int64)
    for s, m, q in runs:
        drop[s + q] += 1
        drop[s + m] -= 1
    kept = words if not runs else [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _batches(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[tuple[list, list[list[bytes]], list[list[tuple[int, int, int]]]]]:
    """(ids, words, runs) of every slice of the batches."""
    for batch in sliced(batches):
        ids = batch.column("doc_id").to_pylist()
        texts = [_words(t, i, planted) for t, i in zip(batch.column("text").to_pylist(), ids, strict=True)]
        numbers: dict[bytes, int] = {}
        words = np.array([numbers.setdefault(x, len(numbers)) for t in texts for x in t], np.int64)
        of, start, length, period = find_runs(words, np.array([len(t) for t in texts], np.int64))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for t, s, m, q in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
            runs[t].append((s, m, q))
        yield ids, texts, runs


def runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, start, length, period): a row for each run of each text.

    Null and empty texts and texts of fewer than 24 words have none. Rows that share an id or a text are treated alike,
    each for itself; other columns are ignored.
    """
    def found(batches):
        for ids, _, per in _batches(batches, planted):
            rows = [(i, *r) for i, rs in zip(ids, per, strict=True) for r in rs]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """docs with the texts' runs cut to their first period; the words kept are joined by one space. Texts without runs stay as they are."""
    schema = docs.schema

    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            numbers: dict[bytes, int] = {}
            split = [_words(t, None, False) for t in texts]
            words = np.array([numbers.setdefault(x, len(numbers)) for t in split for x in t], np.int64)
            of, start, length, period = find_runs(words, np.array([len(t) for t in split], np.int64))
            drop: dict[int, np.ndarray] = {}
            for t, s, m, q in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
                drop.setdefault(t, np.zeros(len(split[t]), bool))[s + q : s + m] = True
            for t, gone in drop.items():
                texts[t] = b" ".join(split[t][k] for k in np.flatnonzero(~gone)).decode("utf-8", "surrogatepass")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(lambda b: cut(sliced(b)), schema)


DIGESTS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame, planted: bool = False) -> DataFrame:
    """A row for each row of docs: its runs' number, the run with most periods, hashes of the list of runs and of the text without repeats."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def scored(batches):
        for ids, texts, per in _batches(batches, planted):
            rows = [(i, len(t), *_digest(r, t)) for i, t, r in zip(ids, texts, per, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k > 6 else pa.int64()) for k in range(len(names))], names)

    return docs.select("doc_id", "text").mapInArrow(scored, DIGESTS)
