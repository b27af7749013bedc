"""Byte-level BPE: vectorised pre-tokenisation by an automaton's scan, cached pair merging, decoding by offsets.

Code points become symbols (letter, number, other, kinds of white space, apostrophes that open a contraction); each
symbol is a function from state to state. Functions compose associatively, so a scan over blocks, many texts at once,
gives the state before every character without a loop over characters and without regular expressions. Where a piece
begins follows from state and symbol. Pieces are merged by rank once and then taken from a bounded cache.

Defined cases: a null text is encoded as an empty one: no ids; equal texts get equal ids; an empty table gives an empty
result; other columns pass through, but ids, offsets (and decoded) are set by this operator.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced, trim

#: Symbols; RESET stands between texts. Blanks: BLANK is the last white space before a piece and U+0020, which joins it;
#: SPACE is any other last white space before a piece; MID is white space before white space or the end.
LETTER, NUMBER, OTHER, MID, BLANK, SPACE, SHORT, LONG, RESET = range(9)

#: States: CLOSED (nothing to go on with), in a run of letters, numbers, others or white space, after a joining blank,
#: one or two letters before the end of a contraction.
CLOSED, IN_L, IN_N, IN_O, IN_W, JOIN, LAST1, LAST2 = range(8)

#: Texts are scanned together up to so many characters; entries of each of two generations of the cache.
CHUNK, CACHED = 200_000, 150_000

#: Unicode's White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins here)."""
    if symbol == RESET:
        return CLOSED, False
    if symbol == MID:
        return IN_W, state != IN_W
    if symbol in (BLANK, SPACE):
        return (JOIN if symbol == BLANK else CLOSED), True
    if state in (LAST1, LAST2):
        return (CLOSED if state == LAST1 else LAST1), False
    if symbol in (SHORT, LONG) and state not in (IN_O, JOIN):
        return (LAST1 if symbol == SHORT else LAST2), True
    run = {LETTER: IN_L, NUMBER: IN_N}.get(symbol, IN_O)
    return run, state not in (run, JOIN)


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(product, effect, function of each symbol, begins), flat: product[256 * f + g] is 256 times the number of f, then g;
    effect[8 * f + state] the state after f; begins[16 * state + symbol] whether a piece begins."""
    base = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    found = {tuple(range(8)): 0}  # the identity is 0
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    all_f = list(found)
    k = len(all_f)
    assert k <= 256, "functions are numbered in steps of 256"
    product = np.zeros((k, 256), np.intp)
    product[:, :k] = [[found[tuple(g[x] for x in f)] << 8 for g in all_f] for f in all_f]
    begins = np.zeros((8, 16), bool)
    begins[:, :9] = [[_step(s, c)[1] for c in range(9)] for s in range(8)]
    return product.ravel(), np.array(all_f, np.intp).ravel(), np.array([found[b] for b in base], np.intp), begins.ravel()


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or MID for each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[_WHITE] = MID
    return kinds


def _scan(f: np.ndarray, product: np.ndarray, effect: np.ndarray) -> np.ndarray:
    """The state before each place: products within blocks, for all blocks at once; then through the blocks in order."""
    n, width = len(f), 64
    rows = -(-n // width)
    block = np.zeros(rows * width, np.intp)
    block[:n] = f
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    before = np.empty_like(block)
    now = np.zeros(rows, np.intp)
    for j in range(width):
        before[j] = now
        now = product.take(now + block[j])
    whole = now >> 8
    if rows > width:
        start = _scan(whole, product, effect)
    else:
        start, state = np.zeros(rows, np.intp), CLOSED
        for i, g in enumerate(whole.tolist()):
            start[i] = state
            state = int(effect[8 * g + state])
    before >>= 5
    before += start[None, :]
    return effect.take(before).T.ravel()[:n]


def piece_starts(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Places at which pieces begin; points: code points of texts with one more at each of resets (behind every text)."""
    product, effect, of_symbol, begins = _automaton()
    symbol = _classes()[points]
    symbol[resets] = RESET
    white = symbol == MID
    goes_on = np.zeros(len(points), bool)
    goes_on[:-1] = ~white[1:] & (symbol[1:] != RESET)
    last = white & goes_on
    symbol[last] = np.where(points[last] == 0x20, BLANK, SPACE)
    at = np.flatnonzero(points == 0x27)
    at = at[at + 1 < len(points)]
    if len(at):
        one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        inside = symbol[at + 1] == LETTER
        is_in = lambda x, chars: np.isin(x, [ord(c) for c in chars])
        symbol[at[inside & is_in(one, "stmd")]] = SHORT
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbol[at[inside & pair]] = LONG
    state = _scan(of_symbol.take(symbol), product, effect)
    return np.flatnonzero(begins.take((state << 4) + symbol))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of least rank, leftmost first, is merged until none is left; O(n log n)."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 48:  # short: a list of the pairs' ranks, searched whole
        parts = [piece[i : i + 1] for i in range(n)]
        none = 1 << 60
        pair = [ranks.get(piece[i : i + 2], none) for i in range(n - 1)]
        while pair and (least := min(pair)) < none:
            at = pair.index(least)
            parts[at] += parts.pop(at + 1)
            del pair[at]
            if at < len(pair):
                pair[at] = ranks.get(parts[at] + parts[at + 1], none)
            if at:
                pair[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        return [ranks[p] for p in parts]
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # the part from i goes to end[i]; the one before starts at back[i]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != to or not alive[j]:
            continue
        alive[j], end[i] = False, to
        if to < n:
            back[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (b := back[i]) >= 0 and (r := ranks.get(piece[b:to])) is not None:
            heapq.heappush(heap, (r, b, to))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes lists of texts; piece -> packed ids in two generations of a cache, so memory is bounded."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.new, self.old = ranks, {}, {}
        self.size = np.zeros(max(ranks.values()) + 1, np.int32)
        for b, i in ranks.items():
            self.size[i] = len(b)

    def miss(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(merge(piece.encode(), self.ranks), np.int32).tobytes()
        if len(piece) <= 64:
            if len(self.new) >= CACHED:
                self.old, self.new = self.new, {}
            self.new[piece] = ids
        return ids

    def _chunk(self, texts: list[str]) -> Iterator[np.ndarray]:
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes)
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, ends - 1)
        cut = np.searchsorted(starts, ends)
        first = 0
        for last, begin, end in zip(cut.tolist(), (ends - sizes).tolist(), (ends - 1).tolist(), strict=True):
            at = [*starts[first:last].tolist(), end]
            pieces = [whole[a:b] for a, b in zip(at, at[1:], strict=False)]
            known = self.new.get
            packed = [known(p) or self.miss(p) for p in pieces]
            yield np.frombuffer(b"".join(packed), np.int32)
            first = last

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        chunk, held = [], 0
        for t in texts:
            chunk.append(t)
            held += len(t)
            if held > CHUNK:
                yield from self._chunk(chunk)
                chunk, held = [], 0
        if chunk:
            yield from self._chunk(chunk)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of the bytes and the rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Decoder:
    """Bytes of ids, each put where its offset says."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = np.full(max(ranks.values()) + 1, -1, np.int64)
        for b, i in ranks.items():
            self.size[i] = len(b)
        at = np.cumsum(np.maximum(self.size, 0))
        self.first = at - np.maximum(self.size, 0)
        self.bytes = np.empty(int(at[-1]), np.uint8)
        for b, i in ranks.items():
            self.bytes[self.first[i] : self.first[i] + len(b)] = np.frombuffer(b, np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, bytes of each row): ids and their offsets, of which rows says how many each row has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        row = np.repeat(np.arange(len(rows)), rows)
        length = np.zeros(len(rows), np.int64)
        np.maximum.at(length, row, offsets + size)
        start = np.cumsum(length) - length
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros(int(length.sum()), np.uint8)
        out[np.repeat(start[row] + offsets, size) + inside] = self.bytes[np.repeat(self.first[ids], size) + inside]
        return out, length

    def texts(self, ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> pa.Array:
        whole, length = self.decode(ids, offsets, rows)
        cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(whole)])


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs without text but with ids (array of int) and offsets (array of int: where each id's bytes begin)."""
    return _encoded(docs, path, text, False)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass: docs without text but with ids, offsets and decoded, the bytes of the ids at their offsets."""
    return _encoded(docs, path, text, True)


def _encoded(docs: DataFrame, path: str, text: str, decoded: bool) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # one vocabulary file
    more = ["ids", "offsets", *["decoded"] * decoded]
    kept = [c for c in docs.columns if c not in (text, *more)]
    kind = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.BinaryType() if c == "decoded" else T.ArrayType(T.IntegerType(), False)) for c in more])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(ranks.value), Decoder(ranks.value) if decoded else None
        for part in sliced(batches, 512):
            ids = list(encoder.encode([t or "" for t in part.column(len(kept)).to_pylist()]))
            rows = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            size = encoder.size[flat]
            total = np.cumsum(size, dtype=np.int64) - size
            offsets = total - np.repeat(total[np.minimum(ends[:-1], max(len(total) - 1, 0))] if len(total) else np.zeros(len(ids), np.int64), rows)
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (flat, offsets)]
            if decoder:
                made.append(decoder.texts(flat, offsets, rows))
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + made, [*kept, *more])
        del encoder, decoder
        trim()

    return docs.select(*kept, text).mapInArrow(of, kind)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with one more column, decoded: the bytes of ids at their offsets; an id outside the vocabulary is an error."""
    return decode_range(encoded, path, 0, None)


def decode_range(encoded: DataFrame, path: str, start: int, end: int | None) -> DataFrame:
    """encoded with one more column, decoded: the bytes from start to end (None: the text's end) of each text.

    Offsets tell which ids reach into the range; only those are decoded. Null ids have no bytes.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = [c for c in encoded.columns if c != "decoded"]
    kind = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("decoded", T.BinaryType())])
    at_ids, at_offsets = kept.index("ids"), kept.index("offsets")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(ranks.value)
        for batch in sliced(batches, 512):
            rows = batch.column(at_ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, offsets = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (at_ids, at_offsets))
            if start > 0 or end is not None:
                ends = offsets + decoder.size[ids]
                asked = (ends > start) & (offsets < (end if end is not None else np.inf))
                row = np.repeat(np.arange(len(rows)), rows)[asked]
                rows = np.bincount(row, minlength=len(rows))
                ids, offsets = ids[asked], offsets[asked]
                base = np.zeros(len(rows), np.int64)  # the first id asked for begins at or before start
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
                base[row[first]] = offsets[first]
                whole, length = decoder.decode(ids, offsets - base[row], rows)
                cuts = np.cumsum(length) - length
                texts = [whole[c + max(0, start - b) : c + (n if end is None else max(0, min(n, end - b)))].tobytes() for c, b, n in zip(cuts.tolist(), base.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.binary())], [*kept, "decoded"])
                continue
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), decoder.texts(ids, offsets, rows)], [*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(of, kind)
