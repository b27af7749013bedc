"""Similarity join of documents on word n-grams by a grouped prefix join; links, and their components.

Two documents link when their shingle sets have a Jaccard similarity of num/den or more. With any one order of all
shingles, linked sets share one of the first n - ceil(n * num / den) + 1 shingles of each. Steps:

1. Shingles found in many documents are counted (a bounded summary for each task) and ordered last. The order
   decides only how much work there is, never what is found.
2. Each document gets its set's size, digest, prefix and a parity sketch. Equal sets are one class from here on.
3. Classes with the same prefix and size form a group. In each bucket (groups that share a prefix shingle) all are
   compared with the bucket's first member, and in each group all with the group's: links that join most of a
   family of near copies, in a number of comparisons that follows its size.
4. Buckets that still hold more than one component: pairs of their groups are filtered, by sizes and by the bits that
   all or none of a group's sketches have. Only groups of the pairs that are left are expanded, and members in
   different components compared. Pairs in one component need no link for the components: they are reachable already.
   links() and linked() then compare the different sets of each component, block by block within tasks, and so find
   every link between them; only links() makes rows of these.
5. Every comparison is by exact sets. Before it, sizes and sketches rule out what can't reach the threshold: bits in
   which two parity sketches differ are at most the shingles in which the sets differ. A short sketch of fixed length
   goes with the bucket rows, a long one (a bit or more for each shingle) is looked at pair by pair; a sketch of twice
   the length folds to the other's by the exclusive or of its halves.

Defined cases: a null, empty or blank text has no shingles and links with nothing; a text with fewer words than k has
one shingle, the whole sequence; a repeated doc_id with unlike texts gets a row for each; a row without doc_id gets no
component and no number of links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti_by_id, checked_broadcast, semi_by_id, sliced, written
from .graph import components
from .shingles import shingles

#: Longs in a parity sketch; frequent shingles kept by a task and in all; rows of four longs that may be broadcast (16 MB).
SKETCH, TASK_KEEPS, ALL_KEEP, HEADS = 8, 20_000, 50_000, 500_000

#: About the most sets and shingles of a block of a component; shingles whose sharing is counted at once.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 2048


def _raw(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _digest(s: np.ndarray) -> tuple[int, int]:
    """The digest of a set as two longs."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of the most frequent shingles, rarest first: a heavy-hitter summary of each task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        n, parts, held = 0, [], 0

        def flush() -> None:
            nonlocal parts, held, seen
            if parts:
                value, times = np.unique(np.concatenate(parts), return_counts=True)
                for v, t in zip(value[times > 1].tolist(), times[times > 1].tolist(), strict=True):
                    seen[v] = seen.get(v, 0) + t
                if len(seen) > 4 * TASK_KEEPS:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: 2 * TASK_KEEPS])
            parts, held = [], 0

        for batch in sliced(batches):
            for raw in _raw(batch):
                s = shingles(raw, k)
                n += 1
                held += len(s)
                parts.append(s)
                if held > 1_000_000:
                    flush()
        flush()
        top = sorted(((t, v) for v, t in seen.items() if t >= max(4, n // 400)), reverse=True)[:TASK_KEEPS]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([v for _, v in top], np.uint64).view(np.int64)), pa.array([t for t, _ in top], pa.int64())], ["s", "n"])

    rows = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(ALL_KEEP).collect()
    return np.array([r.s for r in reversed(rows)], np.int64).view(np.uint64)


def features(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, d1, d2, prefix, p, sketch, long): size, digest of the set, prefix shingles and their digest, parity sketches."""
    frequent = frequent_shingles(docs, k)
    by_value = np.argsort(frequent)
    held = docs.sparkSession.sparkContext.broadcast((frequent[by_value], by_value))  # ALL_KEEP entries at most

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rank = held.value
        for batch in sliced(batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for raw in _raw(batch):
                s = shingles(raw, k)
                n = len(s)
                size = n - (n * num + den - 1) // den + 1 if n else 0
                if len(values) and n:
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    hot = values[at] == s
                    prefix = s[~hot][:size]
                    if len(prefix) < size:
                        prefix = np.concatenate([prefix, s[hot][np.argsort(rank[at[hot]])][: size - len(prefix)]])
                else:
                    prefix = s[:size]
                width = max(64 * SKETCH, 1 << n.bit_length())
                bits = (np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
                long = np.packbits(bits).view(np.int64)
                d = _digest(s)
                out[0].append(n)
                out[1].append(d[0])
                out[2].append(d[1])
                out[3].append(prefix.view(np.int64))
                out[4].append(xxhash.xxh3_64_intdigest(prefix.tobytes()) - (1 << 63))
                out[5].append(np.bitwise_xor.reduce(long.reshape(-1, SKETCH), axis=0))
                out[6].append(long)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], ["doc_id", "n", "d1", "d2", "prefix", "p", "sketch", "long"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n long, d1 long, d2 long, prefix array<long>, p long, sketch array<long>, long array<long>")


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Neither the sizes nor the sketches rule out a link: of n1 + n2 shingles at most (den - num) / (den + num) may differ."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    differ = F.lit(0)
    for i in range(SKETCH):
        differ = differ + F.bit_count(a("sketch")[i].bitwiseXOR(b("sketch")[i]))
    return (a("n") * den >= b("n") * num) & (b("n") * den >= a("n") * num) & (differ * (den + num) <= (a("n") + b("n")) * (den - num))


def _long_differ(x: Column, y: Column) -> Column:
    """Bits in which two long sketches differ; of near sizes, one is at most twice as long."""
    fold = lambda v, n: F.when(F.size(v) <= n, v).otherwise(F.zip_with(F.slice(v, 1, n), F.slice(v, n + 1, n), lambda a, b: a.bitwiseXOR(b)))
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(fold(x, n), fold(y, n), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, v: t + v)


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), distinct and of near sizes, whose sets reach the threshold: first by long sketches, then by whole sets."""
    side = lambda name, key: rows.select(F.col("doc_id").alias(key), F.struct("n", "long").alias(name))
    pairs = pairs.join(side("x", "a"), "a").join(side("y", "b"), "b")
    pairs = written(pairs.where(_long_differ(F.col("x.long"), F.col("y.long")) * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num)).select("a", "b").distinct())
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(raw, k).view(np.int64) for raw in _raw(batch)], pa.list_(pa.int64()))], ["doc_id", "s"])

    sets = semi_by_id(docs.select(F.col("doc_id").cast("long"), "text"), ids).mapInArrow(of, "doc_id long, s array<long>")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    # |A & B| * den >= |A | B| * num, with the union from the sizes.
    return written(pairs.join(left, "a").join(right, "b").where(both * (den + num) >= (F.size("sa") + F.size("sb")) * num).select("a", "b"))


class _Candidates(NamedTuple):
    """What steps 1 to 3 make: features of all rows, classes of equal sets, a row for each class, groups, and groups by prefix shingle."""

    every: DataFrame
    classes: DataFrame
    rows: DataFrame
    groups: DataFrame
    n_groups: int
    bucketed: DataFrame


def _candidates(docs: DataFrame, k: int, num: int, den: int) -> _Candidates:
    if 2 * num < den:
        raise ValueError("the threshold must be 1/2 or more")
    every = written(features(docs, k, num, den))
    classes = written(every.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))
    heads = written(classes.where("class_id is not null").select(F.col("class_id").alias("doc_id"), "n", "d1", "d2"))
    # A doc_id with unlike texts stands for several sets: its rows are told apart by their digests, its links are the id's.
    # Rows that repeat pass as often as they come; pairs are made distinct before they are verified.
    rows = every.join(checked_broadcast(heads, heads.count(), HEADS), ["doc_id", "n", "d1", "d2"], "left_semi")
    groups = written(rows.groupBy("n", "p").agg(F.min("doc_id").alias("g"), F.count("*").alias("members")))
    n_groups = groups.count()
    first = groups.select(F.col("g").alias("doc_id"), "n", "p")
    tokens = rows.join(checked_broadcast(first, n_groups, HEADS), ["doc_id", "n", "p"], "left_semi").select(F.col("doc_id").alias("g"), F.explode("prefix").alias("t"))
    shared = tokens.groupBy("t").agg(F.min("g").alias("hub"), F.count("*").alias("groups")).where("groups > 1").select("t", "hub")
    return _Candidates(every, classes, rows, groups, n_groups, written(tokens.join(shared, "t")))


def _group_pairs(buckets: DataFrame, within: DataFrame, spread: DataFrame, n_groups: int, num: int, den: int) -> DataFrame:
    """Pairs (g, h) of groups that share a bucket (t, g), or one of within with itself, and whose members may link: distinct.

    spread: (g, n, n_least, lo, hi, all_bits, any_bits). Groups that are all of one component are no pair.
    """
    wide = buckets.join(checked_broadcast(spread, n_groups, HEADS // 8), "g")
    a, b = wide.alias("x"), wide.alias("y")
    differ = F.lit(0)
    bits = lambda side, name, i: F.coalesce(F.col(f"{side}.any_bits"), F.col(f"{side}.all_bits"))[i] if name == "any" else F.col(f"{side}.all_bits")[i]
    for i in range(SKETCH):  # bits that all of one group and none of the other have
        differ = differ + F.bit_count(bits("x", "all", i).bitwiseAND(F.bitwise_not(bits("y", "any", i)))) + F.bit_count(bits("y", "all", i).bitwiseAND(F.bitwise_not(bits("x", "any", i))))
    n, m = F.col("x.n"), F.col("y.n")
    apart = F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi")
    pairs = a.join(b, (F.col("x.t") == F.col("y.t")) & (F.col("x.g") < F.col("y.g")) & apart & (n * den >= F.col("y.n_least") * num) & (m * den >= F.col("x.n_least") * num) & (differ * (den + num) <= (n + m) * (den - num)))
    return pairs.select(F.col("x.g").alias("g"), F.col("y.g").alias("h")).distinct().union(within.select("g", F.col("g").alias("h")))


def _expanded(pairs: DataFrame, member: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of the pairs of groups, in different components, that their own sketches don't rule out."""
    x, y = (member.select(F.col("g").alias(key), F.struct("doc_id", "n", "sketch", "c").alias(name)) for key, name in (("g", "x"), ("h", "y")))
    both = pairs.join(x, "g").join(y, "h")
    return both.where((F.col("x.c") != F.col("y.c")) & ((F.col("g") < F.col("h")) | (F.col("x.doc_id") < F.col("y.doc_id"))) & _may_link("x", "y", num, den)).select(
        F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _spread(member: DataFrame) -> DataFrame:
    """A row for each group: size (greatest and least, where its id has unlike texts), least and greatest component, and the sketch bits that all (and, for more than one member, that any) have."""
    all_bits, any_bits = (F.array(*[f(F.col("sketch")[i]) for i in range(SKETCH)]) for f in (F.bit_and, F.bit_or))
    return written(member.groupBy("g").agg(F.max("n").alias("n"), F.min("n").alias("n_least"), F.min("c").alias("lo"), F.max("c").alias("hi"), all_bits.alias("all_bits"), F.when(F.count("*") > 1, any_bits).alias("any_bits")))


def _labels(c: _Candidates, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(class_id, component_id), a row for each class id: the least that links reach."""
    _, _, rows, groups, n_groups, bucketed = c
    star = bucketed.select(F.col("hub").alias("a"), F.col("g").alias("b")).where("a <> b").distinct()
    larger = written(groups.where("members > 1").select("n", "p", "g"))
    own = rows.select("doc_id", "n", "p").join(checked_broadcast(larger, larger.count()), ["n", "p"]).select(F.col("g").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    star = star.union(own).distinct()
    side = lambda name, key: rows.select(F.col("doc_id").alias(key), F.struct("n", "sketch").alias(name))
    star = star.join(side("x", "a"), "a").join(side("y", "b"), "b").where(_may_link("x", "y", num, den)).select("a", "b").distinct()
    near = _verified(star, rows, docs, k, num, den)
    label = components(near)

    # Buckets, and groups as buckets of their own, with members in more than one component.
    member = rows.join(label.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").select(
        "doc_id", "n", "p", "sketch", F.coalesce("c", "doc_id").alias("c"))
    member = written(member.join(checked_broadcast(groups, n_groups, HEADS), ["n", "p"]).select("doc_id", "n", "g", "sketch", "c"))
    spread = _spread(member)
    by_token = bucketed.select("t", "g").join(checked_broadcast(spread.select("g", "lo", "hi"), n_groups, HEADS), "g")
    open_t = written(by_token.groupBy("t").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("t"))
    open_tokens = written(bucketed.select("t", "g").join(checked_broadcast(open_t, open_t.count()), "t", "left_semi"))
    pairs = written(_group_pairs(open_tokens, spread.where("lo < hi"), spread, n_groups, num, den))
    rest = _verified(_expanded(pairs, member, num, den), rows, docs, k, num, den)
    more = rest.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(more).select(F.col("node").alias("c"), F.col("component").alias("oc"))
    final = member.select("doc_id", "c").distinct().join(over, "c", "left").select(F.col("doc_id").alias("class_id"), F.coalesce("oc", "c").alias("component_id"))
    return final.groupBy("class_id").agg(F.min("component_id").alias("component_id"))


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of left (places in sets) shares with each of right, by products of COLUMNS shingles at a time."""
    flat, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], np.diff(flat[order]) != 0])
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1  # a shingle of one set alone is shared with none
    at, column = at[order][several], (np.cumsum(new & several) - 1)[several]
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(sets), int(column[z - 1]) - start + 1), np.float32)
        has[at[a:z], column[a:z] - start] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _within(c: _Candidates, label: DataFrame, docs: DataFrame, k: int, num: int, den: int, pairs: bool) -> DataFrame:
    """Every link between different sets: as (a, b), each once and a < b, or added up in tasks as (class_id, beyond), rows at the other ends.

    A link joins sets of one component. A component's sets are dealt by id to blocks of about BLOCK_SETS sets and
    BLOCK_SHINGLES shingles, and a task compares two blocks at a time: no link is a row before it is one of the result.
    """
    copies = c.classes.where("class_id is not null").groupBy("class_id").agg(F.sum("copies").alias("copies"))
    member = written(c.rows.select(F.col("doc_id").alias("class_id"), "n", "d1", "d2").distinct().join(label, "class_id").join(copies, "class_id"))
    larger = member.groupBy("component_id").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), (F.min("class_id") < F.max("class_id")).alias("several")).where("several")
    larger = written(larger.select("component_id", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")))
    member = written(member.join(checked_broadcast(larger, larger.count()), "component_id").withColumn("block", F.pmod(F.xxhash64("class_id"), "blocks")))
    names = ["component_id", "class_id", "d1", "d2", "copies", "blocks", "block"]
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), "text").join(checked_broadcast(member.select(*names), member.count(), HEADS // 2), "class_id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = texts.select("component_id", "class_id", "d1", "d2", "copies", "block", "text", other.alias("other"))
    dealt = dealt.select("component_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class_id", "d1", "d2", "copies", "text")
    dealt = dealt.repartition("component_id", "i", "j").sortWithinPartitions("component_id", "i", "j")

    def compared(i: int, j: int, held: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        sets, block = [s for _, _, s in held.values()], np.array([x for x, _, _ in held.values()])
        ids, own = np.unique([d[0] for d in held], return_inverse=True)
        copy, n = np.zeros(len(ids), np.int64), np.array([len(s) for s in sets])
        copy[own] = [x for _, x, _ in held.values()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right) or len(ids) < 2:
            return []
        # |A & B| * den >= |A | B| * num, with the union from the sizes.
        x, y = np.nonzero(_common(sets, left, right) * (den + num) >= (n[left][:, None] + n[right]) * num)
        linked = np.unique(own[left[x]] * len(ids) + own[right[y]])  # an id with unlike texts links once
        x, y = linked // len(ids), linked % len(ids)
        x, y = (x[x < y], y[x < y]) if i == j else (x, y)
        if pairs:
            return [(np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]))]
        beyond = np.zeros(len(ids), np.int64)
        np.add.at(beyond, x, copy[y])
        np.add.at(beyond, y, copy[x])
        return [(ids[beyond > 0], beyond[beyond > 0])]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, {}, []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], out)
        for batch in sliced(batches):
            cells = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            for *place, block, class_id, d1, d2, copies, raw in zip(*cells, _raw(batch), strict=True):
                if place != at:
                    found += compared(*at[1:], held) if at else []
                    at, held = place, {}
                    if sum(len(f[0]) for f in found) > 10_000:
                        yield give()
                        found = []
                s = shingles(raw, k)
                if (class_id, d1, d2) not in held and _digest(s) == (d1, d2):
                    held[class_id, d1, d2] = (block, copies, s)
        found += compared(*at[1:], held) if at else []
        if found:
            yield give()

    out = ["a", "b"] if pairs else ["class_id", "beyond"]
    return written(dealt.mapInArrow(of, f"{out[0]} long, {out[1]} long"))


def links(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """((a, b), (doc_id, class_id)): all links between different sets as pairs a < b of class ids, and every document's class.

    The pairs of a family of m unlike near copies are m * (m - 1) / 2; near_duplicates() needs about m comparisons.
    """
    c = _candidates(docs, k, num, den)
    found = _within(c, written(_labels(c, docs, k, num, den)), docs, k, num, den, True)
    return found, c.every.where("n > 0").join(c.classes.select("n", "d1", "d2", "class_id"), ["n", "d1", "d2"]).select("doc_id", "class_id")


def linked(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """near_duplicates() with n_links, the number of other rows that each of docs (doc_id, text) links with.

    Every link between different sets is found within its component and counted with the copies at its other end; a row's
    own copies are links too, though none of those is ever paired. Of an id with unlike texts the links are the id's.
    """
    c = _candidates(docs, k, num, den)
    label = written(_labels(c, docs, k, num, den))
    beyond = _within(c, label, docs, k, num, den, False).groupBy("class_id").agg(F.sum("beyond").alias("beyond"))
    by_class = written(c.classes.join(label, "class_id", "left").join(beyond, "class_id", "left").select(
        "n", "d1", "d2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links")))
    known, none = c.every.where("n > 0").join(by_class, ["n", "d1", "d2"]), c.every.where("n = 0")
    own = lambda name: F.when(F.col("doc_id").isNotNull(), F.col(name)).alias(name)
    return known.select("doc_id", F.col("n").alias("n_shingles"), "class_id", own("component_id"), own("n_links")).union(
        none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long"))))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id), a row for each of docs (doc_id, text).

    class_id: the least doc_id with the same set; component_id: the least doc_id that links reach.
    """
    c = _candidates(docs, k, num, den)
    every, by_class = c.every, c.classes.join(_labels(c, docs, k, num, den), "class_id", "left")
    known = every.where("n > 0").join(by_class, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    none = every.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    # Where one id has several texts, the id's links are shared: the least component of its rows holds for all.
    return known.union(none)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with one document (the least doc_id) of each component of near duplicates.

    Rows that repeat a doc_id but not its text are documents of their own, of which others come first; of rows that
    repeat both, one counts. Rows without doc_id all stay.
    """
    again = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        found = near_duplicates(docs.select("doc_id", "text"), k, num, den)
        return anti_by_id(docs, written(found.where("doc_id <> component_id").select("doc_id")))
    beyond = docs.agg(F.max("doc_id")).first()[0] + 1
    twice = written(semi_by_id(docs, again).dropDuplicates(["doc_id", "text"]))
    unlike = written(twice.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    own = F.col("doc_id").cast("long")
    rows = anti_by_id(docs, again).withColumn("__own", own).unionByName(anti_by_id(twice, unlike).withColumn("__own", own))
    rows = written(rows.unionByName(semi_by_id(twice, unlike).withColumn("__own", F.monotonically_increasing_id() + F.lit(beyond))))
    found = near_duplicates(rows.select(F.col("__own").alias("doc_id"), "text"), k, num, den)
    return anti_by_id(rows, written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__own"))), "__own").drop("__own")
