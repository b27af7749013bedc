"""Jaccard join, substring dedup, decontamination, class LM, licence scan, WARC audit, pipeline: edge cases and brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from fleetmill.llm import bitmap, class_lm, decontaminate, graph, jaccard_join, licences, license_scan, substring_dedup, warc_audit  # noqa: E402


def documents(spark, texts, extra="x"):
    """Rows with columns whose names the operators use inside."""
    rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
    return spark.createDataFrame([(i, t, extra, extra, len(t or "")) for i, t in rows], "doc_id long, text string, n string, component_id string, n_chars long")


def near_copies(prose, seed, n_groups=3, size=6):
    r = random.Random(seed)
    texts = []
    for g in range(n_groups):
        base = prose(r.choice([40, 120, 400]), seed * 100 + g).split(" ")
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
            texts.append(" ".join(w))
    return texts


# --- n-gram Jaccard join -------------------------------------------------------------------------------------------


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((root(ids[x]), root(ids[y])))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_components_match_brute_force(spark, prose, k, num, den):
    texts = dict(enumerate([None, "", " \n", "one", "ONE", "one two", "one two", *near_copies(prose, k), prose(2500, 7), prose(2500, 7) + " end", *[prose(60, 50 + i) + " " + prose(80, 9) for i in range(12)]]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(documents(spark, texts), k, num, den).collect()}
    assert got == brute_components(texts, k, num, den)


def shingle_sets(texts, k):
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    return {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) for i, w in words.items() if w}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_all_links_match_brute_force(spark, prose, k, num, den):
    texts = dict(enumerate([None, "", "one", "ONE", "one two", *near_copies(prose, k, 4, 9), *[prose(60, 50 + i) + " " + prose(80, 9) for i in range(12)]]))
    sets = shingle_sets(texts, k)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    heads = sorted(first.values())
    want = {(a, b) for x, a in enumerate(heads) for b in heads[x + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    pairs, classes = jaccard_join.links(documents(spark, texts), k, num, den)
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 5
    assert {r.doc_id: r.class_id for r in classes.collect()} == {i: first[x] for i, x in sets.items()}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_numbers_of_links_match_brute_force(spark, prose, k, num, den):
    """Copies at both ends of a link, families of unlike near copies, empty texts; components as near_duplicates() has them."""
    texts = dict(enumerate([None, "", "one", "ONE", "one two", *near_copies(prose, k, 4, 9), *[prose(60, 50 + i) + " " + prose(80, 9) for i in range(12)]]))
    texts |= {1000 * n + i: t for n in (1, 2) for i, t in texts.items() if i % 3 == n}
    sets = shingle_sets(texts, k)
    near = {a: sum(den * len(s & t) >= num * len(s | t) for b, t in sets.items() if b != a) for a, s in sets.items()}
    got = jaccard_join.linked(documents(spark, texts), k, num, den).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: near.get(i, 0) for i in texts} and max(near.values()) > 4
    plain = jaccard_join.near_duplicates(documents(spark, texts), k, num, den).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(tuple(r) for r in plain)


@pytest.mark.parametrize("block", [7, 1024])
def test_a_familys_links_are_counted_without_a_row_for_each(spark, prose, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 50)
    words = prose(400, 3).split(" ")
    texts = {i: " ".join([*words[: 5 * i], f"x{i}", *words[5 * i + 1 :]]) for i in range(50)} | {100: " ".join(words), 101: " ".join(words), 102: prose(80, 4)}
    seen, verified = [], jaccard_join._verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    sets = shingle_sets(texts, 3)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.linked(documents(spark, texts), 3, 9, 10).collect()}
    assert got == {a: (102 if a == 102 else 0, sum(10 * len(s & t) >= 9 * len(s | t) for b, t in sets.items() if b != a)) for a, s in sets.items()}
    assert sum(seen) < 4 * len(texts)  # 1,275 links between different sets
    assert jaccard_join.links(documents(spark, texts), 3, 9, 10)[0].distinct().count() == jaccard_join.links(documents(spark, texts), 3, 9, 10)[0].count() == 51 * 50 // 2


def test_links_of_rows_without_or_with_shared_ids(spark):
    a, b, c = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61)), " ".join(f"v{i}" for i in range(50))
    df = spark.createDataFrame([(3, a, 1), (3, a, 1), (None, a, 2), (7, b, 3), (7, c, 3), (9, c, 4), (None, "x y z", 5), (None, None, 6), (8, None, 7)], "doc_id long, text string, n_links int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.linked(df, 3, 9, 10).collect()), key=repr)
    # Row 7 stands for b, which links with three rows of a, and for c, which has one more copy.
    assert got == sorted([(3, 58, 3, 5), (3, 58, 3, 5), (None, 58, None, None), (7, 59, 3, 3), (7, 48, 3, 4), (9, 48, 3, 4), (None, 1, None, None), (None, 0, None, None), (8, 0, 8, 0)], key=repr)
    assert jaccard_join.linked(df.limit(0), 3, 9, 10).count() == 0


def test_shared_boilerplate_makes_no_links(spark, prose):
    """Many texts with one long passage in common, each with as much of its own: candidates in one bucket, no link."""
    shared = prose(60, 9)
    texts = {i: f"{shared} {prose(60, 1000 + i)}" for i in range(2000)}
    texts |= {5000 + i: texts[i] + " end" for i in range(0, 2000, 100)}
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(documents(spark, texts), 5, 4, 5).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i in texts}


def test_one_of_each_keeps_unlike_texts_of_one_id(spark, prose):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    df = documents(spark, {3: a, 4: c}).union(documents(spark, {7: a + " end"})).union(documents(spark, {7: b})).union(documents(spark, {7: b}))
    assert sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(df, 3, 9, 10).collect()) == sorted([(3, a), (4, c), (7, b)])


def test_jaccard_repeated_rows_null_ids_and_empty_tables(spark, prose):
    t = prose(80, 1)
    df = documents(spark, {5: t, 9: t}).union(documents(spark, {5: t})).union(documents(spark, {7: prose(80, 2)}).withColumn("doc_id", F.lit(None).cast("long")))
    rows = jaccard_join.near_duplicates(df, 3, 9, 10).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (5, 5), (5, 5), (9, 5)]
    kept = jaccard_join.one_of_each(df, 3, 9, 10)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 5]
    assert jaccard_join.near_duplicates(df.limit(0), 3, 9, 10).count() == 0


def test_sketches_never_rule_out_a_link(spark):
    r = np.random.default_rng(1)
    for _ in range(50):
        a = set(r.integers(0, 2**63, 400).tolist())
        b = set(list(a)[10:]) | set(r.integers(0, 2**63, 8).tolist())
        bits = lambda s: np.bincount([x % 512 for x in s], minlength=512) & 1
        assert (bits(a) ^ bits(b)).sum() <= len(a ^ b)


def test_graph_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (5, 6), (6, 5)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in sorted(near):
        if s not in want:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = s
                    todo += near[x]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


# --- substring dedup -----------------------------------------------------------------------------------------------


def brute_repeats(rows, min_words):
    """(doc_id, text, start, end) of units that occur earlier, by (rank, doc_id, text_key, place); rows: (rank, doc_id, text_key, text)."""
    first, out = {}, set()
    for rank, i, key, text in sorted(rows):
        for h, n, start, end, _, _ in substring_dedup.units(text, min_words):
            place = (i, text, start)
            if h not in first:
                first[h] = place
            elif first[h] != place:
                out.add((i, text, start, end))
    return out


@pytest.mark.parametrize("min_words", [1, 5])
def test_repeats_match_brute_force(spark, prose, min_words):
    shared = prose(90, 3)
    texts = dict(enumerate([None, "", prose(60, 1) + "\n" + shared, prose(70, 2) + " " + shared, shared, shared, prose(50, 4), "A line that is found here.\nA  LINE that is found here.\n" + prose(30, 5), "Yes.\nNo.\nyes. No. Yes.", "x " * 5000]))
    df = documents(spark, texts).union(documents(spark, {4: prose(20, 8) + "\n" + shared, 6: "Yes."})).withColumn("place", F.when(F.col("doc_id") != 5, -F.col("doc_id")))
    rows = [((1 << 63) - 1 if r.place is None else r.place, r.doc_id, r.text_key, r.text) for r in df.withColumn("text_key", F.xxhash64("text")).collect()]
    got = {(r.doc_id, r.text, r.start, r.end) for r in substring_dedup.repeats(df, "place", min_words).join(df.select("doc_id", "text", F.xxhash64("text").alias("text_key")), ["doc_id", "text_key"]).collect()}
    assert got == brute_repeats(rows, min_words) and len(got) > 5


def brute_spans(texts, min_words, run_words):
    """Character spans to cut of each text: repeated lines, runs of repeated sentences, stretches of 50 words or more that an earlier text has."""
    gone = defaultdict(set)
    cut = brute_repeats([(i, i, 0, t) for i, t in texts.items() if t], min_words)
    for i, t in texts.items():
        units = substring_dedup.units(t, min_words)
        dup = [(t, u) for u in units if (i, t, u[2], u[3]) in cut]
        single = sorted((u for _, u in dup if u[5] < 2), key=lambda u: u[4])
        runs = []
        for u in single:
            if runs and runs[-1][-1][4] == u[4] - 1:
                runs[-1].append(u)
            else:
                runs.append([u])
        spans = [(u[2], u[3]) for run in runs for u in run if sum(x[1] for x in run) >= run_words or u[5] == 1] + [(u[2], u[3]) for _, u in dup if u[5] == 2]
        for a, b in spans:
            gone[i] |= set(range(a, b))
    words = {i: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for i, t in texts.items()}
    for i in texts:
        for j in (x for x in texts if x < i):
            a, b = ([w for w, _, _ in words[x]] for x in (i, j))
            run = {}
            for x in range(len(a)):
                run = {y: run.get(y - 1, 0) + 1 for y in range(len(b)) if a[x] == b[y]}
                n = max(run.values(), default=0)
                if n >= substring_dedup.PASSAGE_WORDS:
                    gone[i] |= set(range(words[i][x - n + 1][1], words[i][x][2]))
    return {i: g for i, g in gone.items() if g}


@pytest.mark.parametrize(("min_words", "run_words"), [(1, 1), (5, 20)])
def test_spans_and_removal_match_brute_force(spark, prose, min_words, run_words):
    r = random.Random(7)
    words = lambda n: " ".join(r.choice("bcdfglmn") + r.choice("aeiou") + str(r.randrange(10**6)) for _ in range(n))
    long, lines = words(200).split(), [words(9) + "." for _ in range(4)] + ["Short line.", "Thanks."]
    texts = {0: words(30) + "\n" + " ".join(long) + "\n" + "\n".join(lines)}
    for i in range(1, 9):
        at, n = r.randrange(100), r.choice([30, 49, 50, 70, 100])
        texts[i] = "\n".join([words(20), r.choice(lines), f"{words(r.randrange(1, 20))} {' '.join(long[at : at + n])} {words(r.randrange(1, 20))}.", " ".join(r.sample(lines, 3)), words(5)])
    texts |= {20: None, 21: " \n\n ", 22: texts[3], 23: "é " + texts[3].upper()}
    want = brute_spans(texts, min_words, run_words)
    rows = substring_dedup.spans(documents(spark, texts), min_words=min_words, run_words=run_words).collect()
    got = defaultdict(set)
    for x in rows:
        got[x.doc_id] |= set(range(x.span_start, x.span_end))
    solid = lambda i, chars: {c for c in chars if not texts[i][c].isspace()}  # noqa: E731  white space between units may go or stay
    assert {i: solid(i, g) for i, g in got.items()} == {i: solid(i, g) for i, g in want.items()}
    for x in substring_dedup.removed(documents(spark, texts), min_words=min_words, run_words=run_words).collect():
        assert x.text == (None if texts[x.doc_id] is None else "".join(ch for c, ch in enumerate(texts[x.doc_id]) if c not in got[x.doc_id]))


def test_rows_that_share_an_id_keep_their_own_text(spark, prose):
    a, b, c = prose(90, 1), prose(90, 2), prose(90, 3)
    df = documents(spark, {1: a}).union(documents(spark, {2: b})).union(documents(spark, {2: a})).union(documents(spark, {2: c}))
    out = sorted((r.doc_id, r.text) for r in substring_dedup.removed(df).collect())
    assert out == sorted([(1, a), (2, b), (2, ""), (2, c)])


def test_passages_inside_lines_are_cut_and_clean_documents_stay(spark, prose):
    passage = "Every word of this passage is found in more than one text. It begins in the middle of a line and goes on for long. " * 1 + "There are more than fifty words in it, so that anyone would call it a passage. It ends as it began, within a line of the text that holds it here."
    texts = {i: prose(80, 20 + i).rstrip(".\n") + " and so on. " + passage + " " + prose(40, 40 + i) for i in range(5)} | {10 + i: prose(120, 60 + i) for i in range(6)}
    rows = substring_dedup.spans(documents(spark, texts)).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4}
    for r in rows:
        assert "more than fifty words" in texts[r.doc_id][r.span_start : r.span_end] and r.kept_in == [0]
    out = {r.doc_id: r for r in substring_dedup.removed(documents(spark, texts)).collect()}
    assert out[0].text == texts[0] and all(out[i].text == texts[i] for i in texts if i >= 10)
    assert all("more than fifty words" not in out[i].text and out[i].n_chars == len(out[i].text) for i in (1, 2, 3, 4))


def test_passages_that_begin_and_end_inside_sentences_are_cut(spark):
    r = random.Random(9)
    words = lambda n: [r.choice("bcdfglmn") + r.choice("aeiou") + str(r.randrange(10**6)) for _ in range(n)]
    whole = words(300)
    texts, want, at = {0: " ".join(words(7) + whole + words(9))}, {}, 0
    for i, n in enumerate([49, 50, 51, 64, 75, 120, 300], 1):
        at, own = r.randrange(301 - n), [" ".join(words(n)) for n in (r.randrange(1, 90), r.randrange(1, 90))]
        passage = " ".join(whole[at : at + n])
        texts[i] = f"é {own[0]} {passage.upper()}  {own[1]}."
        if n >= 50:
            want[i] = (len(own[0]) + 3, len(own[0]) + 3 + len(passage))
    signs = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(80))
    texts |= {20: "甲乙" + signs + "丙。", 21: "丁戊己" + signs + "庚。"}
    want[21] = (3, 83)
    rows = substring_dedup.spans(documents(spark, texts)).collect()
    assert {x.doc_id: (x.span_start, x.span_end) for x in rows if x.doc_id != 21} == {i: v for i, v in want.items() if i != 21}
    signs_cut = [(x.span_start, x.span_end) for x in rows if x.doc_id == 21]
    assert signs_cut == [want[21]]


def test_dedup_edges(spark, prose):
    t = prose(60, 1)
    df = documents(spark, {1: t, 2: None}).union(documents(spark, {1: t})).union(documents(spark, {3: t}).withColumn("doc_id", F.lit(None).cast("long")))
    out = substring_dedup.removed(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, t), (1, t), (1, t), (2, "")]
    assert substring_dedup.spans(df.limit(0)).count() == 0


def test_bitmap_has_no_false_negatives(spark):
    h = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    b = bitmap.build(spark.createDataFrame([(int(x),) for x in h], "h long"), "h", 5000)
    assert bitmap.passes(b, h.view(np.uint64)).all()
    assert bitmap.passes(b, np.random.default_rng(3).integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.05


# --- benchmark decontamination -------------------------------------------------------------------------------------


def brute_overlap(doc, item):
    """Length of the longest stretch on any diagonal with 4 of 5 words alike."""
    d, w = doc.encode().lower().split(), item.encode().lower().split()
    best = 0
    for g in range(-len(w) + 1, len(d)):
        same = [d[g + j] == w[j] for j in range(len(w)) if 0 <= g + j < len(d)]
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                if 5 * sum(same[i:j]) >= 4 * (j - i):
                    best = max(best, j - i)
    return best


def test_leaks_with_substitutions_are_found_and_clean_texts_not(spark, prose):
    r = random.Random(1)
    items = {i: prose(18 + 4 * i, 500 + i) for i in range(6)} | {20: "only five words are here", 21: "too short", 22: None, 23: "", 24: prose(11, 700), 25: "word", 26: prose(18, 500), 27: "many a word of Some Bench Mark"}
    texts = {i: prose(100, i) for i in range(30)} | {90: None, 91: "", 92: "a " * 3000}
    want = set()
    for n, i in enumerate(range(6)):
        w = items[i].split()
        for at in r.sample(range(len(w)), 1 + len(w) // 14):
            w[at] = "swapped"
        texts[40 + n] = prose(50, 200 + n) + " " + " ".join(w) + " " + prose(50, 300 + n)
        want.add((40 + n, i))
    want.add((40, 26))  # an item with the text of item 0
    texts[60] = "before it only FIVE strange are here after"
    texts[61] = "it is too short. this is too short"
    texts[62] = "x " * 200 + " ".join(x if k not in (2, 7) else "other" for k, x in enumerate(items[24].split())) + " y" * 300
    texts[63] = texts[62].replace("x", "z")
    want |= {(60, 20), (61, 21), (62, 24), (63, 24)}
    items_df = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontaminate.overlaps(documents(spark, texts), items_df).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    for r in rows:
        assert r.n_words == brute_overlap(texts[r.doc_id], items[r.item_id]) and 5 * r.n_agree >= 4 * r.n_words
        d, w = (x[r.doc_id if x is texts else r.item_id].lower().split() for x in (texts, items))
        assert sum(a == b for a, b in zip(d[r.doc_word : r.doc_word + r.n_words], w[r.item_word : r.item_word + r.n_words], strict=True)) == r.n_agree
    kept = decontaminate.clean(documents(spark, texts), items_df)
    assert kept.columns == documents(spark, texts).columns and {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in want}
    assert decontaminate.overlaps(documents(spark, texts).limit(0), items_df).count() == 0
    assert decontaminate.overlaps(documents(spark, texts), items_df.limit(0)).count() == 0


def test_decontamination_of_rows_that_share_ids(spark, prose):
    item, other = prose(30, 1), prose(40, 2)
    df = documents(spark, {1: "so " + item}).union(documents(spark, {1: other})).union(documents(spark, {1: "so " + item})).union(documents(spark, {2: item}).withColumn("doc_id", F.lit(None).cast("long")))
    items = spark.createDataFrame([(7, item, "z"), (7, prose(25, 3), "z"), (None, other, "z"), (7, item, "z")], "item_id long, text string, words string")
    assert [(r.doc_id, r.item_id, r.n_words) for r in decontaminate.overlaps(df, items).collect()] == [(1, 7, 30)]
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.clean(df, items).collect()) == sorted([(0, item), (1, other)])


def test_a_passage_in_many_texts_is_verified_once(spark, prose):
    item = prose(30, 1)
    texts = {i: f"copy {item} end" for i in range(300)}
    rows = decontaminate.overlaps(documents(spark, texts), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.doc_word, r.item_word, r.n_words) for r in rows) == [(i, 1, 0, 30) for i in range(300)]


def test_overlaps_longer_than_the_distance_between_hits(spark):
    """The stretch goes on far from the last window that is alike in any mask: nothing cuts it off."""
    w = [f"w{i}" for i in range(400)]
    d = [x if i < 100 or i % 4 else "no" for i, x in enumerate(w)]
    rows = decontaminate.overlaps(documents(spark, {1: " ".join(d)}), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")).collect()
    assert [(r.n_words, r.n_agree) for r in rows] == [(brute_stretch(d, w), rows[0].n_agree)]


def brute_stretch(d, w):
    same = np.cumsum([0, *(1 if a == b else -4 for a, b in zip(d, w))])
    return max(j - i for i in range(len(same)) for j in range(i, len(same)) if same[j] >= same[i])


@pytest.mark.parametrize("n", [*range(1, 22), 25])
def test_masks_find_nearly_all_placements_of_substitutions(n):
    """Enumerated: the share of placements of as many substitutions as an overlap may have that some mask ignores."""
    masks = [m for m in decontaminate._PLACES] if n >= decontaminate.LEAST else decontaminate.short_masks(n)
    windows = np.array([sum(1 << (a + i) for i in m) for m in masks for a in range(n - max(m))], np.int64)
    places = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 5)], np.int64)
    found = np.zeros(len(places), bool)
    for x in windows:
        found |= places & x == 0
    assert found.mean() >= (0.997 if n >= decontaminate.LEAST else 1)


def test_longest_overlap():
    a, b = np.array([1, 2, 3, 4, 9, 6, 7, 8, 9, 10]), np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    assert decontaminate.longest_overlap(a, b) == (0, 10, 9)
    assert decontaminate.longest_overlap(np.array([1, 9, 9, 9]), np.array([1, 2, 3, 4]))[1:] == (1, 1)


# --- LM scoring ----------------------------------------------------------------------------------------------------


def lm_key(word):
    return xxhash.xxh3_64_intdigest(word) - (1 << 64) * (xxhash.xxh3_64_intdigest(word) >> 63)


@pytest.mark.parametrize("head", [30, 60, 10_000])
def test_scores_match_brute_force(spark, prose, monkeypatch, head):
    """Base scores and class path, with more words than the core and the held words, and with all of them held."""
    z = class_lm.Sizes(head=head, class_factor=0.9, core_factor=1.0)
    texts = {i: prose(r, i) for i, r in enumerate([0, 1, 5, 60, 200, 200, 30, 80, 90, 120, 150, 40])} | {50: None, 51: "unseenword the of", 52: prose(200, 4)}
    seen = Counter()
    toks = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10 != 0]
    for i in train:
        seen.update(toks[i])
    n_end, n, v = len(train), sum(seen.values()) + len(train), len(seen) + 1
    classes, core = z.classes(len(seen)), z.core(len(seen))
    assert 2 < classes < core < min(len(seen), 60)
    made = []
    original = class_lm.assigned
    monkeypatch.setattr(class_lm, "assigned", lambda *a: made.append(original(*a)) or made[-1])
    rows = {r.doc_id: r for r in class_lm.scores(documents(spark, texts), z).collect()}
    table = {r.h: r for r in made[0].collect()}
    assert {h: r.n for h, r in table.items()} == {lm_key(w): k for w, k in seen.items()}  # every word has a class
    n_class, v_class, once = Counter(), Counter(), Counter()
    for r in table.values():
        n_class[r.c] += r.n
        v_class[r.c] += 1
        once[r.c] += r.n == 1
    unseen = max(range(classes), key=lambda c: (once[c], -c))
    cls = lambda w: table[lm_key(w)].c if w in seen else unseen
    n_class[classes], v_class[classes] = n_end, 1
    path = lambda i: [classes, *map(cls, toks[i]), classes]
    big = Counter()
    for i in train:
        big.update(zip(path(i), path(i)[1:]))
    left = Counter()
    for (a, _), k in big.items():
        left[a] += k
    for i in texts:
        c = [seen.get(w, 0) for w in toks[i]] + [n_end]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        p = path(i)
        score = sum(math.log10((big[a, b] + 0.1) / (left[a] + 0.1 * (classes + 1))) + math.log10((x + 0.1) / (n_class[b] + 0.1 * (v_class[b] + 1))) for a, b, x in zip(p, p[1:], c))
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(c), sum(x > 0 for x in c), n)
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score, abs=1e-8)
        assert math.log10(r.perplexity) == pytest.approx(-score / len(c)) and math.log10(r.base_perplexity) == pytest.approx(-base / len(c))


def test_words_outside_the_core_go_where_their_neighbours_are_likely(spark):
    """Brute force: with the core's classes, each other word has the class of greatest likelihood."""
    r = random.Random(3)
    texts = {i: " ".join(r.choice(["a", "b", "c", "d", "e", *(f"w{j}" for j in range(30))]) for _ in range(60)) for i in range(60)}
    train = [t.split() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 != 0]
    counted = spark.createDataFrame([(lm_key(w), n) for w, n in Counter(x for t in train for x in t).items()], "h long, n long")
    h, n = class_lm.frequent(counted, 20, 5)
    assert len(h) == 5 or len(h) <= 20
    name = {lm_key(w): w for t in train for w in t}
    core = [name[x] for x in h[:5].tolist()]
    classes = np.array([0, 0, 1, 1, 2], np.int32)
    of = dict(zip(core, classes.tolist()))
    docs = documents(spark, texts).withColumn("held_out", class_lm.held_out())
    got = {name[r.h]: r.c for r in class_lm.assigned(class_lm.tokenised(docs, h), h, n, classes, 3).collect()}
    big, around = np.zeros((5, 5)), defaultdict(lambda: np.zeros((2, 5)))
    for t in train:
        c = [3, *(of.get(w, 4) for w in t), 3]
        for x, y in zip(c, c[1:]):
            big[x, y] += 1
        for i, w in enumerate(t):
            around[w][0][c[i]] += 1
            around[w][1][c[i + 2]] += 1
    log = np.log(big + class_lm.A)
    own = np.log(big.sum(1) + 5 * class_lm.A) + np.log(big.sum(0) + 5 * class_lm.A)
    for w, a in around.items():
        gain = [a[0] @ log[:, c] + a[1] @ log[c] - a[0].sum() * own[c] for c in range(3)]
        assert got[w] == of[w] if w in of else gain[got[w]] == pytest.approx(max(gain), abs=1e-3)


def test_frequent_takes_enough_words_where_all_are_as_common(spark):
    counted = spark.createDataFrame([(i, 7) for i in range(50)], "h long, n long")
    assert class_lm.frequent(counted, 20, 5)[0].tolist() == [0, 1, 2, 3, 4]
    assert len(class_lm.frequent(counted, 50, 5)[0]) == 50 and len(class_lm.frequent(counted.limit(0), 20, 5)[0]) == 0


def test_class_model_beats_unigrams_on_held_out_texts(spark):
    """Two languages: which words follow which is what classes can learn."""
    r = random.Random(5)
    langs = [[f"a{i}a" for i in range(60)], [f"b{i}b" for i in range(60)]]
    texts = {i: " ".join(r.choice(langs[i % 2]) for _ in range(60)) for i in range(300)}
    rows = class_lm.scores(documents(spark, texts)).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert rows[1] > rows[0] * 0.9


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(1)
    m = np.zeros((20, 20))
    for _ in range(4000):
        u = r.integers(20)
        m[u, (u + 10 * (r.random() < 0.9)) % 20 // 10 * 10 + r.integers(10)] += 1
    def big_of(c):
        out = np.zeros((33, 33))
        np.add.at(out, (c[:, None].repeat(20, 1), c[None].repeat(20, 0)), m)
        return out
    xlx = lambda v: (v * np.log(np.maximum(v, 1e-300))).sum()
    gain = lambda b: xlx(b) - xlx(b.sum(0)) - xlx(b.sum(1))
    c = np.arange(20) % 3
    before = gain(big_of(c))
    for sweep in range(6):
        around = np.zeros((20, 2, 33))
        for u in range(sweep % 2, 20, 2):
            np.add.at(around[u, 0], c, m[:, u])
            np.add.at(around[u, 1], c, m[u])
        c = class_lm.exchange(big_of(c), around, c, 32)
    assert gain(big_of(c)) > before


def test_lm_empty_table(spark):
    assert class_lm.scores(documents(spark, {1: "a"}).limit(0)).count() == 0


# --- licence scan --------------------------------------------------------------------------------------------------

T = licences.SHORT


def test_licences_and_inheritance(spark, prose):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    files = {"LICENSE": mit, "a/LICENSE": apache + "\n", "a/b/x": prose(60, 1), "a/b/c/y": prose(60, 2) + "\n" + "This work is licensed under the GNU General Public License, version 3.\n" + prose(20, 3),
             "a/b/c/z": None, "d/e": prose(50, 4), "f": "", None: prose(50, 6), "g/COPYING": mit, "g/ALSO": apache, "g/h": "licence to nothing at all"}
    df = spark.createDataFrame([(i, p, t, "q", "q") for i, (p, t) in enumerate(files.items())], "doc_id long, path string, text string, licence string, kind string")
    got = {r.path: (r.licence, r.kind, r.source) for r in license_scan.scan(df, T).collect()}
    assert got["a/LICENSE"] == ("Apache-2.0", "file", "a/LICENSE") and got["LICENSE"] == ("MIT", "file", "LICENSE")
    assert got["a/b/x"] == ("Apache-2.0", "inherited", "a/LICENSE") and got["a/b/c/z"][:2] == ("Apache-2.0", "inherited")
    assert got["a/b/c/y"][:2] == ("GPL-3.0", "header")
    assert got["d/e"] == got["f"] == got[None] == ("MIT", "inherited", "LICENSE")
    assert got["g/h"] == ("Apache-2.0", "inherited", "g/ALSO")
    assert license_scan.scan(df.limit(0), T).count() == 0
    assert license_scan.scan(df, []).where("licence is not null").count() == 0


def test_cosine_matches_brute_force():
    df = {"licensed": 3, "under": 50, "the": 90, "mit": 2, "license": 4, "released": 1}
    m = license_scan.Matcher([("MIT", "Released under the MIT License.")], 100, df)
    a, b = Counter("released under the mit license".split()), Counter("the mit license of the north".split())
    idf = lambda t: math.log(101 / (df.get(t, 0) + 1)) + 1
    dot = sum(a[t] * b[t] * idf(t) ** 2 for t in a)
    norm = lambda c: math.sqrt(sum((k * idf(t)) ** 2 for t, k in c.items()))
    assert m.cosine("the MIT license of the north")[0] == pytest.approx(dot / norm(a) / norm(b))


def brute_scan(files, templates):
    """Every part of every text against every template, then the nearest directory with a licence file by walking up."""
    split = lambda t: re.findall(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?", (t or "").lower())
    n, df = len(files), Counter(w for _, _, t in files for w in set(split(t)))
    own = {w for _, t in templates for w in split(t)}
    idf = lambda w: math.log((n + 1) / ((df[w] if w in own else 0) + 1)) + 1
    vector = lambda t: {w: k * idf(w) for w, k in Counter(split(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, vector(t)) for name, t in templates]
    found, given = [], {}
    for i, path, text in files:
        best = (0.0, "", "")
        *inside, whole = license_scan.parts((text or "").lower())
        for some in ([whole], inside):
            for kind, part in some if best[0] < license_scan.LEAST else []:
                v = vector(part)
                for name, x in vectors:
                    if norm(v):
                        best = max(best, (round(sum(v[w] * x[w] for w in v if w in x) / norm(v) / norm(x), 9), name, kind))
        best = best if best[0] >= license_scan.LEAST else None
        found.append((i, path, best))
        if best and best[2] == "file":
            folder = (path or "").rpartition("/")[0]
            given[folder] = min(given.get(folder, ((chr(0x10FFFF), ""), path)), ((path or "", best[1]), path), key=lambda x: x[0])
    out = []
    for i, path, best in found:
        folder = (path or "").rpartition("/")[0]
        while not best and folder and folder not in given:
            folder = folder.rpartition("/")[0]
        if best:
            out.append((i, path, best[1], best[2], best[0], path))
        elif folder in given:
            out.append((i, path, given[folder][0][1], "inherited", None, given[folder][1]))
        else:
            out.append((i, path, None, "none", None, None))
    return sorted(out, key=repr)


def test_whole_scan_matches_brute_force(spark, prose):
    """Licence files with full texts, headers as comments, ties, repeated and null paths, very long texts, clashing columns."""
    mit, bsd = (dict(licences.TEXTS)[k] for k in ("MIT", "BSD-3-Clause"))
    apache = dict(licences.HEADERS)["Apache-2.0"]
    code = "/*\n * Copyright 2001 Someone\n *\n" + "\n".join(f" * {x}" for x in apache.split("\n")) + "\n *\n */\n\n" + prose(300, 3)
    files = [(0, "LICENSE", mit.replace("(c)", "(c) 2024 A Person")), (1, "a/COPYING", bsd), (2, "a/b/x.c", code), (3, "a/b/y.c", prose(60, 4)), (4, "c/z", prose(90, 5) + "\n\n" + mit.split("\n")[2] + "\n" + mit.split("\n")[3]), (5, None, prose(20, 6)),
             (6, "d/COPYING", "Licensed under CC BY 4.0."), (7, "d/COPYING", "Released under the MIT License."), (8, "d/e/f/g", None), (9, "d/x", ""), (10, "a/b/x.c", prose(10_000, 7)), (11, "h/i", "Licensed under the Apache License, Version 2.0.\n" + prose(40, 8)), (12, "h/j/k", " \n")]
    df = spark.createDataFrame([(*f, "q", "q") for f in files], "doc_id long, path string, text string, licence string, dir string")
    got = sorted((tuple(r) for r in license_scan.scan(df, licences.TEMPLATES).collect()), key=repr)
    want = brute_scan(files, licences.TEMPLATES)
    assert [(*g[:4], g[5]) for g in got] == [(*w[:4], w[5]) for w in want]
    assert all(g[4] == pytest.approx(w[4], abs=1e-6) if w[4] else g[4] is None for g, w in zip(got, want, strict=True))
    kinds = {g[0]: g[2:4] for g in got}
    assert kinds[0] == ("MIT", "file") and kinds[1] == ("BSD-3-Clause", "file") and kinds[2] == ("Apache-2.0", "header") and kinds[12][1] == "inherited"
    empty = license_scan.scan(df.limit(0), licences.TEMPLATES)
    assert empty.count() == 0 and empty.columns == ["doc_id", "path", "licence", "kind", "cosine", "source"]


def test_long_licences_are_files_of_their_directories(spark, prose):
    """Whole LICENSE and COPYING files, as they are, with a holder filled in, and with some words changed; what lies below them inherits."""
    long, r = dict(licences.LONG), random.Random(3)
    worn = lambda t: " ".join(w if r.random() < 0.95 else f"word{r.randrange(500)}" for w in t.split(" "))
    filled = long["Apache-2.0"].replace("[yyyy]", "2024").replace("[name of copyright owner]", "A Person")
    files = {"a/LICENSE": filled, "a/src/x.c": prose(80, 1), "g/COPYING": long["GPL-3.0"], "g/y": None, "h/COPYING": worn(long["GPL-2.0"]), "h/i/j/k": prose(30, 2),
             "m/LICENSE": worn(long["MPL-2.0"]).upper(), "m/z": "", "x/own.c": "// " + dict(licences.SHORT)["MIT"] + "\n" + prose(80, 3), "w/x": long["GPL-3.0"][:3000] + prose(2000, 4)}
    rows = [(i, p, t) for i, (p, t) in enumerate(files.items())]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    result = license_scan.scan(df, licences.TEMPLATES).collect()
    got = {r.path: (r.licence, r.kind, r.source) for r in result}
    for name, licence, below in (("a/LICENSE", "Apache-2.0", "a/src/x.c"), ("g/COPYING", "GPL-3.0", "g/y"), ("h/COPYING", "GPL-2.0", "h/i/j/k"), ("m/LICENSE", "MPL-2.0", "m/z")):
        assert got[name] == (licence, "file", name) and got[below] == (licence, "inherited", name)
    assert got["w/x"][1] == "none" and got["x/own.c"][:2] == ("MIT", "file")
    assert sorted(((r.doc_id, *tuple(r)[1:4], r.source) for r in result), key=repr) == sorted(((*w[:4], w[5]) for w in brute_scan(rows, licences.TEMPLATES)), key=repr)


@pytest.mark.parametrize("every", [1, 3])
def test_common_licences_are_found(spark, prose, every):
    texts = [prose(40, i) + ("\nReleased under the MIT License." if i % every == 0 else "") for i in range(12)]
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.kind) for r in license_scan.scan(df, T).collect()}
    assert got == {i: ("MIT", "header") if i % every == 0 else (None, "none") for i in range(12)}


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_markers_lose_no_licence(share):
    r, words = random.Random(5), sorted({t for _, text in T for t in license_scan.terms(text)})
    m = license_scan.Matcher(T, 100, {t: int(100 * share) for t in words} | {"the": 90, "of": 95})
    for _ in range(3000):
        text = " ".join(r.sample(words, r.randint(1, 6)) if r.random() < 0.5 else [w for w in r.choice(T)[1].split() if r.random() < 0.8])
        best = m.cosine(text)[0]
        assert (m.match(text) is not None) == (best >= license_scan.LEAST)


# --- WARC audit ----------------------------------------------------------------------------------------------------


def test_audit_finds_exactly_the_corrupted_records(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("http://x/"), "id")).alias("url"), F.when(F.col("id") % 11 > 0, F.expr("repeat(concat('<p>', id), int(id % 400))")).alias("html"))
    original = warc_audit.records(pages, 700)
    bad = F.col("record_id").isin(0, 3, 699, 700, 1234, 2999)
    replica = original.where("record_id <> 1500").withColumn("digest", F.when(bad, F.lit("0")).otherwise(F.col("digest")))
    rows = warc_audit.audit(original, replica).collect()
    assert {(r.record_id, r.status) for r in rows} == {(i, "corrupt") for i in (0, 3, 699, 700, 1234, 2999)} | {(1500, "missing")}
    assert warc_audit.audit(original, original).count() == 0
    assert warc_audit.audit(replica.limit(0), original.limit(5)).where("status = 'extra'").count() == 5
    assert warc_audit.audit(original.limit(0), original.limit(0)).count() == 0


def test_audit_of_hashed_replicas_matches_brute_force(spark):
    """Both sides hashed: bytes changed in place, records cut short, lost and added; what stands behind has moved."""
    r = random.Random(2)
    rows = {i: (f"http://x/{i}", "".join(r.choice("<p>ab é") for _ in range(r.randrange(3000)))) for i in range(500)}
    copy = {i: (u, h if i not in (7, 8, 130) else h[: len(h) // 2] if i != 8 else "~" + h[1:]) for i, (u, h) in rows.items() if i not in (211, 499)} | {900: ("http://new", "x")}

    def laid(pages):
        out, at = {}, Counter()
        for i in sorted(pages):
            body = pages[i][1].encode()
            payload = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {pages[i][0]}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
            out[i] = (at[i // 100], hashlib.sha256(payload).hexdigest())
            at[i // 100] += len(payload)
        return out

    a, b = laid(rows), laid(copy)
    want = {i: "missing" if i not in b else "extra" if i not in a else "corrupt" if a[i][1] != b[i][1] else "moved" for i in a.keys() | b.keys() if a.get(i) != b.get(i)}
    frames = [warc_audit.records(spark.createDataFrame([(i, u, h, "z", 1) for i, (u, h) in x.items()], "page_id long, url string, html string, digest string, file long"), 100) for x in (rows, copy)]
    got = {x.record_id: (x.status, x.expected, x.found) for x in warc_audit.audit(*frames).collect()}
    assert got == {i: (s, a.get(i, (0, None))[1], b.get(i, (0, None))[1]) for i, s in want.items()}
    assert Counter(want.values())["moved"] > 100


def test_audit_of_repeated_pages_and_pages_without_id(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (None, "u", "c"), (None, "u", "c"), (None, None, None)]
    frame = lambda x: warc_audit.records(spark.createDataFrame(x, "page_id long, url string, html string"))
    assert warc_audit.audit(frame(rows), frame(rows[::-1])).count() == 0
    assert [(r.record_id, r.status) for r in warc_audit.audit(frame(rows), frame(rows[1:])).collect()] == [(1, "corrupt")]
    assert [(r.record_id, r.status) for r in warc_audit.audit(frame(rows), frame(rows[:3] + rows[4:])).collect()] == [(None, "corrupt")]
    assert [(r.record_id, r.status) for r in warc_audit.audit(frame(rows), frame(rows[:5])).collect()] == [(None, "missing")]


def test_only_differing_branches_reach_the_records(spark):
    original = warc_audit.records(spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("h" * 50_000).alias("html")))
    levels = warc_audit.tree(original)
    assert [x.count() for x in levels][-1] == 1 and levels[0].count() > 16


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages_one_by_one(spark, prose, tmp_path):
    passage = ("This passage of more than fifty words goes through several texts. It stands in the middle of the lines of those that hold it. "
               "None of them is the same as any other in all the rest of its words. The first of them keeps it and from all others it is cut out by the stage.")
    items = {1: prose(30, 900)}
    texts = {i: prose(150, i) for i in range(8)}
    texts |= {10: texts[0], 11: texts[1].replace("the", "THE", 1), 12: "### $$$ " * 100, 13: None, 14: "too short", 15: "again and again " * 60,
              20: prose(80, 30) + ". " + passage + " " + prose(60, 31), 21: prose(80, 32) + ". " + passage + " " + prose(60, 33), 30: prose(70, 34) + " " + items[1] + " " + prose(70, 35)}
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/stage{i}")
        docs = spark.read.parquet(f"{d}/stage{i}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if i == 2:
            cut = {r.doc_id: r.text for r in docs.collect()}
    assert ids[0] == set(texts) - {12, 13, 14, 15}
    assert ids[1] == ids[0] - {10, 11}
    assert ids[2] == ids[1] and passage[:60] in cut[20] and passage[70:120] not in cut[21]
    assert ids[3] == ids[2] - {30} and ids[4] == ids[3]
    final = docs.collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) == len(r.offsets) for r in final)
    run = corpus_pipeline.run(spark, d)
    assert {(r.doc_id, tuple(r.ids)) for r in run.collect()} == {(r.doc_id, tuple(r.ids)) for r in final}
