"""Periodic runs, conversation repair and toxicity: brute force, whole queries on small tables, edge cases."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetmill.llm import conversation_repair as cr
from fleetmill.llm import periodic_runs as pr
from fleetmill.llm import toxicity
from fleetmill.llm.oracles import OP12
from fleetmill.llm.queries import op11_periodic_runs, op12_conversation_repair, op13_toxicity

# --- periodic runs -------------------------------------------------------------------------------------------------


def brute_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1 if j == i else j
    return sorted((s, m, q) for (s, m), q in found.items())


def texts_with_runs(r):
    out = []
    for _ in range(r.randrange(6)):
        if r.random() < 0.5:
            unit = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 25))]
            n = r.randrange(1, 120)
            out += (unit * n)[:n]
        else:
            out += [r.randrange(60) for _ in range(r.randrange(80))]
    return out


def runs_of(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for t, *run in zip(*(x.tolist() for x in pr.find_runs(words, np.array([len(t) for t in texts], np.int64))), strict=True):
        out[t].append(tuple(run))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_runs_match_brute_force(seed):
    r = random.Random(seed)
    texts = [texts_with_runs(r) for _ in range(r.randrange(1, 8))]
    texts.append(list(texts[0]))  # equal texts side by side don't extend into each other
    assert runs_of(texts) == [brute_runs(t) for t in texts]


def test_runs_in_pieces_of_the_grid(monkeypatch):
    monkeypatch.setattr(pr, "GRID", 50)
    r = random.Random(99)
    texts = [texts_with_runs(r) for _ in range(6)]
    assert runs_of(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=90), st.data())
def test_extensions_match_brute_force(words, data):
    w = np.array([*words, 3])
    i, j = (data.draw(st.integers(0, len(words) - 1)) for _ in "ij")
    want = next((k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k]), 0)
    if i != j:
        assert pr.Extensions(w)(np.array([i]), np.array([j]))[0] == want


def test_every_pair_of_residues_meets_in_the_cover():
    assert pr.SHIFTS.shape == (pr.MOD, pr.MOD)
    assert all((i + d) % pr.MOD in pr.COVER and (j + d) % pr.MOD in pr.COVER for (i, j), d in np.ndenumerate(pr.SHIFTS))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, n, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.fixture
def run_docs(spark, prose):
    texts = [None, "", " \n\t", "one", "a " * 24, "a " * 23, "a b c " * 8, "a b c " * 7 + "a b", prose(300, 1), prose(40, 2) + " " + "x y z w v u t s r " * 5 + prose(30, 3), "é ü " * 30, prose(20, 4) * 4]
    rows = [(i, t, "n", "start") for i, t in enumerate(texts * 3)] + [(5, "again " * 30, "n", "s"), (5, "again " * 30, "n", "s"), (None, "q " * 50, "n", "s"), (77, " ".join(["w"] * 3000 + ["v", "w"] * 6000), "n", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start string")


@pytest.mark.parametrize("planted", [False, True])
def test_run_digests_match_brute_force(spark, run_docs, planted):
    got = [tuple(r) for r in pr.digests(run_docs, planted).collect()]
    rows = [(r.doc_id, r.text) for r in run_docs.collect() if r.doc_id != 77]
    want = [brute_row(i if planted else None, t) for i, t in rows]
    want = [(i, *w[1:]) for (i, _), w in zip(rows, want, strict=True)]
    assert sorted(map(repr, (g for g in got if g[0] != 77))) == sorted(map(repr, want))
    if not planted:
        long = next(g for g in got if g[0] == 77)
        assert long[1:7] == (15000, 2, 2999, 12001, 2, 6000500)


def test_query_on_a_table(spark, tmp_path, prose):
    rows = [(i, prose(60 + i, i) if i % 7 else ("ha " * i)) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {brute_row(*r) for r in rows}
    assert any(g[2] for g in got) and any(not g[2] for g in got)


def test_runs_and_collapsed(spark, run_docs):
    small = run_docs.where("doc_id = 6")
    assert [tuple(r) for r in pr.runs(small).collect()] == [(6, 0, 24, 3)]
    out = pr.collapsed(run_docs)
    assert out.schema == run_docs.schema and out.count() == run_docs.count()
    assert {r.text for r in out.where("doc_id = 6").collect()} == {"a b c"}
    untouched = {r.text for r in out.where("doc_id = 8").collect()}
    assert untouched == {r.text for r in run_docs.where("doc_id = 8").collect()}
    empty = run_docs.limit(0)
    assert pr.digests(empty).count() == pr.runs(empty).count() == pr.collapsed(empty).count() == 0


# --- conversation repair -------------------------------------------------------------------------------------------


def brute_repair(letters):
    """Least (cost, audit) by trying the dialogue from left to right with every string of edits kept."""
    best = {(0, "", 0)}
    put = {0: 2, 1: 2, 2: 3, 3: 2}

    def with_inserts(found):
        found = set(found)
        todo = list(found)
        while todo:
            cost, audit, place = todo.pop()
            new = (cost + 2, audit + "I", put[place])
            if not audit.endswith("III") and new not in found:
                found.add(new)
                todo.append(new)
        return found

    for x in letters:
        new = set()
        for cost, audit, place in with_inserts(best):
            new.add((cost + 3, audit + "D", place))
            if x != "x":
                cut = int(x.isupper())
                if (place, x.lower()) in {(0, "s"), (0, "u"), (1, "u"), (2, "a"), (3, "u")}:
                    new.add((cost + cut, audit + "K", 1 if x.lower() == "s" else put[place]))
                new.add((cost + 2 + cut, audit + "R", put[place]))
        best = set()
        for place in range(4):
            here = sorted(b for b in new if b[2] == place)
            best |= {b for b in here if b[0] <= (here[0][0] if here else 0)}  # dearer ones of a place never win
    return min((c, a) for c, a, place in with_inserts(best) if place in (0, 3))


@pytest.mark.parametrize("size", range(6))
def test_parse_matches_brute_force(size):
    letters = ["".join(x) for x in itertools.product("suaoxUA", repeat=size)]
    for x in letters if len(letters) < 400 else random.Random(size).sample(letters, 250):
        assert cr.parse(x) == brute_repair(x), x


def test_long_conversations_join_blocks():
    r = random.Random(3)
    for n in (15, 16, 17, 33, 40):
        letters = "".join(r.choice("suaoxSUA") for _ in range(n))
        cost, audit = cr.parse(letters)
        whole = cr.chart(letters)
        assert (cost, audit) == min(v for k, v in whole.items() if k in ((0, 0), (0, 3)))
        assert (cost, audit) == brute_repair(letters)


def test_every_split_of_a_span_gives_its_cells():
    letters = "suxaUuaxo"
    for k in range(1, len(letters)):
        assert cr._join(cr.chart(letters[:k]), cr.chart(letters[k:])) == cr.chart(letters)


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."),
    (2, 0, "assistant", "First"), (2, 0, "assistant", "First"), (2, 2, "user", ""), (2, 5, "user", " \t"),
    (3, None, "user", "no turn."), (3, None, "user", "no turn."), (3, 4, None, None), (3, 4, "tool", "x!"),
    (4, 0, "user", None), (5, None, "user", "alone"), (None, 1, "user", "whose?"), (None, 2, "assistant", "mine "),
    (6, 0, "system", "only system."), (7, 3, "user", "a."), (7, 9, "user", "b."), (7, 9, "user", "b."),
]


def conversations(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, cost int")


def brute_digest(rows):
    """rows of one conversation: (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    initial = [r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in rows]
    letters = "".join("x" if f in ("blank", "duplicate") else x.upper() if f else x for x, f in zip(initial, faults, strict=True))
    cost, audit = brute_repair(letters)
    out, k = [], 0
    for e in audit:
        if e == "K":
            out.append((rows[k][1], rows[k][2]))
        elif e in "RI":
            before = next((r for r, _ in reversed(out)), "assistant")
            out.append(("assistant" if before.startswith("u") else "user", rows[k][2] if e == "R" else ""))
        k += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def test_digests_match_brute_force(spark):
    df = conversations(spark)
    rows = df.selectExpr("conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text")
    got = {r[0]: tuple(r[1:]) for r in cr.digests(df, rows).collect()}
    want = {c: brute_digest([r[1:] for r in ROWS if r[0] == c]) for c in {r[0] for r in ROWS}}
    assert got == want
    assert cr.digests(df.limit(0), rows.limit(0)).count() == 0
    assert {tuple(r)[1:] for r in cr.digests(df, rows.limit(0)).collect()} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_gives_dialogues(spark):
    out = {}
    for r in sorted(cr.repair(conversations(spark)).collect(), key=lambda r: (str(r.conv_id), r.turn)):
        out.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert out[1] == [(0, "system", "Be kind."), (1, "user", "Hi!"), (2, "assistant", "Hello.")]
    assert out[7] == [(0, "user", "a."), (1, "assistant", "b.")]  # the second b. goes, the first changes its role
    for turns in out.values():
        roles = [r for _, r, _ in turns]
        roles = roles[1:] if roles[0] == "system" else roles
        assert len(roles) % 2 == 0 and roles == ["user", "assistant"] * (len(roles) // 2) and [t for t, _, _ in turns] == list(range(len(turns)))
    assert cr.repair(conversations(spark).limit(0)).count() == 0


def test_repair_query_against_sql_and_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = [(c, t, r.choice(["system", "user", "assistant", "user", "assistant", "tool"]), r.choice(["Yes.", "No!", "Well", "so: what?", "a. b", "…"])) for c in range(60) for t in range(r.randrange(1, 14))]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(200)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    got = op12_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(OP12)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    damaged = cr.damaged(spark.read.parquet(path)).collect()
    kinds = {zlib.crc32(f"{c}:{t}".encode()) % 20: (c, t) for c, t, _, _ in rows}
    assert not [d for d in damaged if (d.conv_id, d.turn) == kinds[0]]
    by_id = {x[0]: x for x in map(tuple, got.select(*names).collect())}
    for c in (3, 17, 1000):
        assert by_id[c][1:] == brute_digest([(d.turn, d.role, d.text) for d in damaged if d.conv_id == c])


# --- toxicity ------------------------------------------------------------------------------------------------------

BAD = ["grumblok", "snivelwort", "mudlump"]


def toxic_table(prose, n=400):
    r = random.Random(4)
    rows = []
    for i in range(n):
        w = prose(r.randint(20, 200), i).split(" ")
        bad = i % 5 == 0
        for _ in range(2 + len(w) // 40 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "s", "ish"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model(spark, prose):
    rows = toxic_table(prose)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 3 != 1] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    return rows, docs, toxicity.fit(docs, labels)


def test_held_out_accuracy(spark, model):
    rows, docs, m = model
    got = {r.doc_id: r for r in toxicity.scores(docs, m).collect()}
    held = [(x, got[i].predicted) for i, _, x in rows if i % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.TOXIC) for r in got.values())
    assert {e for e, _, _ in m.entries} & {toxicity.fold("grumblok"), toxicity.fold("mudlump")}


def test_disguises_exceptions_and_edges(spark, model):
    _, _, m = model
    a = toxicity.automaton(m.entries)
    plain, n, _ = toxicity.measure("you grumblok and mudlump here", a, m.weights)
    assert n == 2 and plain > 0
    for text in ("you grumb1ok and mud1ump here", "you GRUMBLOK and MUDLUMP here", "you grumbl0k and mudlumр here", "you gru​mblok, ｍudlump! here"):
        assert toxicity.measure(text, a, m.weights)[0] == plain, text
    texts = [None, "", " ", "12 34 !!", "clean words only", "grumblok mudlump snivelwort " * 3, "x " * 20000 + "grumblok " * 900]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(0, "grumblok mudlumps grumblok", "b"), (None, None, "c")]
    got = toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string, predicted string"), m).collect()
    assert [r.predicted for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, 0]
    assert got[0].score == got[1].score == got[8].score < 0.5
    assert toxicity.scores(spark.createDataFrame([], "doc_id long, text string"), m).count() == 0


def test_exception_phrases_do_no_harm():
    m = toxicity.Model([(toxicity.fold(w), 200, 0) for w in ("trash", "clown", "scum")], 0.1)
    a = toxicity.automaton(m.entries)
    hits = lambda t: toxicity.measure(t, a, m.weights)[1]
    assert hits("you trash clown scum") == 3
    assert hits("a trash can, a clown fish and pond scum") == 0
    assert hits("the trash cannot fish, clown") == 2  # phrases end where words end


def test_longer_clean_entries_are_exceptions_to_a_stem():
    m = toxicity.Model([("grumb", 100, 1), ("grumbie", 0, 50)], 0.1)
    a = toxicity.automaton(m.entries)
    assert toxicity.measure("grumblok", a, m.weights)[1] == 1
    assert toxicity.measure("grumble", a, m.weights)[1] == 0  # l folds to i


def test_no_labels_of_one_kind_give_low_scores(spark):
    docs = spark.createDataFrame([(1, "mud"), (2, "stone")], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)], [(1, 1), (2, 1)]):
        m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.predicted for r in toxicity.scores(docs, m).collect()] == [0, 0]


def test_copies_teach_once(spark):
    texts = [(i, f"word{i % 50} alpha beta gamma delta epsilon") for i in range(200)] + [(1000 + i, "rumour spreads quickly today alpha beta") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(i, int(i >= 1000)) for i, _ in texts], "doc_id long, toxic int"))
    assert not m.entries  # 300 copies are one context of each word


def test_toxicity_query(spark, tmp_path, model):
    rows, docs, _ = model
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op13_toxicity(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    truth = {i: x for i, _, x in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
