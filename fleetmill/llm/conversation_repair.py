"""Conversation structure repair by weighted interval parsing of each conversation's rows.

The grammar's nonterminals are pairs [p, q] of places in a dialogue `(s?(ua)+)?`: the edits of a span that take the
dialogue from p to q. In Chomsky normal form: [p, q] -> [p, r] [r, q], and for one row Keep, Rerole or Delete. Inserted
turns are the cells of the empty span; the closure of a cell puts them before and behind it. A cell holds the least
(cost, audit). Audits of one span and cost are never beginnings of each other (what follows would be inserted turns,
which cost), so the least of two parts joined is the join of the least ones, and the chart is exact.

The chart of up to BLOCK rows is filled bottom-up by span length over all splits. As every split of a span gives the
same cells, longer conversations join the cells of their blocks, again bottom-up, so that work grows with the number of
rows, not with its cube. A row matters by one letter only, and each sequence of letters is parsed once in a task.

Rows of a conversation are never held together: a sorted pass reads one letter a row, a second one, behind the audit,
feeds the repaired rows to the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced

#: Places in a dialogue: before it, after the system turn, after a user's turn, after an assistant's. The first and last may end it.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
PLACES = (EMPTY, SYSTEM, USER, ASSISTANT)
STEPS = {(EMPTY, SYSTEM): "s", (EMPTY, USER): "u", (SYSTEM, USER): "u", (USER, ASSISTANT): "a", (ASSISTANT, USER): "u"}

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Rows whose spans and splits are all filled in.
BLOCK = 16

#: Rows of a conversation come by turn (nulls first), then role, the first 64 characters, and the digest of role and text;
#: nth tells equal ones apart. So the pass over letters carries no whole texts.
ORDER = ("turn", "role", "start", "digest", "nth")  # Spark sorts nulls first

Cells = dict[tuple[int, int], tuple[int, str]]


def _by_start(b: Cells) -> dict[int, list[tuple[int, int, str]]]:
    out: dict[int, list[tuple[int, int, str]]] = {}
    for (r, q), (d, y) in b.items():
        out.setdefault(r, []).append((q, d, y))
    return out


def _join_into(out: Cells, a: Cells, b: dict[int, list[tuple[int, int, str]]]) -> None:
    """The binary rules over two spans that meet, b's cells by their first place; out keeps the least."""
    for (p, r), (c, x) in a.items():
        for q, d, y in b.get(r, ()):
            old = out.get((p, q))
            if old is None or c + d < old[0] or (c + d == old[0] and x + y < old[1]):
                out[p, q] = (c + d, x + y)


def _join(a: Cells, b: Cells) -> Cells:
    out: Cells = {}
    _join_into(out, a, _by_start(b))
    return out


def _least(a: Cells, b: Cells) -> Cells:
    return {k: min(x for x in (a.get(k), b.get(k)) if x) for k in a.keys() | b.keys()}


@cache
def inserted() -> Cells:
    """Cells of the empty span: user's and assistant's turns put in, until nothing gets cheaper."""
    once = {k: (INSERT, "I") for k, role in STEPS.items() if role != "s"}
    cells: Cells = {(p, p): (0, "") for p in PLACES}
    while (more := _least(cells, _join(cells, once))) != cells:
        cells = more
    return cells


@cache
def leaf(letter: str) -> Cells:
    """Cells of one row, with turns put in on both sides. Letters: x must go, else s, u, a or o for other roles; upper case: truncated."""
    cells: Cells = {(p, p): (DELETE, "D") for p in PLACES}
    if letter != "x":
        cut = TRUNCATED if letter.isupper() else 0
        for k, role in STEPS.items():
            edits = [(cut, "K")] if role == letter.lower() else []
            edits += [(REROLE + cut, "R")] if role != "s" else []
            if edits:
                cells[k] = min(edits)
    return _join(_join(inserted(), cells), inserted())


def chart(letters: str) -> Cells:
    """Cells of the whole of a few rows: every span from every split, the shortest spans first."""
    spans: dict[tuple[int, int], Cells] = {(i, i + 1): leaf(x) for i, x in enumerate(letters)}
    starts = {k: _by_start(c) for k, c in spans.items()}
    for size in range(2, len(letters) + 1):
        for i in range(len(letters) - size + 1):
            cells: Cells = {}
            for k in range(i + 1, i + size):
                _join_into(cells, spans[i, k], starts[k, i + size])
            spans[i, i + size], starts[i, i + size] = cells, _by_start(cells)
    return spans[0, len(letters)] if letters else inserted()


@lru_cache(maxsize=100_000)
def _block(letters: str) -> Cells:
    return chart(letters)


def parse(letters: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows with these letters."""
    cells = [_block(letters[i : i + BLOCK]) for i in range(0, len(letters), BLOCK)] or [inserted()]
    while len(cells) > 1:
        cells = [_join(cells[i], cells[i + 1]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return min(x for k, x in cells[0].items() if k in ((EMPTY, EMPTY), (EMPTY, ASSISTANT)))


def repaired(audit: str, initials: str) -> Iterator[tuple[int, str | None]]:
    """(row number or -1, new role or none to keep the row's) of each turn of the repaired conversation."""
    row = turn = 0
    for edit in audit:
        if edit == "K" and turn == 0 and initials[row] == "s":
            turn = -1  # a kept system turn stands before the first user's
        if edit != "D":
            yield row if edit != "I" else -1, None if edit == "K" else ("user", "assistant")[turn % 2]
            turn += 1
        row += edit != "I"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the query's damage, by the checksum of `conv_id:turn`: lost, emptied, cut, said twice or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), said.alias("text"),
                       F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _fault_columns(rows: DataFrame) -> tuple[Column, Column]:
    """(blank, truncated) of a row by its text alone."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)
    return last == "", ~last.isin(".", "!", "?")


def letters(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, start, nth, letter, initial, fault): each row's letter for the parser and its first fault, or none.

    A row repeats another of its conversation if role and text are equal and it comes later by turn (nulls first).
    """
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", "role", "text"), 256))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    blank, cut = _fault_columns(rows)
    rows = rows.withColumn("nth", nth).withColumn("fault", F.when(blank, "blank").when(F.col("nth") > 1, "duplicate").when(cut, "truncated"))
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("x")).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return rows.withColumns({"letter": letter, "initial": first, "start": F.substring("text", 1, 64)})


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, initials string"


def audits(marked: DataFrame) -> DataFrame:
    """A row for each conversation of `letters`: its faults, and the cheapest repair. One letter a row is held, no text."""
    def ended(state: dict) -> tuple:
        cost, audit = parse(state["letters"])
        span = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
        return (state["id"], span, *(state[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, audit, state["initials"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        for batch in sliced(batches, rows=4000):
            done = []
            for conv, turn, letter, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "letter", "initial", "fault")), strict=True):
                if state is None or state["id"] != conv:
                    if state is not None:
                        done.append(ended(_closed(state)))
                    state = {"id": conv, "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "prev": None, "l": [], "i": []}
                if turn is not None and turn != state["last"]:
                    state["first"] = turn if state["first"] is None else state["first"]
                    state["last"], state["turns"] = turn, state["turns"] + 1
                if fault:
                    state[fault] += 1
                if state["prev"] is not None and state["prev"] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["prev"] = initial
                state["l"].append(letter)
                state["i"].append(initial if initial == "s" else "-")
            yield _rows(done, AUDITS)
        if state is not None:
            yield _rows([ended(_closed(state))], AUDITS)

    few = marked.select("conv_id", *ORDER, "letter", "initial", "fault")
    ordered = few.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return ordered.select("conv_id", "turn", "letter", "initial", "fault").mapInArrow(scan, AUDITS)


def _closed(state: dict) -> dict:
    return {**state, "letters": "".join(state["l"]), "initials": "".join(state["i"])}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if kind == "string" else pa.int64()) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields])


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _ordered(marked: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order: what a task needs to repair it row by row."""
    rows = marked.select("conv_id", F.lit(1).alias("tag"), *ORDER, "text")
    both = rows.unionByName(audited.withColumn("tag", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "tag", *ORDER)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str | None, str | None]]:
    """(audit of a new conversation, none, none), then (none, role, text) of each of its repaired turns, in order."""
    edits: Iterator[tuple[int, str | None]] = iter(())
    todo: tuple[int, str | None] | None = None
    row = 0
    for batch in sliced(batches, rows=4000):
        heads = batch.select([c.split()[0] for c in AUDITS.split(", ")])
        for at, (tag, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tag", "role", "text")), strict=True)):
            if tag == 0:
                head = heads.slice(at, 1).to_pylist()[0]
                yield head, None, None
                edits, row = repaired(head["audit"], head["initials"]), 0
                todo = next(edits, None)
            while tag == 1 and todo and todo[0] == row:
                yield None, todo[1] or role, text
                todo = next(edits, None)
            row += tag
            while todo and todo[0] == -1:  # turns put in before the next row, or at the end
                yield None, todo[1], ""
                todo = next(edits, None)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations, turns numbered from 0.

    rows: conv_id, turn, role, text. Nulls in role or text count as one space; rows are taken by turn (nulls first),
    then role, the first 64 characters and a digest; rows of a null conv_id are one conversation. Other columns are ignored.
    """
    marked = letters(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))

    def write(batches):
        conv, n, done = None, 0, []
        for head, role, text in _turns(batches):
            if head is not None:
                conv, n = head["conv_id"], 0
                continue
            done.append((conv, n, role, text))
            n += 1
            if len(done) >= 1000:
                yield _rows(done, "conv_id long, turn long, role string, text string")
                done = []
        yield _rows(done, "conv_id long, turn long, role string, text string")

    return _ordered(marked, audits(marked)).mapInArrow(write, "conv_id long, turn long, role string, text string")


def digests(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations: faults, cost, audit and hash of its repaired rows; without rows zeros, an empty audit and the hash of nothing."""
    marked = letters(rows)

    def hashed(batches):
        head, sha, n, done = None, None, 0, []
        for new, role, text in _turns(batches):
            if new is not None:
                if head is not None:
                    done.append((*(head[c.split()[0]] for c in REPAIRED.split(", ")[:-1]), sha.hexdigest()))
                    if len(done) >= 1000:
                        yield _rows(done, REPAIRED)
                        done = []
                head, sha, n = new, hashlib.sha256(), 0
                continue
            sha.update((("\n" if n else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            n += 1
        if head is not None:
            done.append((*(head[c.split()[0]] for c in REPAIRED.split(", ")[:-1]), sha.hexdigest()))
        yield _rows(done, REPAIRED)

    found = _ordered(marked, audits(marked)).mapInArrow(hashed, REPAIRED).withColumn("__has", F.lit(1))
    ids = conversations.select("conv_id").distinct()
    found = ids.join(found.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
