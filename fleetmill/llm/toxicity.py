"""Toxicity by a weighted lexicon that labelled documents teach, matched by Aho-Corasick in folded text.

Folding lower-cases, maps letters that look alike across scripts, digits and signs that stand for letters to one
skeleton (so `c1own`, `clоwn` and `clown` agree), drops invisible characters and turns all else into spaces. Lexicon
entries are beginnings of words: inflected and compounded forms of a stem count without having been seen.

An entry's weight is the log of how much likelier a document is toxic if the entry stands in it, shrunk by PRIOR
imagined contexts. Contexts (the words beside it) are counted once each, so that a text and its thousand copies count
as one. Of entries that begin at one word the longest counts: entries with a weight of 0, learned from clean documents,
are exceptions to a shorter stem, and so are the phrases of EXCEPTIONS. A document's sum of weights, as it is and
against its length, goes through a logistic regression fitted to the same labelled rows; while fitting, a row's own
contexts are taken off its entries' counts.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

#: Labelled rows that the classifier is fitted to, at most; the ones with the least hashes of their ids.
FIT_ROWS = 20_000

#: Least and greatest length of an entry, in characters; least contexts in toxic documents; least weight; imagined contexts.
SHORTEST, LONGEST, CONTEXTS, WEIGHT, PRIOR = 4, 24, 3, 1.5, 8.0

#: Entries at most, the most telling ones; as many exceptions. This bounds what every task holds.
ENTRIES = 20_000

#: Score from which a document is predicted toxic.
TOXIC = 0.7

#: Phrases in which an entry does no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "idiot proof", "scum line", "pond scum", "stupid simple")

#: Letters that look like Latin ones (Cyrillic, then Greek), digits and signs that stand for letters, and the letters that
#: these stand for; i and l share a skeleton, as 1 stands for both.
LOOKALIKES = dict(zip("асеорхуікмтвнѕјԁɡһ", "aceopxyikmtbhsjdgh", strict=True)) | dict(zip("αβεικνορτυχ", "abeiknoptux", strict=True))
SUBSTITUTES = dict(zip("0134578@$|", "oieastbasi", strict=True)) | {"l": "i"}

#: Soft hyphen, zero-width space, non-joiner and joiner, word joiner, byte-order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class _Fold(dict):
    """A translation table that works out each character when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = "" if c in INVISIBLE else "".join(self._letter(x) for x in unicodedata.normalize("NFKC", c).lower())
        self[code] = out
        return out

    @staticmethod
    def _letter(c: str) -> str:
        c = LOOKALIKES.get(c, c)
        c = SUBSTITUTES.get(c, c)
        return c if c.isalpha() or unicodedata.combining(c) else " "


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """The text's skeleton: words of letters with spaces between."""
    return (text or "").translate(_FOLD)


def _fit_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): FIT_ROWS labelled rows at most. A row without text teaches nothing; one with two labels has the greater."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").distinct().join(known, "doc_id")
    chosen = written(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").dropDuplicates(["doc_id", "text"])


def _contexts(rows: DataFrame) -> DataFrame:
    """(word, toxic, contexts): in how many different pairs of neighbours a folded word stands, in toxic and other texts."""
    def seen(batches):
        for batch in sliced(batches):
            found = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                w = fold(text).split()
                found.update((x[:LONGEST], toxic, f"{a} {b}") for a, x, b in zip(["", *w], w, [*w[1:], ""], strict=False) if len(x) >= SHORTEST)
            found = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], ["word", "toxic", "beside"])

    pairs = rows.mapInArrow(seen, "word string, toxic int, beside string").select("word", "toxic", F.xxhash64("beside").alias("beside"))
    return pairs.distinct().groupBy("word", "toxic").agg(F.count("*").alias("n"))


def _weight(bad: float, good: float, share: float) -> float:
    """Log-odds of a toxic document at an entry against those at any word."""
    p = (bad + PRIOR * share) / (bad + good + PRIOR)
    return math.log(p / (1 - p)) - math.log(share / (1 - share))


def lexicon(rows: DataFrame) -> tuple[list[tuple[str, int, int]], float]:
    """([(entry, contexts in toxic texts, contexts in others)], share of contexts in toxic texts); 2 * ENTRIES entries at most.

    rows: text, toxic. Without toxic or without clean rows there are no entries.
    """
    words = written(_contexts(rows))
    sums = words.groupBy().agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("bad"), F.sum("n").alias("all")).first()
    if not sums["bad"] or sums["bad"] == sums["all"]:
        return [], 0.5
    share = sums["bad"] / sums["all"]
    begin = F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.length("word")), lambda k: F.substring("word", F.lit(1), k)))
    n = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0))
    counts = words.select(begin.alias("entry"), "toxic", "n").groupBy("entry").agg(n(1).alias("bad"), n(0).alias("good"))
    p = (F.col("bad") + PRIOR * share) / (F.col("bad") + F.col("good") + PRIOR)
    counts = counts.withColumn("weight", F.log(p / (1 - p)) - math.log(share / (1 - share)))
    counts = written(counts.where((F.col("bad") >= CONTEXTS) & (F.col("weight") >= WEIGHT) | (F.col("weight") < 0)))
    best = counts.where(F.col("weight") >= WEIGHT).orderBy(F.desc("weight"), "entry").limit(ENTRIES)
    stems = written(best.select("entry", "bad", "good"))
    # Beginnings that clean texts have, behind a stem: exceptions.
    shorter = F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.length("entry") - 1), lambda k: F.substring("entry", F.lit(1), k)))
    longer = counts.where((F.col("weight") < 0) & (F.length("entry") > SHORTEST)).select("entry", "bad", "good", shorter.alias("stem"))
    clean = longer.join(F.broadcast(stems.select(F.col("entry").alias("stem"))), "stem", "left_semi").select("entry", "bad", "good").distinct()
    clean = clean.orderBy(F.desc("good"), "entry").limit(ENTRIES)
    return [tuple(r) for r in stems.collect() + clean.collect()], share  # two bounded lists


def automaton(entries: list[tuple[str, int, int]]) -> ahocorasick.Automaton:
    """The entries as beginnings of words and the phrases of EXCEPTIONS; each gives (length, number of the entry or -1)."""
    a = ahocorasick.Automaton()
    for k, (entry, _, _) in enumerate(entries):
        a.add_word(" " + entry, (len(entry) + 1, k))
    for phrase in EXCEPTIONS:
        f = " " + " ".join(fold(phrase).split())
        a.add_word(f + " ", (len(f) + 1, -1))
    if len(a):
        a.make_automaton()
    return a


def measure(text: str | None, a: ahocorasick.Automaton, weights: list[float], own=None) -> tuple[float, int, int]:
    """(sum of weights, hits, words) of a text. own: gives other weights from how often each entry stands in the text, or None for no entry."""
    words = fold(text).split()
    if not words or not len(a):
        return 0.0, 0, len(words)
    met = [(end - length + 1, length, k) for end, (length, k) in a.iter(" " + " ".join(words) + " ")]
    if own is not None:
        weights = own(Counter(k for _, _, k in met if k >= 0))
    harmless = [(at, at + length) for at, length, k in met if k < 0]
    longest: dict[int, float] = {}  # matches of one beginning come the shorter ones first
    for at, _, k in met:
        if k >= 0 and (w := weights[k]) is not None:
            longest[at] = w
    hits = [w for at, w in longest.items() if w > 0 and not any(lo <= at < hi for lo, hi in harmless)]
    return sum(hits), len(hits), len(words)


class Model:
    """A lexicon with weights and the regression over a document's sum of weights; small enough for every task."""

    def __init__(self, entries: list[tuple[str, int, int]], share: float):
        self.entries, self.share = entries, share
        self.weights = [max(0.0, _weight(bad, good, share)) for _, bad, good in entries]
        self.intercept, self.coefficients = -3.0, (0.0, 0.0)

    def without(self, toxic: int):
        """Weights as they were without one text's own contexts."""
        def own(counts: Counter) -> dict[int, float | None]:
            out: dict[int, float | None] = {}
            for k, n in counts.items():
                _, bad, good = self.entries[k]
                bad, good = max(0, bad - n * toxic), max(0, good - n * (1 - toxic))
                w = _weight(bad, good, self.share)
                out[k] = w if bad >= CONTEXTS and w >= WEIGHT else 0.0 if good and w < 0 else None
            return out
        return own

    @staticmethod
    def features(total: float, words: int) -> list[float]:
        """The sum of weights on a log scale, and against the length."""
        return [math.log1p(total), total / math.sqrt(words + 1.0)]

    def score(self, total: float, words: int) -> float:
        z = self.intercept + sum(c * x for c, x in zip(self.coefficients, self.features(total, words), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labelled documents: docs doc_id, text; labels doc_id, toxic (0 or 1).

    Rows without id, text or label teach nothing. Without rows of both labels every document gets one low score.
    """
    rows = written(_fit_rows(docs, labels))
    entries, share = lexicon(rows)
    model = Model(entries, share)
    if not entries:
        return model

    def measured(batches):
        a = automaton(entries)
        for batch in sliced(batches):
            out = [(t, *model.features(*measure(x, a, model.weights, model.without(t))[::2])) for x, t in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.float64()), pa.array([[*o[1:]] for o in out], pa.list_(pa.float64()))], ["label", "x"])

    x = rows.select("text", "toxic").mapInArrow(measured, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    lr = LogisticRegression(regParam=1e-4, maxIter=200, tol=1e-9).fit(written(x))
    model.intercept, model.coefficients = float(lr.intercept), tuple(float(c) for c in lr.coefficients)
    return model


SCORES = "doc_id long, score double, predicted int, n_hits long, weight double"


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_hits, weight) of each row of docs: score from 0 to 1, predicted 1 from TOXIC on.

    Null and empty texts have no hits; rows that repeat id or text are scored each for itself; other columns are ignored.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(model.entries)
        for batch in sliced(batches):
            found = [measure(t, a, model.weights) for t in batch.column("text").to_pylist()]
            s = [model.score(total, n) for total, _, n in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= TOXIC) for x in s], pa.int32()),
                                              pa.array([f[1] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.float64())], ["doc_id", "score", "predicted", "n_hits", "weight"])

    return docs.select("doc_id", "text").mapInArrow(scored, SCORES)
