"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

Terms are runs of letters, digits, dots, + and -, lower-cased. Inverse document frequencies of the templates'
terms come from all texts; a term of no template weighs as much as one of no text. Each part of a text (a line; a
paragraph, that is lines up to a blank one; the comment at the top, blank lines and all; the whole) is compared with each
template if it has a marker. Markers are the rarest terms of each template, so many that by Cauchy-Schwarz no part
without any of them reaches LEAST: however common a licence is, nothing is lost. If the whole reaches LEAST, its best
cosine gives the text's own licence, as the notices that long licences quote must not make headers of them; else the
best cosine of LEAST or more of any part does; of equal ones it is the last by licence. A text whose first line with
words, or whose whole, is a licence is a licence file of its directory; a file without own licence inherits from the nearest directory at or above
its own that has a licence file, by joins on the paths' ancestors. Of several in one directory the one with the least
path, then the first by licence, holds.

Defined cases: a null text has no licence of its own; a null path is at the root; repeated paths are each reported;
without templates or texts the result has no licences or no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

LEAST = 0.7

_TERM = re.compile(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?")


#: Lines that are comments, or blank.
_COMMENT = re.compile(r"\s*(?:$|//|/\*|\*|#|--|;|<!--|%|\.\.|'|\"\"\")")


def parts(text: str) -> list[tuple[str, str]]:
    """(kind, part): the lines with words, paragraphs of several lines, the comment at the top, and the whole; kind: file or header."""
    lines = text.split("\n")
    worded = [x for x in lines if x.strip()]
    out = [("header" if i else "file", x) for i, x in enumerate(worded)]
    paragraph: list[str] = []
    for x in [*lines, ""]:
        if x.strip():
            paragraph.append(x)
        else:
            if 1 < len(paragraph) < len(worded):
                out.append(("header", "\n".join(paragraph)))
            paragraph = []
    top = list(takewhile(_COMMENT.match, lines))
    if 1 < sum(bool(x.strip()) for x in top) < len(worded):
        out.append(("header", "\n".join(top)))
    return [*out, ("file", text)]


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(texts, texts that have each term of the templates)."""
    wanted = frozenset(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen.update(wanted.intersection(terms(text)))
                seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])

    rows = files.select("text").mapInArrow(of, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each template term
    found = {r.term: r.n for r in rows}
    return found.pop("", 0), found


class Matcher:
    """Cosines of a text's parts to all templates."""

    def __init__(self, templates: list[tuple[str, str]], n: int, df: dict[str, int]) -> None:
        idf = lambda t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1
        self.default = math.log(n + 1) + 1
        tf = [(name, Counter(terms(text))) for name, text in templates]
        self.idf = {t: idf(t) for _, c in tf for t in c}
        vectors = []
        for name, c in tf:
            v = {t: k * self.idf[t] for t, k in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            if norm:
                vectors.append((name, {t: x / norm for t, x in v.items()}))
        self.names = [name for name, _ in vectors]
        self.weights: dict[str, list[tuple[int, float]]] = {}  # of each term: the templates that have it, with its weight there times its idf
        for i, (_, v) in enumerate(vectors):
            for t, x in v.items():
                self.weights.setdefault(t, []).append((i, x * self.idf[t]))
        markers: set[str] = set()
        for _, v in vectors:
            rest = 1.0  # a text with none but the other terms has a cosine of at most the root of their squares
            for t in sorted(v, key=lambda t: (-self.idf[t], -v[t], t)):
                if rest < LEAST**2 - 1e-9:
                    break
                markers.add(t)
                rest -= v[t] ** 2
        found = "|".join(map(re.escape, sorted(markers, key=lambda t: (-len(t), t))))
        self.marker = re.compile(f"(?:{found})(?![a-z0-9+])") if markers else None

    def cosine(self, text: str) -> tuple[float, str]:
        """(cosine, licence) of the nearest template."""
        c = Counter(terms(text))
        norm = math.sqrt(sum((k * self.idf.get(t, self.default)) ** 2 for t, k in c.items()))
        dots = [0.0] * len(self.names)
        for t in self.weights.keys() & c.keys():
            for i, w in self.weights[t]:
                dots[i] += w * c[t]
        return max(((dot / norm, name) for dot, name in zip(dots, self.names, strict=True)), default=(0.0, "")) if norm else (0.0, "")

    def match(self, text: str | None) -> tuple[float, str, str] | None:
        """(cosine, licence, kind) of the whole if that is a licence, else of the best part; kind: file or header."""
        text = (text or "").lower()
        if not self.marker or not self.marker.search(text):
            return None
        *inside, (kind, whole) = parts(text)
        best = (*self.cosine(whole), kind)
        if best[0] < LEAST:
            best = max(((*self.cosine(part), kind) for kind, part in inside if self.marker.search(part)), default=best)
        return best if best[0] >= LEAST else None


def own_licences(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, path, licence, kind, cosine) of every file; nulls where it has none of its own."""
    n, df = document_frequencies(files, sorted({t for _, text in templates for t in terms(text)}))
    held = files.sparkSession.sparkContext.broadcast(Matcher(templates, n, df))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [held.value.match(t) for t in batch.column(2).to_pylist()]
            cols = [pa.array([m and m[1] for m in found], pa.string()), pa.array([m and m[2] for m in found], pa.string()), pa.array([m and round(m[0], 9) for m in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "path", "licence", "kind", "cosine"])

    return files.select("doc_id", "path", "text").mapInArrow(of, "doc_id long, path string, licence string, kind string, cosine double")


def scan(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, path, licence, kind, cosine, source) of every file (doc_id, path, text).

    kind: file, header, inherited or none; source: the path whose text gave the licence.
    """
    own = written(own_licences(files, templates).withColumn("dir", F.coalesce(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1), F.lit(""))))
    given = own.where("kind = 'file'").groupBy("dir").agg(F.min_by(F.struct("licence", "path"), F.struct(F.coalesce("path", F.lit("")), "licence")).alias("given"))
    dirs = own.where("licence is null").select("dir").distinct()
    steps = F.split("dir", "/")
    # Every directory with itself and all above it, the root last: as many rows as it is deep.
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("up")))).alias("a")).select("dir", "a.depth", "a.up")
    # Written, so that both sides of the next join are shuffled for it and Spark can split a very large directory.
    nearest = written(above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("given", "depth").alias("given")))
    lacking = own.where("licence is null").join(nearest, "dir", "left").select(
        "doc_id", "path", F.col("given.licence").alias("licence"), F.when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("kind"),
        F.lit(None).cast("double").alias("cosine"), F.col("given.path").alias("source"))
    return own.where("licence is not null").select("doc_id", "path", "licence", "kind", "cosine", F.col("path").alias("source")).union(lacking)
