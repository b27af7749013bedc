"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Defined cases: a null or empty text has no words, hence fails the base rule; a null threshold is open; equal rows
are judged alike; an empty table gives an empty result; other columns pass through, but for one named quality, which score() sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for as with was on be by this are or from an a at "
    "de la le et les des en un du une que est pour qui dans par au pas sur "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "el los se del las con para una su al lo como y"
).split()

#: (rule, measure, least, most); a document is kept if each measure lies within its bounds, ends included.
THRESHOLDS = [
    ("length", "n_words", 50, None),
    ("mean_word_length", "mean_word_length", 3.0, 10.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("letters", "letter_word_ratio", 0.8, None),
    ("stop_words", "stop_word_ratio", 0.08, None),
    ("repeated_lines", "dup_line_ratio", None, 0.4),
    ("long_lines", "words_per_line", None, 2000.0),
]


def repeat_words(w: Column) -> Column:
    """Words covered by a window of three words that is found twice or more in the array.

    Windows are compared by a 64-bit hash; sorting (hash, place) puts equal windows side by side.
    """
    h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s: F.filter(s, lambda x, k: (
        (k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    places = lambda s: F.sort_array(F.transform(same(s), lambda x: x["i"]))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    # A one-element transform binds a value once: otherwise each mention would compute it again.
    let = lambda value, f: F.transform(F.array(value), f)[0]
    found = let(h, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(pairs(h), lambda s: let(places(s), covered))))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(found).cast("long")


def measures(text: Column) -> Column:
    """All counts and ratios of a text as one struct."""
    t = F.coalesce(text, F.lit(""))
    no_stop = F.lit(0).cast("long")

    def per(w: Column, lines: Column) -> Column:
        n = F.size(w)
        n_lines = F.size(lines)
        # Split words are looked up with their closing punctuation removed and A-Z lower-cased.
        stops = F.size(F.filter(w, lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(STOP_WORDS)))
        letters = F.size(F.filter(w, lambda x: x.rlike(r"\p{L}")))
        chars = F.length(F.array_join(w, ""))
        symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))
        dup = n_lines - F.size(F.array_distinct(lines))
        return F.struct(
            n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words"),
            F.coalesce(stops.cast("long"), no_stop).alias("n_stop_words"), letters.cast("long").alias("n_letter_words"),
            n_lines.cast("long").alias("n_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(F.struct(words(t).alias("w"), lines.alias("l"))), lambda x: per(x["w"], x["l"]))[0]


def ratios(m: Column) -> dict[str, Column]:
    """The measures that THRESHOLDS may name, from the struct of counts; a ratio of nothing is 0."""
    over = lambda a, b: F.coalesce(F.try_divide(m[a].cast("double"), m[b].cast("double")), F.lit(0.0))
    return {
        "n_words": m["n_words"], "mean_word_length": over("word_chars", "n_words"), "symbol_ratio": over("n_symbols", "n_words"),
        "letter_word_ratio": over("n_letter_words", "n_words"), "stop_word_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"), "words_per_line": over("n_words", "n_lines"),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def verdict(m: Column, thresholds: list[tuple] = THRESHOLDS) -> Column:
    """True if no threshold is crossed."""
    r = ratios(m)
    ok = F.lit(True)
    for _, name, least, most in thresholds:
        if least is not None:
            ok = ok & (r[name] >= least)
        if most is not None:
            ok = ok & (r[name] <= most)
    return ok


def broken_rules(m: Column, thresholds: list[tuple] = THRESHOLDS) -> Column:
    """The names of the rules that a text breaks."""
    r = ratios(m)
    return F.filter(F.array(*[
        F.when((F.lit(False) if least is None else r[name] < least) | (F.lit(False) if most is None else r[name] > most), rule)
        for rule, name, least, most in thresholds]), lambda x: x.isNotNull())


def score(docs: DataFrame, text: str = "text", thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """docs with one more column, quality: struct of counts, base_failed, kept and broken_rules."""
    m = measures(F.col(text))
    return docs.withColumn("quality", m).withColumn("quality", F.col("quality").withField(
        "base_failed", base_failed(F.col("quality"))).withField(
        "kept", ~base_failed(F.col("quality")) & verdict(F.col("quality"), thresholds)).withField(
        "broken_rules", broken_rules(F.col("quality"), thresholds)))


def kept(docs: DataFrame, text: str = "text", thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    names, m = docs.columns, "__measures"
    return docs.withColumn(m, measures(F.col(text))).where(~base_failed(F.col(m)) & verdict(F.col(m), thresholds)).select(*names)
