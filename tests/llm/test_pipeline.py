"""The whole pipeline against a brute-force version, and its defined cases."""

import random
import subprocess
import sys

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline  # noqa: E402
from fleetmill.llm import byte_bpe, decontaminate, quality_rules  # noqa: E402
from fleetmill.llm.queries import SUBSTRING_SIZES  # noqa: E402

from test_corpus_operators import brute_components, brute_overlap, brute_spans  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long, text_key string, ids string, count long, component_id long"


def tables(spark, folder, rows, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "i", 1, 2) for i, t in rows], KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def clean_text(r, n):
    """Words that pass the quality rules, none of them alike by chance."""
    out = []
    for i in range(n):
        out.append(r.choice("the of and to in is that it for as with".split()) if i % 3 == 0 else "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))))
        if i % 14 == 13:
            out[-1] += ".\n" if i % 28 == 27 else "."
    return " ".join(out).replace("\n ", "\n")


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(11)
    passage, item = clean_text(r, 80).replace("\n", " "), clean_text(r, 24).replace("\n", " ")
    texts = {i: clean_text(r, r.randrange(90, 200)) for i in range(12)}
    texts |= {20: texts[3], 21: texts[4] + " end", 22: texts[5].upper(), 30: None, 31: "", 32: "## " * 90, 33: "too short a text", 34: clean_text(r, 3000)}
    texts |= {40 + i: clean_text(r, 90).rstrip(".\n") + " so " + passage + " and " + clean_text(r, 60) for i in range(3)}
    words = item.split()
    words[5] = words[15] = "other"
    texts |= {50: clean_text(r, 80) + " " + " ".join(words) + " " + clean_text(r, 70), 51: texts[0].split("\n")[0] + "\n" + clean_text(r, 120)}
    folder = tables(spark, str(tmp_path), list(texts.items()), [(1, item), (2, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {x.doc_id for x in quality_rules.score(docs).collect() if x.quality.kept}
    assert kept >= set(range(12)) and not kept & {30, 31, 32, 33}
    left = {i: texts[i] for i in kept}
    left = {i: t for i, t in left.items() if brute_components(left, 5, 4, 5)[i][1] == i}
    assert not left.keys() & {20, 21, 22}
    gone = brute_spans(left, **SUBSTRING_SIZES)
    left = {i: "".join(c for at, c in enumerate(t) if at not in gone.get(i, ())) for i, t in left.items()}
    assert passage[100:200] in left[40] and passage[100:200] not in left[41] + left[42]
    left = {i: t for i, t in left.items() if brute_overlap(t, item) < decontaminate.LEAST}
    assert 50 not in left
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = {x.doc_id: x for x in corpus_pipeline.run(spark, folder).collect()}
    # Cut stretches may differ by white space beside them: the words and their ids are the same.
    assert {i: "".join(library.decode(x.ids).split()) for i, x in rows.items()} == {i: "".join(t.split()) for i, t in left.items()}
    assert all(x.ids == library.encode_ordinary(library.decode(x.ids)) and x.n_tokens == len(x.ids) == len(x.offsets) and x.round_trip for x in rows.values())
    assert all(library.decode(rows[i].ids) == t for i, t in left.items() if i not in gone)


def test_pipeline_of_rows_that_share_ids_or_have_none(spark, tmp_path):
    r = random.Random(5)
    a, b, c, d = (clean_text(r, 150) for _ in range(4))
    folder = tables(spark, str(tmp_path), [(1, a), (1, b), (1, b), (2, c), (None, d), (None, None), (3, a)], [(None, "x")])
    rows = corpus_pipeline.run(spark, folder).collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = sorted((x.doc_id or 0, library.decode(x.ids)) for x in rows)
    # Of the copies of a one stays: that whose id is its alone, as rows that share an id come after the others.
    assert got == sorted([(0, d), (1, b), (2, c), (3, a)])


def test_pipeline_of_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, tables(spark, str(tmp_path), [], []))
    assert out.count() == 0 and {"doc_id", "lang", "source", "ids", "offsets", "n_tokens", "round_trip"} <= set(out.columns)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_a_broken_import_is_not_swallowed():
    code = "import sys; sys.modules['pyarrow'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=__file__.rsplit("/", 3)[0])
    assert done.returncode and b"pyarrow" in done.stderr
