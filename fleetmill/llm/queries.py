"""One query for each operator of this folder, over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, class_lm, conversation_repair, decontaminate, html_extract, jaccard_join, licences, license_scan, periodic_runs, quality_rules, substring_dedup, toxicity,
               url_filters, warc_audit)
from .common import table, written

#: Repeated lines of fewer words stay, and so do runs of repeated sentences: formulas that unlike texts share by chance.
SUBSTRING_SIZES = {"min_words": 5, "run_words": 20}

#: Rules of the URL query: (verdict, host, start of the path).
URL_RULES = [
    ("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"),
    ("block", "example.net", "de/8"), ("block", "org", "es/"),
]

#: Sites whose pages make up the list of blocked URLs in the URL query.
LISTED_SITES = ["spam-farm", "cheap-pills", "casino-win", "ads-track", "free-bets"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality_rules.score(docs)
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_letter_words", "n_lines", "broken_rules")])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files at source/language/shelf/id, some of them one or two levels higher."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    level = F.when(F.col("doc_id") % 31 == 0, F.col("source")).when(F.col("doc_id") % 7 == 0, F.concat_ws("/", "source", "lang")).otherwise(
        F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string")))
    return license_scan.scan(docs.select("doc_id", F.concat_ws("/", level, F.col("doc_id").cast("string")).alias("path"), "text"), licences.TEMPLATES)


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica is made of the pages and hashed like them: bytes of some records changed, some cut short, some lost anywhere."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.when(F.col("page_id") % 2003 == 7, F.substring("html", 1, 700)).when(F.col("page_id") % 23 == 5, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    copy = pages.where(F.coalesce(F.col("page_id") % 3001 != 11, F.lit(True))).withColumn("html", html)
    return warc_audit.audit(warc_audit.records(pages), warc_audit.records(copy))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    site = F.regexp_extract(url_filters.host(F.col("url")), r"([^.]+)\.[^.]+\.[^.]+$", 1)
    listed = written(pages.where(site.isin(LISTED_SITES)).select(url_filters.canonical(F.col("url")).alias("canonical")).distinct())
    return url_filters.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.linked(docs, k=3, num=9, den=10).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(table(spark, sf_dir, "documents").select("doc_id", "text"), **SUBSTRING_SIZES)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts go on periodically from some word on."""
    return periodic_runs.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), planted=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations are damaged first; the repair sees the damaged rows alone."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.digests(rows, conversation_repair.damaged(rows))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is fitted to labelled rows that aren't held out, and scores all."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held))
    return toxicity.scores(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits", "weight")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_license_scan, op3_warc_audit, op4_class_lm, op5_url_filter, op6_jaccard_join, op7_decontaminate, op8_byte_bpe, op9_html_extract, op10_substring_dedup,
    op11_periodic_runs, op12_conversation_repair, op13_toxicity)}
