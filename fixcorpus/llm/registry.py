"""Queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, htmltext, neardup, quality, secrets, spelling, substrings, suffixes, timeencode, toxicity, urlrules, warc
from .common import scratch, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"), width=4, percent=80).drop("fp")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a ledger of this call's own, so that it holds nothing yet and every blob is scanned
    ledger = secrets.updated(docs, scratch(spark, "ledger"), path="doc_id")
    return secrets.digest(secrets.findings(docs, ledger, path="doc_id"))


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeencode.encoded(*[table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")])


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spelling.vocabulary(table(spark, sf_dir, "documents"), every=199))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_bpe, op3_minhash_dedup, op4_suffix_dedup, op5_html_text, op6_url_filter, op7_substring_dedup, op8_decontaminate, op9_toxicity, op10_secret_scan, op11_target_encoding, op12_warc, op13_spelling_variants)}
ORACLES = {"op6_url_filter": urlrules.sql(), "op10_secret_scan": secrets.sql(), "op11_target_encoding": timeencode.sql(), "op12_warc": warc.sql(), "op13_spelling_variants": spelling.sql()}
