"""The corpus pipeline: toxicity, near-duplicates, benchmark contamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last returns their tokens' digests.
Stages handle nulls, empty texts, repeated rows and empty tables as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixcorpus.llm import bpe, decontam, neardup, secrets, toxicity
from fixcorpus.llm.common import drop_stored, fresh, given_out, scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from labelled documents among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.harmless(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id; documents without words stay."""
    rows = neardup.grouped(docs, width=5, percent=80).where("kept")
    empty = F.when(F.col("n_shingles") == 0, F.col("fp"))
    own, id_, fp = fresh(docs, "_own"), fresh(docs, "_id"), fresh(docs, "_fp")
    chosen = rows.groupBy("doc_id", "component_id", empty.alias("_empty")).agg(F.min("fp").alias(fp)).select(F.col("doc_id").alias(id_), fp)
    rows = docs.withColumn(own, F.xxhash64("text"))
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(fp)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found within its word edits."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark.

    Findings come from the ledger at the path in the session's setting ``fixcorpus.ledger``, which stays there, so that a later
    run scans only texts and rules that it lacks; without the setting, from one of this run's own.
    """
    at = spark.conf.get("fixcorpus.ledger", None) or scratch(spark, "ledger")
    return secrets.redact(docs, secrets.updated(docs, at, path="doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of all documents."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("byte-level BPE", encode),
]

#: Training, signatures and merges can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), given_out()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
            drop_stored(spark, before, but=1)
    return docs
