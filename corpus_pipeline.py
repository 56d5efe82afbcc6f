"""A training-data pipeline of five stages; each is written as Parquet and read again by the next.

Quality rules reject documents, one document of each near-duplicate group stays
(the one with the smallest id), documents that hold a benchmark item go, secrets
are replaced in the text (n_chars follows), and the last stage adds token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import byte_bpe, decontamination, ngram_join, quality_rules, secret_scan
from weir.llm.common import documents, saved

# Every stage: null and empty texts, very long ones and rows without an id come through as its operator
# defines (the operators' docstrings say how); extra columns stay; an empty table gives an empty one.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go: without a text, with fewer than 10 words, repetitive, or caught by a learned rule."""
    rules = quality_rules.fit(docs, documents(spark, sf_dir, "labels"))
    return quality_rules.assess(docs, rules).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of rows that share an id one stays; rows without an id stay."""
    member = ngram_join.linked(docs.select("doc_id", "text"))
    gone = member.where("component_id <> doc_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = saved(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go; repeated rows alike, and rows without an id stay."""
    found = decontamination.contaminated(docs.select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in every row, and n_chars follows where there is a text."""
    clean = secret_scan.redacted_table(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; null and empty texts have none."""
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return out.withColumn("n_tokens", F.coalesce(F.size("token_ids"), F.lit(0)).cast("bigint"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("secret_scans", secrets), ("byte_bpe", tokens)]

#: Learned rules, components and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
