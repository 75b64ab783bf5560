"""The corpus pipeline: five stages over documents, each reading what the one before it wrote.

Every function takes (spark, docs, sf_dir). All but the last return the columns of docs.

quality: documents that the boosted trees reject (score under 0.7) go. near_duplicates: of documents linked by word
shingles, directly or through others, the one with the smallest doc_id stays. substrings: words in windows of 50 that
an earlier document holds, too, are cut out. decontamination: documents of which 5 % of the words or more are of
benchmark phrases go, and such words are cut out of the rest. tokens: adds ids, n_tokens and the decoded text.

Null or empty texts pass the stages that cut and are judged as empty by the first; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import bpe, fm_decontaminate, gbt_quality, parity_join, rlz_dedup
from timberline.llm.common import ensure_workers, materialize, read

THRESHOLD = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = gbt_quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", 4, 2)
    return gbt_quality.accept(docs, model, THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return parity_join.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return rlz_dedup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return bpe.with_tokens(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL cannot train the trees nor merge tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
