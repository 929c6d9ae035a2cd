"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's documents.

Quality rules drop what they reject, near-dedup keeps one document per class, decontamination drops documents that
hold benchmark passages, mixing samples towards target weights, and the last stage writes token ids and returns, for
every document that is left, its place in the store. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.llm import bagminhash, decontaminate, mixing, quality_rules, token_store
from tamis.llm.common import materialize, scratch, table

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch(spark, "corpus")
    token_store.write_store(docs, path, token_store.public_file(TOKENIZER), END_ID)
    return token_store.digest(token_store.read_store(spark, path))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("tokens", tokens)]

#: The learned rules, the banding and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
