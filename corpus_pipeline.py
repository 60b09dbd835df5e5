"""From documents to token ids: five stages, each over all that the one before it kept.

Every stage's result is written as Parquet into the shared folder and read again as the next stage's documents. All
stages but the last return the columns of documents.

Defined cases, in every stage: a null or empty text passes the toxicity stage, is one near-duplicate group (one row of
it stays), has nothing to redact, is of size 0 and so never mixed in; null ids and null sources are values like any other;
rows repeated as they are are near copies of each other; extra columns go along up to the last stage, whatever their
names; no rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm import bpe, mixing, pii, simhash, toxicity
from cairnflow.llm._common import remove, scratch, shared_dir, table
from cairnflow.llm.queries import RANKS, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those at hand, scores below one half."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more connect: Jaccard similarity of five-word shingle sets, checked on candidates that SimHash finds."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans of personal data give way to their kind in brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.mix(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, exact (the ids decode to the text)."""
    return bpe.encode(docs, tokenizer_file(RANKS))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", to_token_ids),
]

#: No SQL expresses the toxicity and SimHash stages; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):  # a stage's checkpoints go once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # what the stage before returned has been read
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
