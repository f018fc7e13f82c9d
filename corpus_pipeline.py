"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents that the operator calls toxic (scored at ``toxicity.TOXIC`` or more) go; the model learns from the labelled rows of the stage's input.
2. n-gram Jaccard join: of each group of linked documents the one with the smallest doc_id stays.
3. benchmark decontamination: documents of which 5 per cent or more of the words lie in benchmark windows go.
4. secret scans: secrets are replaced by a mark; every document stays.
5. byte-level BPE: token counts and digests of every text that is left.

All but the last return the columns of their input, extra ones included.

Defined results: a null doc_id is no document's copy and is kept by stage 2; every other stage judges its text like any other. Rows that
share a doc_id are one document: stage 2 keeps or drops them together (repeated rows all stay), the other stages judge each row's text.
Null and empty texts are not toxic, no copy, have no windows and no secrets, and are encoded as no tokens; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import byte_bpe, decontamination, jaccard_join, secrets, toxicity
from keyloom.llm.common import broadcast_if_small, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.filtered(docs, model, toxicity.TOXIC)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard_join.jaccard_groups(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(broadcast_if_small(stored(gone, "pipeline-copies")), "doc_id", "left_anti").select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(docs.select("doc_id", "text")))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(docs, *byte_bpe.vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokenized),
]
#: No SQL: the stages learn models, join by similarity and encode; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '_')}", spark)
    return docs
