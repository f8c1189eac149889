"""The corpus pipeline: toxicity, exact copies, near copies, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; its result is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Stages that learn or compare read their other table from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcorpus.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from sqlcorpus.llm.common import table
from sqlcorpus.llm.queries import tokenizer_path
from sqlcorpus.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"), 5, 0))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained model, the fingerprints and the tokenizer; tests/llm/test_pipeline_survivors.py compares a run
#: with plain Python (without labels: which rows a fitted toxicity model drops is not compared).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
