"""A training-data pipeline over ``documents``: each stage works on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.shared import table, written

STAGES = [
    ("quality rules", stages.quality_rules),
    ("line dedup", stages.line_dedup),
    ("n-gram Jaccard join", stages.ngram_join),
    ("benchmark decontamination", stages.benchmark_decontamination),
    ("BPE encoding and decoding", stages.bpe_encoding),
]

#: Fuzzy lines and byte-pair encoding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
