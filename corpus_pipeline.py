"""The corpus pipeline: quality, near copies, benchmark passages, secrets, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import stages
from leafmill.llm.common import Scratch, ship, table

STAGES = [
    ("quality classifier", stages.by_quality),
    ("n-gram Jaccard join", stages.one_of_near_copies),
    ("benchmark decontamination", stages.without_benchmark),
    ("secret scans", stages.without_secrets),
    ("SentencePiece encoding and decoding", stages.as_pieces),
]

#: SQL cannot express the trained classifier; tests/llm/test_pipeline.py holds the stages against slow versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again."""
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(before)
    return docs
