"""The corpus pipeline: stages that each take documents and return documents, written between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxweave.llm import bpe, mixing, neardup, quality, substrings
from fluxweave.llm.tables import stored, table

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", neardup.stage),
    ("substring dedup", substrings.stage),
    ("source mixing", mixing.stage),
    ("byte-level BPE", bpe.stage),
]
# a trained network, sampled hashes and merge ranks cannot be said in SQL; tests/llm/test_pipeline.py has the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
