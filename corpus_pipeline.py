"""The corpus pipeline: language ID, near-duplicate removal, mixing, SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import cross_parsing, mixing, order_minhash, piece_lattice
from sitelens.llm.common import stored

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language", cross_parsing.stage),
    ("near_duplicates", order_minhash.stage),
    ("mix", mixing.stage),
    ("pieces", piece_lattice.stage),
]
#: Cross-parsing, alignment and segmentation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder, read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
