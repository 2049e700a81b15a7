"""The corpus-cleaning pipeline over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.pipeline import decontaminate, drop_near_copies, drop_repeats, drop_toxic, encode_pieces
from leafmill.storage import stored

STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
