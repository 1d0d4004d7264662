"""Corpus pipeline: toxic, low-quality, duplicate and benchmark-leaking documents go; what is left is
encoded into pieces. Each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, neardup, pieces, quality, toxicity
from tessera.llm.shared import run_dir

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality", quality.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]
#: Trained classifiers and a tokenizer library: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
