"""A training corpus from raw documents: STAGES in order, each of which takes the rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, ngram_join, pii, quality, sentencepiece_codec
from lodestone.llm.common import stored

STAGES = [
    ("quality_classifier", quality.pipeline_stage),
    ("ngram_jaccard_join", ngram_join.pipeline_stage),
    ("benchmark_decontamination", decontamination.pipeline_stage),
    ("pii_pseudonyms", pii.pipeline_stage),
    ("sentencepiece_encoding", sentencepiece_codec.pipeline_stage),
]

#: Trained models and tokenizer merges have no SQL form; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
