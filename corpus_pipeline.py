"""From raw documents to packed token sequences, in five stages over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontam, jaccard, packing, pii, quality
from sparkloom.llm.common import materialize, remove

STAGES = [
    ("quality classifier", quality.keep_good),
    ("n-gram Jaccard join", jaccard.keep_one),
    ("benchmark decontamination", decontam.drop_contaminated),
    ("PII surrogates", pii.clean_stage),
    ("best-two-fit packing", packing.pack_stage),
]

#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written before the next stage reads it, and then what it was made from goes."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if written is not None:
            remove(spark, written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
