"""The corpus pipeline: select, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, exact_dedup, minhash, packing, quality
from millrace.llm.common import documents, drop_saved, intermediates, saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return quality.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a similarity of 0.8 or more in five-word shingles."""
    return minhash.drop_near_copies(docs, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contamination rule allows."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the n-gram models nor the tokenizer; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Only the last stage's written result is left; what the stages wrote on their way is deleted."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before = docs
        with intermediates(spark) as made:
            docs = saved(stage(spark, before, sf_dir), f"pipeline-{name}")
            made.remove(docs._millrace_path)
        drop_saved(before)
    return docs
