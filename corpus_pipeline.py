"""Training-data pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the columns of
the documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweather import session
from gridweather.llm import decontaminate, minhash, pieces, pii, quality
from gridweather.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the compression bands and the plain counts."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8 or more."""
    return minhash.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, re-parameterised ones included."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing words replaced; n_chars follows the text."""
    return pii.sanitised(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes, exact of every document."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: zstandard ratios, MinHash bands and piece encoding have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
