"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Quality rejects go, exact copies and near copies leave one document each, benchmark passages are cut out, and
the rest is mixed to the sources' target weights. The last stage writes the mixed corpus into the shared folder and returns what it
holds of every document that is left: doc_id, size, source_size, target and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import discard, stored, table
from tidewell.llm.decontaminate import remove_benchmark
from tidewell.llm.exact_dedup import drop_exact_copies
from tidewell.llm.minhash_dedup import keep_one_of_each
from tidewell.llm.mixing import mix
from tidewell.llm.quality import drop_rejected


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: A discriminant fitted to labels and seeded draws have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents; a stage's stored table is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = stored(out)
            if k:
                discard(docs)
        docs = out
    return docs
