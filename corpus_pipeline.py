"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All
but the last return the columns of ``documents``. Stages drop whole documents (low or toxic quality, all but one of each
near-duplicate component, holders of a benchmark item) or change texts (secrets become a mark; n_chars follows).

Defined cases are those of the operators; a null text passes each filter as an empty one would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import decontaminate, grading, jaccard, packing, secrets
from panelweave.llm.common import fresh, modest_batches, written
from panelweave.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are of top grade rather than not."""
    modest_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return grading.accepted(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the smallest id, null ids last."""
    modest_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    modest_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    modest_batches(spark)
    chain, spans = secrets.train(docs), fresh(docs, "_spans")
    found = docs.withColumn(spans, secrets.secret_spans(F.col("text"), chain))
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).drop(spans)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences of 2048 tokens."""
    modest_batches(spark)
    return packing.packed_digest(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_removal),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the learned stages; tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for step, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if step + 1 < len(STAGES):
            docs = written(docs, f"stage{step}")
    return docs
