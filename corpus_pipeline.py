"""The corpus pipeline: toxic documents go, near copies go, benchmark leaks go, sources are mixed, tokens are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import decontamination, mixing, near_dedup, token_files, toxicity
from attestor.llm.common import documents, table, write_through
from attestor.session import scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled rows of ``docs`` and drops what scores 0.5 or more."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs, null_ids=True)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes from it; documents it takes nothing from go."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token files."""
    return token_files.encode_documents(docs, scratch_dir(spark, "token-files")).drop("part", "pos")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Learning, MinHash and tokenizers can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
