"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each
result as Parquet and reads it again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import common, decontamination, mixing, near_dedup, quality_rules, token_output

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs.select(*DOCUMENT_COLUMNS))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id."""
    return near_dedup.drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs.select(*DOCUMENT_COLUMNS), common.read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their Poisson draws, in global random order."""
    return mixing.replicate(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written; the result has one row per written document, read back from them."""
    out = common.scratch_path(spark, "pipeline-tokens")
    token_output.write_tokens(docs, out)
    return token_output.token_digests(spark, out)


STAGES = [
    ("quality rules", quality),
    ("near dedup", deduplicate),
    ("decontamination", decontaminate),
    ("source mixing", mix),
    ("token output", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
