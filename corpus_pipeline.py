"""Corpus preparation: documents to shards in five stages.

Every stage takes all that the one before kept, is written as Parquet and read again.  All stages but the last return the columns of
``documents``, extra ones with any names included; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taulab.llm import decontaminate, minhash, mixing, quality, sharding
from taulab.llm.tables import table
from taulab.llm.workspace import Workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do the documents that lose too much or fail the base rules.

    A null or empty text has no words and goes; repeated rows stay or go together.
    """
    return quality.cleaned_documents(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles stays.

    It is the one of the smallest id; of repeated rows one stays; documents without words and rows with a null id stay.
    """
    return minhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding a window of a benchmark item go, exactly or with words put in or left out.

    A null text holds none and stays; without benchmark items all stay.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for.

    Null is a source of its own; a document of no words is taken as often as is certain; repeated rows are taken as one with the copies of all.
    """
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every record; a null text has size 1, a null id is a record like others."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Mixing draws by a hash that DuckDB doesn't have; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
