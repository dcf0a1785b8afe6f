"""The corpus pipeline: toxicity, near-duplicates, PII, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the docs
of the next one. All but the last return the columns of documents as they are,
whatever other columns there are and however they are named. Null texts are
empty, null and repeated doc_ids are rows like any other, and an empty table goes
through all stages; see each operator for details.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorikeet.llm.common import drop_path, read, scratch_path, scratch_scope
from lorikeet.llm.mixing import mixed_documents
from lorikeet.llm.packing import pack_documents
from lorikeet.llm.pii import pseudonymise
from lorikeet.llm.simhash import drop_near_duplicates
from lorikeet.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores as toxic go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles,
    a likeness of 0.8 or more."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return pseudonymise(docs, count=None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, repeated or left out until each source has its target."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, placed in as few sequences as can be. Fewer words
    are kept than alone, since the workers of the stages before hold memory too."""
    return pack_documents(docs, kept_words=60_000)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses neither the trained scores nor the packing search: the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents one after another."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as kept:  # a stage's own tables go when it is written
            path = scratch_path(spark, f"pipeline-{name}")
            kept.append(path)
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
