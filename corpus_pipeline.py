"""A training-corpus pipeline: language identification, near duplicates, decontamination, secrets, and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet to shared storage and
reads it again as the next stage's documents, so that a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridact.llm import decontamination, language_id, mixing, secrets, simhash
from veridact.llm.common import table
from veridact.session import shared_path, ship

#: A document stays if its main language has at least this share of its letters.
LEAST_LANGUAGE_SHARE = 0.3
#: Near copies share at least this much of their five-word shingles (Jaccard similarity of the sets).
NEAR_SIMILARITY = 0.8


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or torn between languages, go. An unknown label is filled in."""
    model = language_id.fit(ship(spark) and docs, F.lit(True))
    return language_id.keep_identified(docs, model, LEAST_LANGUAGE_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return simhash.deduplicate(ship(spark) and docs, similarity=NEAR_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontamination.decontaminate(docs, table(ship(spark), sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The language model, least hashes, diagonals and the battery aren't expressible in SQL. A test holds run()'s rows against plain Python on a
#: small corpus (languages there by letters alone); the stages' own tests do so for what that corpus doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
