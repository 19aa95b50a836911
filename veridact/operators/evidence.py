"""Entities, locations, relations and coverage: scans, facets, identities and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a coverage row.
COVERAGE_STATES = ("complete", "partial", "unavailable", "stale")


def identity(kind: Column | str, snapshot: Column | str, native: Column | str) -> Column:
    """``asr:<kind>:<sha256>`` of kind, snapshot and native identity as canonical JSON."""
    kind, snapshot, native = (F.lit(x) if isinstance(x, str) else x for x in (kind, snapshot, native))
    parts = F.to_json(F.struct(kind.alias("kind"), native.cast("string").alias("native"), snapshot.alias("snapshot")))
    return F.concat(F.lit("asr:"), kind, F.lit(":"), F.sha2(parts.cast("binary"), 256))


def scan_entities(entities: DataFrame, locations: DataFrame, kinds: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entities with their locations, optionally of some kinds, by identity, and no more than ``limit``.

    The limit is a top-k on the order, so no full sort is shuffled.
    """
    if kinds is not None:
        entities = entities.filter(F.col("kind").isin(list(kinds)))
    joined = entities.join(locations, entities["identity"] == locations["entity_id"], "left").drop("entity_id").orderBy("identity")
    return joined.limit(limit) if limit is not None else joined


def find(df: DataFrame, facets: Mapping[str, object]) -> DataFrame:
    """Conjunction of exact facets; a facet of None is no predicate."""
    for column, value in facets.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def overlapping(start: Column, end: Column, low: object, high: object) -> Column:
    """Whether the closed range start..end meets low..high."""
    return (start <= F.lit(high)) & (end >= F.lit(low))


def nonzero_signal(metrics: Column, signal: str) -> Column:
    """Whether a map of metrics has that signal with a value other than zero; a missing one is no match."""
    return F.coalesce(F.try_element_at(metrics, F.lit(signal)) != 0, F.lit(False))


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def within_grants(facts: DataFrame, grants: DataFrame, scope: str) -> DataFrame:
    """Facts whose scope is granted."""
    return facts.join(grants.select(scope).distinct(), scope, "left_semi")


def excluded_counts(df: DataFrame, category: Column) -> DataFrame:
    """How many rows each exclusion category takes; rows without category stay and aren't counted."""
    return df.select(category.alias("category")).filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


def refuse(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """``df``, or an error at run time if any row is bad: complete or fail, never truncate."""
    return df.filter(F.when(bad, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True)))


def verify_counts(rows: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Counts by key where they differ from those declared."""
    actual = rows.groupBy(key).agg(F.count("*").alias("actual"))
    both = actual.join(declared.withColumnRenamed("n", "declared"), key, "full_outer")
    return both.filter(~F.col("actual").eqNullSafe(F.col("declared")))


def first_wins(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in that order. Reduced per partition before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(key).agg(F.min_by(row, rank).alias("row")).select("row.*")


def probe_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; equal sets give none."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
