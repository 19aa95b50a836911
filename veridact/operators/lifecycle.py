"""Upserts, comparison between snapshots, and decision tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layered_upsert(layers: DataFrame, key: str, layer: str, modified: str) -> DataFrame:
    """The surviving row per key when layers are applied oldest first.

    A row replaces the one before if either has no ``modified``, or the new is not older. So after the last row without one, the latest
    modified survives (of equals the last layer); if that last row without one comes last, it does.
    """
    w = Window.partitionBy(key)
    last_null = F.max(F.when(F.col(modified).isNull(), F.col(layer))).over(w)
    alive = layers.withColumn("last_null", last_null).filter(F.col("last_null").isNull() | (F.col(layer) >= F.col("last_null")))
    order = w.orderBy(F.col(modified).desc_nulls_last(), F.col(layer).desc())
    return alive.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place", "last_null")


def newest_only(rows: DataFrame, key: str, modified: str, body: str) -> tuple[DataFrame, DataFrame]:
    """The row with the latest ``modified`` per key, and the keys where one ``modified`` has different bodies."""
    conflicts = rows.groupBy(key, modified).agg(F.count_distinct(body).alias("n")).filter("n > 1").select(key, modified)
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(row, F.struct(modified, body)).alias("row")).select("row.*"), conflicts


def compare(prior: DataFrame, current: DataFrame, matches: DataFrame, key: str, covered: str) -> DataFrame:
    """(prior_id, current_id, state): what became of each finding of the first snapshot and what each of the second is.

    ``matches`` holds (prior_id, current_id). A prior finding without match is not_redetected, or not_covered if its unit
    (``covered``, a boolean of the prior row) wasn't looked at again.
    """
    a = prior.select(F.col(key).alias("prior_id"), F.coalesce(covered, F.lit(False)).alias("seen") if isinstance(covered, Column) else F.coalesce(F.col(covered), F.lit(False)).alias("seen"))
    b = current.select(F.col(key).alias("current_id"))
    met = matches.select("prior_id", "current_id")
    old = a.join(met, "prior_id", "left").select("prior_id", "current_id", F.when(F.col("current_id").isNotNull(), F.lit("persisting")).when(F.col("seen"), F.lit("not_redetected")).otherwise(F.lit("not_covered")).alias("state"))
    new = b.join(met, "current_id", "left_anti").select(F.lit(None).cast(prior.schema[key].dataType).alias("prior_id"), "current_id", F.lit("new").alias("state"))
    return old.unionByName(new)


def trend(before: DataFrame, after: DataFrame, lower_is_better: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(metric, before, after, state) of metric tables (metric, value): missing, incomplete, regression, improved or passed."""
    both = before.select("metric", F.col("value").alias("before"), F.lit(True).alias("had")).join(after.select("metric", F.col("value").alias("after"), F.lit(True).alias("has")), "metric", "full_outer")
    change = F.when(F.col("metric").isin(list(lower_is_better)), F.col("before") - F.col("after")).otherwise(F.col("after") - F.col("before"))
    state = (
        F.when(F.col("has").isNull(), F.lit("missing")).when(F.col("had").isNull(), F.lit("new"))
        .when(F.col("before").isNull() | F.col("after").isNull(), F.lit("incomplete"))
        .when(change < -tolerance, F.lit("regression")).when(change > tolerance, F.lit("improved")).otherwise(F.lit("passed"))
    )
    return both.select("metric", "before", "after", state.alias("state"))


def crosswalk(facts: DataFrame, scope: str, rules: Sequence[tuple[str, Sequence[Column]]]) -> DataFrame:
    """(scope, tag): a rule's tag for every scope in which each of its conditions holds for some row. One aggregation."""
    flags = [F.bool_or(F.coalesce(c, F.lit(False))).alias(f"r{i}_{j}") for i, (_, conditions) in enumerate(rules) for j, c in enumerate(conditions)]
    grouped = facts.groupBy(scope).agg(*flags)
    tags = []
    for i, (tag, conditions) in enumerate(rules):
        held = F.lit(True)
        for j in range(len(conditions)):
            held = held & F.col(f"r{i}_{j}")
        tags.append(F.when(held, F.lit(tag)))
    return grouped.select(scope, F.explode(F.array_compact(F.array(*tags))).alias("tag"))


def first_true(rows: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """A decision table: the outcome of the first row whose condition holds; an unknown condition doesn't."""
    out = None
    for condition, outcome in rows:
        out = F.when(condition, F.lit(outcome)) if out is None else out.when(condition, F.lit(outcome))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def exactly_one(df: DataFrame, key: str, buckets: Sequence[tuple[str, Column]]) -> DataFrame:
    """Keys that don't fall in exactly one bucket, with the buckets they fall in."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in buckets]))
    return df.select(key, hits.alias("buckets")).filter(F.size("buckets") != 1)


def points_interval(known: Column, low: Column, high: Column, bands: Sequence[tuple[int, str]]) -> Column:
    """struct<low, high, rating>: a rating from points if unknown ones can't change it, else null. Bands: least points, name."""

    def band(p: Column) -> Column:
        out = None
        for least, name in sorted(bands, reverse=True):
            out = F.when(p >= least, F.lit(name)) if out is None else out.when(p >= least, F.lit(name))
        return out

    a, b = known + low, known + high
    return F.struct(a.alias("low"), b.alias("high"), F.when(band(a) == band(b), band(a)).alias("rating"))
