"""Aggregations that keep missing apart from zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the 97.5% point of the normal distribution.
Z95 = 1.959963984540054


def decayed(amount: Column, age_days: Column, half_life: float) -> Column:
    """Sum of amounts that halve every ``half_life`` days."""
    return F.sum(amount * F.pow(F.lit(0.5), age_days / half_life))


def entropy(counts: DataFrame, keys: Sequence[str], count: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of the counts of each group; one member has 0, never -0."""
    total = Window.partitionBy(*keys)
    p = F.col(count) / F.sum(count).over(total)
    return counts.withColumn("p", p).groupBy(*keys).agg(F.round(F.abs(F.sum(-F.col("p") * F.log2("p"))), 6).alias(name))


def normalised_entropy(bits: Column, n: Column) -> Column:
    """Entropy over its greatest value for n groups; 0 for one group or none."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(bits / F.log2(n))


def strict_sum(value: Column) -> Column:
    """A sum that is null if any value is."""
    return F.when(F.count(value) < F.count(F.lit(1)), F.lit(None)).otherwise(F.sum(value))


def strict_median(value: Column) -> Column:
    """A median that is null if any value is."""
    return F.when(F.count(value) < F.count(F.lit(1)), F.lit(None)).otherwise(F.median(value))


def closed_counts(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """Counts of every word of a closed vocabulary, zero included, and of null; any other value is an error."""
    spark = df.sparkSession
    words = spark.createDataFrame([(v, i) for i, v in enumerate([*vocabulary, "null"])], "value string, ordinal int")
    known = F.col(column).isNull() | F.col(column).isin(list(vocabulary))
    checked = F.when(known, F.coalesce(F.col(column), F.lit("null"))).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column))))
    counted = df.groupBy(checked.alias("value")).agg(F.count("*").alias("n"))
    return words.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """struct<status, value>: measured, empty_denominator or unavailable; the value is null unless measured."""
    status = F.when(numerator.isNull() | denominator.isNull(), F.lit("unavailable")).when(denominator == 0, F.lit("empty_denominator")).otherwise(F.lit("measured"))
    return F.struct(status.alias("status"), F.when(status == "measured", numerator / denominator).alias("value"))


def wilson(k: Column, n: Column) -> Column:
    """struct<low, high>: the 95% Wilson interval of a share; null without trials."""
    z2 = Z95 * Z95
    p = k / n
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high")))


def cumulative_histogram(df: DataFrame, value: Column, bounds: Sequence[float]) -> DataFrame:
    """(le, n): how many values are at most each bound, all measured ones, and the unmeasured. One aggregation row."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.agg(*counts, F.count(value).alias("inf"), F.count_if(value.isNull()).alias("unmeasured"))
    names = [*[(str(b), f"b{i}") for i, b in enumerate(bounds)], ("+Inf", "inf"), ("unmeasured", "unmeasured")]
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("le"), F.col(b).alias("n")) for a, b in names])))


def equal_shares(df: DataFrame, cost: str, members: str) -> DataFrame:
    """Cost by member if each row's cost is shared equally by the members of its array; rows without members give none."""
    return df.select((F.col(cost) / F.size(members)).alias("share"), F.explode(members).alias("member")).groupBy("member").agg(F.sum("share").alias("share"))


def agreeing(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row per key; its value is null if rows with that key disagree."""
    return df.groupBy(*key).agg(F.when(F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("\0"))) == 1, F.first(value)).alias(value), F.count("*").alias("rows"))


def pair_confidence(pairs: DataFrame, singles: DataFrame, member: str, total: str, min_support: int) -> DataFrame:
    """(left, right, support, confidence) in both directions, for pairs that occur in ``min_support`` groups."""
    support = pairs.groupBy("left", "right").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    both = support.union(support.select("right", "left", "support")).toDF("left", "right", "support")
    of = singles.select(F.col(member).alias("left"), F.col(total).alias("total"))
    return both.join(of, "left").select("left", "right", "support", (F.col("support") / F.col("total")).alias("confidence"))


def worst_state(state: Column, order: Sequence[str]) -> Column:
    """The worst state of a group, from best to worst in ``order``."""
    names = F.array(*[F.lit(s) for s in order])
    return F.element_at(names, F.max(F.array_position(names, state)).cast("int"))


def chunked(df: DataFrame, group: Sequence[str], order: Sequence[str], member: str, size: int) -> DataFrame:
    """Ordered members in partitions of a fixed size, each with the number of the next, or null."""
    w = Window.partitionBy(*group)
    placed = df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("members_all", F.count("*").over(w))
    part = F.floor((F.col("place") - 1) / size)
    last = F.floor((F.col("members_all") - 1) / size)
    grouped = placed.groupBy(*group, part.alias("part"), last.alias("last")).agg(F.sort_array(F.collect_list(F.struct("place", member))).alias("m"))
    return grouped.select(*group, "part", F.transform("m", lambda x: x[member]).alias("members"), F.when(F.col("part") < F.col("last"), F.col("part") + 1).alias("next_part"))
