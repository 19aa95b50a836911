"""Percentiles, indices, tiers, selection and rolling windows, all with total orders."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridact.session import cut


def midrank(df: DataFrame, value: str, name: str, population: Sequence[str] = ()) -> DataFrame:
    """Zero-anchored mid-rank percentile in each population: values of 0 or less map to 0, others to (below + equal / 2) / n.

    Counts are taken per distinct value first, so the ordered window runs over distinct values and not over rows.
    """
    keys = list(population)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("equal"))
    w = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("equal").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = (below + 0.5 * F.col("equal")) / F.sum("equal").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = counts.select(*keys, value, F.round(F.when(F.col(value) <= 0, F.lit(0.0)).otherwise(share), 6).alias(name))
    return df.join(ranked, [*keys, value], "left")


def weighted_available(values: Mapping[str, float]) -> tuple[Column, Column, Column]:
    """(mean, coverage, missing): weighted mean of the columns that have a value, their share of weight, and the others' names."""
    total = sum(values.values())
    known = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in values.items()), F.lit(0.0))
    summed = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in values.items()), F.lit(0.0))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(values)]))
    return F.when(known > 0, summed / known), known / total, missing


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place 1..n of each row in a total order, without one task seeing all rows.

    Rows are sorted by range, numbered within their range and written; the ranges' sizes, one row each, give what to add.
    """
    numbered = cut(df.orderBy(*order).withColumn("rank_id", F.monotonically_increasing_id()), "rank")
    placed = numbered.withColumns({"rank_part": F.shiftright("rank_id", 33), "rank_in": F.col("rank_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("rank_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("rank_part", before.alias("rank_before"))  # a row for each range
    joined = placed.join(F.broadcast(offsets), "rank_part")
    return joined.withColumn(name, F.col("rank_before") + F.col("rank_in") + 1).drop("rank_id", "rank_part", "rank_in", "rank_before")


def instability(df: DataFrame, weights: Mapping[str, float], logarithmic: Sequence[str]) -> DataFrame:
    """``df`` with score (0 to 100), weight_coverage and missing_inputs.

    Each metric, after log1p where named, is scaled by its least and greatest value; one that is constant scores 0. A
    missing one leaves the mean and lowers the coverage. The bounds are one aggregate row, taken first.
    """

    def shaped(c: str) -> Column:
        return F.log1p(F.col(c).cast("double")) if c in logarithmic else F.col(c).cast("double")

    bounds = df.agg(*[f(shaped(c)).alias(f"{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for c in weights:
        low, high = F.lit(bounds[f"lo_{c}"]).cast("double"), F.lit(bounds[f"hi_{c}"]).cast("double")
        scaled[f"n_{c}"] = F.when(F.col(c).isNull(), F.lit(None)).when(high == low, F.lit(0.0)).otherwise((shaped(c) - low) / (high - low))
    joined = df.withColumns(scaled)
    mean, coverage, _ = weighted_available({f"n_{c}": w for c, w in weights.items()})
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(weights)]))
    out = joined.withColumns({"score": F.round(100 * mean, 4), "weight_coverage": F.round(coverage, 6), "missing_inputs": missing})
    return out.drop(*scaled)


def tiers(df: DataFrame, order: Sequence[Column], shares: Sequence[tuple[str, str]], rest: str) -> DataFrame:
    """``df`` with rank and tier. A tier's share of rows, as a decimal literal, is cumulative and rounded up exactly."""
    ranked = global_rank(df, order)
    total = Decimal(ranked.count())
    tier, sofar = None, Decimal(0)
    for name, share in shares:
        sofar += Decimal(share)
        bound = F.lit(math.ceil(total * sofar))
        tier = F.when(F.col("rank") <= bound, F.lit(name)) if tier is None else tier.when(F.col("rank") <= bound, F.lit(name))
    return ranked.withColumn("tier", tier.otherwise(F.lit(rest)))


def effective_cap(n: Column, share: str, floor: int, ceiling: int) -> Column:
    """min(max(floor, ceil(share * n)), ceiling), exactly."""
    return F.least(F.greatest(F.lit(floor), F.ceil(n.cast("decimal(20,0)") * F.lit(Decimal(share))).cast("long")), F.lit(ceiling))


def proportional(df: DataFrame, module: str, order: Sequence[Column], minimum: int, share: str, target: int) -> DataFrame:
    """Rows selected in three passes, with the pass: each module's first ``minimum``, its quota, then the best of all.

    Passes are ordered before rows are counted off, so ``target`` cuts the last pass first.
    """
    w = Window.partitionBy(module)
    placed = df.withColumn("in_module", F.row_number().over(w.orderBy(*order))).withColumn("module_size", F.count("*").over(w))
    quota = F.ceil(F.col("module_size").cast("decimal(20,0)") * F.lit(Decimal(share)))
    turn = F.when(F.col("in_module") <= minimum, F.lit(1)).when(F.col("in_module") <= quota, F.lit(2)).otherwise(F.lit(3))
    ordered = placed.withColumn("turn", turn).orderBy("turn", *order).limit(target)
    return ordered.drop("in_module", "module_size")


def max_normalised(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``df`` with score and coverage: each signal over its greatest value, then the weighted mean of those that have one."""
    top = df.agg(*[F.max(c).alias(c) for c in weights]).first()
    joined = df.withColumns({f"n_{c}": F.col(c) / F.lit(top[c]) if (top[c] or 0) > 0 else F.when(F.col(c).isNotNull(), F.lit(0.0)) for c in weights})
    mean, coverage, _ = weighted_available({f"n_{c}": w for c, w in weights.items()})
    return joined.withColumns({"score": F.round(mean, 6), "coverage": F.round(coverage, 6)}).drop(*[f"n_{c}" for c in weights])


def rolling_peak(df: DataFrame, unit: str, at: str, days: int) -> DataFrame:
    """(unit, peak, peak_start): most events in a half-open window of so many days, and the earliest such window."""
    seconds = days * 86_400_000_000 - 1
    w = Window.partitionBy(unit).orderBy("at_us").rangeBetween(0, seconds)
    stamped = df.select(unit, F.col(at).alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"))
    counted = stamped.withColumn("n", F.count("*").over(w))
    return counted.groupBy(unit).agg(F.max("n").alias("peak"), F.min_by("at", F.struct(-F.col("n"), "at_us")).alias("peak_start"))


def running_clamp(df: DataFrame, keys: Sequence[str], position: str, at: str) -> DataFrame:
    """``df`` with effective, the least time so far in walk order, and whether a row's own time was later than that."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("effective", F.min(at).over(w)).withColumn("clamped", F.col(at) > F.col("effective"))


def first_ordinal(df: DataFrame, actor: str, position: str) -> DataFrame:
    """(actor, ordinal): actors numbered by first appearance. The window runs over actors, not rows."""
    first = df.groupBy(actor).agg(F.min(position).alias("first"))
    return first.select(actor, F.row_number().over(Window.orderBy("first", actor)).alias("ordinal"))


def bus_factor(shares: DataFrame, keys: Sequence[str], actor: str, amount: str, share: float) -> DataFrame:
    """(keys, top_share, bus_factor): the largest share, and the fewest actors who together reach ``share``."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.col(amount).desc(), actor)
    run = F.sum(amount).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(amount).over(w)
    out = shares.withColumn("reached", run).withColumn("place", F.row_number().over(order)).withColumn("own", F.col(amount) / F.sum(amount).over(w))
    return out.groupBy(*keys).agg(F.round(F.max("own"), 6).alias("top_share"), F.min(F.when(F.col("reached") >= share, F.col("place"))).alias("bus_factor"))


def repeats_within(df: DataFrame, keys: Sequence[str], at: str, days: int) -> DataFrame:
    """(keys, repeats): events that follow the one before within so many days."""
    previous = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return df.withColumn("before", previous).groupBy(*keys).agg(F.count_if(F.col(at) <= F.col("before") + F.expr(f"INTERVAL {days} DAYS")).alias("repeats"))


def drop_contained(df: DataFrame, chain: str, key: str) -> DataFrame:
    """Chains that are no contiguous part of a longer one. Chains meet on their first step, not all with all."""
    starts = df.select(F.col(key).alias("long_key"), F.col(chain).alias("long"), F.explode(F.array_distinct(F.col(chain))).alias("step"))
    mine = df.withColumn("step", F.element_at(chain, 1))
    n = F.size(chain)
    places = F.sequence(F.lit(1), F.size("long") - n + 1)
    inside = F.exists(places, lambda i: F.slice(F.col("long"), i, n) == F.col(chain))
    met = mine.join(starts, "step").filter((F.size("long") > n) & F.when(F.size("long") > n, inside))
    return df.join(met.select(key).distinct(), key, "left_anti")
