"""Joins beyond equality, all of them planned as equi-joins: intervals, prefixes, as-of, tiers, best candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDRESS_BITS = 32


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int, tolerance: int = 0) -> DataFrame:
    """Pairs with equal keys whose closed integer ranges meet, give or take ``tolerance``.

    Both sides are dealt to bins of ``width``; a pair is kept only in the first bin that both share, so none comes twice.
    Column names of the two sides must differ but for ``keys``.
    """
    (ls, le), (rs, re_) = left_range, right_range

    def bins(df: DataFrame, start: Column, end: Column) -> DataFrame:
        return df.withColumn("bin", F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(end, start) / width))))

    a = bins(left, F.col(ls) - tolerance, F.col(le) + tolerance)
    b = bins(right, F.col(rs), F.col(re_))
    met = a.join(b, [*keys, "bin"])
    first = F.floor(F.greatest(F.col(ls) - tolerance, F.col(rs)) / width)
    return met.filter((F.col(ls) - tolerance <= F.col(re_)) & (F.col(rs) <= F.col(le) + tolerance) & (F.col("bin") == first)).drop("bin")


def address_prefixes(address: Column, bits: int = ADDRESS_BITS) -> Column:
    """The ``bits + 1`` dyadic blocks that hold an address, as (level, block)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(k.alias("level"), F.floor(address / F.pow(F.lit(2.0), k)).cast("long").alias("block"))
    )


def dyadic_cover(start: Column, end: Column, bits: int = ADDRESS_BITS) -> Column:
    """The fewest dyadic blocks that make up ``[start, end)``: at most two for each level.

    At level k, a block stands alone on the left if the rest's start is odd there, on the right if its end is.
    """

    def level(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        low, high = F.ceil(start / size).cast("long"), F.floor(end / size).cast("long")
        left = F.when((low < high) & (low % 2 == 1), low)
        right = F.when((low < high) & (high % 2 == 1) & ~((low % 2 == 1) & (high - 1 == low)), high - 1)
        return F.filter(F.array(left, right), lambda b: b.isNotNull())

    levels = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.transform(level(k), lambda b: F.struct(k.alias("level"), b.alias("block"))))
    return F.flatten(levels)


def point_in_interval(points: DataFrame, address: str, intervals: DataFrame, start: str, end: str, bits: int = ADDRESS_BITS) -> DataFrame:
    """Points with every interval ``[start, end)`` that holds them.

    Intervals become dyadic blocks, points the blocks that hold them; the range join is an equi-join on blocks. An interval's
    blocks are disjoint, so a pair comes once.
    """
    cover = intervals.withColumn("piece", F.explode(dyadic_cover(F.col(start), F.col(end), bits)))
    probe = points.withColumn("piece", F.explode(address_prefixes(F.col(address), bits)))
    return probe.join(cover, "piece").drop("piece")


def path_prefixes(path: Column) -> Column:
    """A path and all folders above it, down to the empty root."""
    parts = F.split(path, "/")
    return F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit("")))


def longest_prefix(df: DataFrame, path: str, roots: DataFrame, root: str, key: Sequence[str]) -> DataFrame:
    """Each row with the deepest root above its path, by joining all prefixes; rows below no root stay, with null."""
    probe = df.withColumn("prefix", F.explode(path_prefixes(F.col(path))))
    found = probe.join(roots.withColumnRenamed(root, "prefix"), "prefix")
    depth = F.length("prefix")
    best = found.groupBy(*key).agg(F.max_by("prefix", depth).alias(root))
    return df.join(best, list(key), "left")


def innermost(df: DataFrame, key: Sequence[str], low: str, high: str, tie: str) -> DataFrame:
    """Of the spans that hold a row, one per key: the shortest, then the one that begins last, then by ``tie``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.struct((F.col(high) - F.col(low)).alias("length"), (-F.col(low)).alias("later"), F.col(tie).alias("tie"))
    return df.groupBy(*key).agg(F.min_by(row, best).alias("row")).select("row.*")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, value: str, strict: bool = True) -> DataFrame:
    """Each left row with the right value last seen before it (or at it, unless ``strict``): one union, one window, no range join.

    Right columns are only ``keys``, ``right_at`` and ``value``. Rows at one time: strict puts left rows first.
    """
    side = F.lit(0 if strict else 1)
    a = left.withColumns({"asof_at": F.col(left_at), "asof_side": side, "asof_value": F.lit(None).cast(right.schema[value].dataType), "asof_left": F.lit(True)})
    b = right.select(*keys, F.col(right_at).alias("asof_at"), F.lit(1 - int(not strict)).alias("asof_side"), F.col(value).alias("asof_value"), F.lit(False).alias("asof_left"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("asof_at", "asof_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("last_" + value, F.last("asof_value", ignorenulls=True).over(w))
    return out.filter("asof_left").drop("asof_at", "asof_side", "asof_value", "asof_left")


def tiered_match(prior: DataFrame, current: DataFrame, key: str, tiers: Sequence[tuple[str, str]]) -> DataFrame:
    """One-to-one matches (prior, current, tier): equal values of the first tier's column, then of the next among the rest.

    Within a value, both sides are numbered by key and joined on the number, so each row is used once whatever the order
    of the input. A null value matches nothing.
    """
    out = None
    left, right = prior, current
    for name, column in tiers:
        w = Window.partitionBy(column).orderBy(key)
        a = left.filter(F.col(column).isNotNull()).select(F.col(key).alias("prior_id"), F.col(column).alias("tier_value"), F.row_number().over(w).alias("place"))
        b = right.filter(F.col(column).isNotNull()).select(F.col(key).alias("current_id"), F.col(column).alias("tier_value"), F.row_number().over(w).alias("place"))
        met = a.join(b, ["tier_value", "place"]).select("prior_id", "current_id", F.lit(name).alias("tier"))
        out = met if out is None else out.union(met)
        left = left.join(met.select(F.col("prior_id").alias(key)), key, "left_anti")
        right = right.join(met.select(F.col("current_id").alias(key)), key, "left_anti")
    return out


def nominate(df: DataFrame, key: str, entity: str, differs: str) -> DataFrame:
    """Pairs of keys, smaller first, that share an entity but differ in a column (null differs from a value)."""
    a = df.select(F.col(key).alias("left_id"), F.col(entity).alias("shared"), F.col(differs).alias("left_value"))
    b = df.select(F.col(key).alias("right_id"), F.col(entity).alias("shared"), F.col(differs).alias("right_value"))
    met = a.join(b, "shared").filter((F.col("left_id") < F.col("right_id")) & ~F.col("left_value").eqNullSafe(F.col("right_value")))
    return met.select("left_id", "right_id").distinct()


def either_key(left: DataFrame, right: DataFrame, first: Column, second: Column, columns: Sequence[str]) -> DataFrame:
    """Pairs that meet on one of two conditions: a union of two equi-joins, not a join on ``or``."""
    return left.join(right, first).select(*columns).union(left.join(right, second).select(*columns)).distinct()


def inside_span(line: Column, column: Column, start: tuple[Column, Column], end: tuple[Column, Column]) -> Column:
    """Whether (line, column) lies in a two-dimensional closed span."""

    def at(a: Column, b: Column) -> Column:
        return F.struct(a.alias("l"), b.alias("c"))

    return (at(line, column) >= at(*start)) & (at(line, column) <= at(*end))


def may_alias(left: Column, right: Column, complete: Column) -> Column:
    """may, no or unknown: sets that meet may alias; disjoint ones do not only if both are complete."""
    return F.when(F.arrays_overlap(left, right), F.lit("may")).when(complete, F.lit("no")).otherwise(F.lit("unknown"))


def ordered_match(steps: Column, path: Column) -> Column:
    """Greedy match of each step to the first equal path element after the previous match: indices, -1 where none."""
    begin = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ahead = F.filter(F.transform(path, lambda p, i: F.when((p == s) & (i > acc["last"]), i)), lambda i: i.isNotNull())
        hit = F.coalesce(F.array_min(ahead), F.lit(-1))
        return F.struct(F.greatest(acc["last"], hit).alias("last"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.aggregate(steps, begin, step, lambda a: a["out"])
