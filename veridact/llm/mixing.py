"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridact.llm.common import WORD, materialize

WEIGHT_CYCLE = 3
MAX_RATE = 3
#: Sources whose targets are broadcast, at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: size in words, weight, and the words that the mix is to take.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...; the targets share the size of all sources, and none
    exceeds ``MAX_RATE`` times its source's. Water filling in closed form: in ascending order of limit over weight, the
    level if all sources before were at their limits is greatest at the first source that is not, and that greatest
    level is the final one. The two ordered windows run over one narrow row per source, not over documents.
    """
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(words(text_col)).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    ranked = sizes.withColumn("mix_weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(WEIGHT_CYCLE)) + 1)
    limit = F.col("source_size") * MAX_RATE
    by_limit = Window.orderBy((limit / F.col("mix_weight")).asc(), F.col("mix_source").asc_nulls_last())
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("mix_weight").over(onward)
    return (
        ranked.withColumn("mix_level", level)
        .withColumn("mix_level", F.max("mix_level").over(everything))
        .select("mix_source", "source_size", F.least(limit.cast("double"), F.col("mix_weight") * F.col("mix_level")).alias("target"))
    )


def words(text_col: str):
    """Words of a text: maximal stretches without white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """``docs`` with size, source_size, target and copies: floor(rate) plus one drawn copy.

    The rate is the target over the source's size; the draw compares the first 32 bits of md5(seed:id) with the rate's
    fraction, so reruns and retried tasks agree. Sizes are summed per partition before the shuffle; the targets, one row
    per source, are written once and broadcast up to ``BROADCAST_SOURCES``, so that documents stay where they are.
    Null texts have size 0; a null source is a source of its own; a null id draws as the text ``null``; repeated rows
    each count and draw alike. Columns of ``docs`` named like an added column are replaced.
    """
    added = ["size", "source_size", "target", "copies"]
    left = docs.drop(*added).withColumn("size", words(text_col))
    right = materialize(source_targets(docs, text_col, source_col), "targets")
    if right.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    joined = left.join(right, left[source_col].eqNullSafe(right["mix_source"]), "left").drop("mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return joined.withColumn("copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: each row as often as :func:`with_copies` says."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), *[F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, source_col))])
    copies = with_copies(whole, id_col, text_col, source_col, seed)
    return copies.select("mix_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("mix_row.*")
