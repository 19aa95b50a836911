"""Helpers that the training-data operators share: tables, shared storage and packed shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridact.session import shared_path

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``bytes.translate`` table that lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``files``: write with so many tasks at most, where partitions are small and would make many files.
    """
    path = shared_path(df.sparkSession, tag)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's value as text, modulo ``modulus``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def blocks_for(n_bytes: int, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` hold ``n_bytes``; it grows with the input."""
    return max(1, -(-int(n_bytes) // block_bytes))


def files_for(n_bytes: int) -> int:
    """Files of some ten MB for what operators keep about ``n_bytes`` of text; it grows with the input."""
    return max(12, blocks_for(n_bytes, 64 << 20))


#: Bits of the marks that tell which rows may take part in a join. The marks are broadcast: 2 MB, whatever the input.
MARK_BITS = 1 << 24


def may_hold(df: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """``df`` with ``may_hold``: whether ``others`` may have the row's key, a long; false only if it has not.

    Keys of ``others`` set bits of a table of at most ``MARK_BITS / 64`` rows, which is broadcast, so that rows which take no
    part in a join needn't move for it. With far more keys than bits, all rows may hold and all move. A null key is never held.
    """
    bit = F.pmod(F.col(key), F.lit(MARK_BITS))
    marks = others.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("mark_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("mark_bits"))
    found = df.withColumn("mark_word", F.shiftright(bit, 6)).join(F.broadcast(marks), "mark_word", "left")
    is_set = F.expr(f"coalesce(shiftright(mark_bits, CAST(pmod(`{key}`, {MARK_BITS}) % 64 AS INT)) & 1, 0) = 1")
    return found.withColumn("may_hold", is_set).drop("mark_word", "mark_bits")
