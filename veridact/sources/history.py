"""Readers of version history: change logs, hunks and blame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numstat_log(lines: DataFrame) -> DataFrame:
    """(commit, author_time, author, position, path, added, deleted, binary) of a log with ``--numstat``.

    Lines (file, line_no, value): ``commit <hash> <epoch> <author>`` opens a change, ``added<TAB>deleted<TAB>path`` follow.
    ``-`` for counts marks a binary file, whose counts are null and not 0. A change without files stays, with a null path.
    """
    head = r"^commit ([0-9a-f]{7,64}) ([0-9]+) (.*)$"
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("value").rlike(head)
    carried = lines.withColumns({
        "head": F.last(F.when(is_head, F.col("value")), ignorenulls=True).over(w), "position": F.sum(is_head.cast("int")).over(w),
    }).filter("head IS NOT NULL")
    f = F.split("value", "\t")
    stat = F.col("value").rlike("^([0-9]+|-)\t([0-9]+|-)\t")
    base = [F.regexp_extract("head", head, 1).alias("commit"), F.regexp_extract("head", head, 2).cast("long").alias("author_time"), F.regexp_extract("head", head, 3).alias("author"), F.col("position")]
    files = carried.filter(stat).select(*base, F.get(f, 2).alias("path"), F.get(f, 0).try_cast("long").alias("added"), F.get(f, 1).try_cast("long").alias("deleted"), (F.get(f, 0) == "-").alias("binary"))
    heads = carried.filter(is_head).select(*base)
    return heads.join(files.select("position", "commit", "path", "added", "deleted", "binary"), ["commit", "position"], "left")


def renamed_paths(path):
    """Old and new path of a numstat path such as ``a/{b => c}/d`` or ``a => b``: struct<old, new>."""
    brace = r"^(.*)\{(.*) => (.*)\}(.*)$"
    plain = r"^(.*) => (.*)$"
    tidy = lambda c: F.regexp_replace(c, "//+", "/")
    old = F.when(path.rlike(brace), tidy(F.regexp_replace(path, brace, "$1$2$4"))).when(path.rlike(plain), F.regexp_replace(path, plain, "$1"))
    new = F.when(path.rlike(brace), tidy(F.regexp_replace(path, brace, "$1$3$4"))).when(path.rlike(plain), F.regexp_replace(path, plain, "$2")).otherwise(path)
    return F.struct(old.alias("old"), new.alias("new"))


def hunks(lines: DataFrame) -> DataFrame:
    """(commit, ordinal, old_start, old_len, new_start, new_len) of a log with ``-U0 -p``; an absent length is 1."""
    at = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    commit = F.regexp_extract("value", r"^commit ([0-9a-f]{7,64})", 1)
    tagged = lines.withColumn("commit", F.last(F.when(commit != "", commit), ignorenulls=True).over(w)).filter(F.col("value").rlike(at))
    part = lambda i: F.regexp_extract("value", at, i)
    rows = tagged.select("file", "line_no", "commit", *[F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(1)).alias(n) for i, n in ((1, "old_start"), (2, "old_len"), (3, "new_start"), (4, "new_len"))])
    ordinal = F.row_number().over(Window.partitionBy("file", "commit").orderBy("line_no"))
    return rows.select("commit", ordinal.alias("ordinal"), "old_start", "old_len", "new_start", "new_len")


def blame(lines: DataFrame) -> DataFrame:
    """(commit, author, line) of ``--line-porcelain`` output: surviving lines with who wrote them."""
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    tagged = lines.withColumns({
        "commit": last(F.nullif(F.regexp_extract("value", head, 1), F.lit(""))), "line": last(F.nullif(F.regexp_extract("value", head, 2), F.lit("")).cast("int")),
        "author": last(F.when(F.col("value").startswith("author "), F.substring("value", 8, 1000))),
    })
    return tagged.filter(F.col("value").startswith("\t")).select("commit", "author", "line")
