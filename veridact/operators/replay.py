"""Operators whose result depends on the order of rows, run per group in that order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_paths(changes: DataFrame, repository: str, position: str, path: str, renamed_from: str) -> DataFrame:
    """``changes`` with ``current_path``: where a file is now, given changes newest first with the names they renamed.

    Walking back in time, a rename makes the older name stand for the newer one's present path. A repository streams
    through one task in order; its state is one alias per renamed file.
    """
    schema = changes.withColumn("current_path", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, alias, pending, at = None, {}, {}, None
        for pdf in batches:
            out = []
            for r, p, name, old in zip(pdf[repository], pdf[position], pdf[path], pdf[renamed_from]):
                if r != now:
                    now, alias, pending, at = r, {}, {}, None
                if p != at:  # renames of a change hold for the older ones only
                    for k, v in pending.items():
                        alias[k] = v
                    pending, at = {}, p
                present = alias.get(name, name)
                if old is not None and old == old:
                    pending[old] = present
                out.append(present)
            yield pdf.assign(current_path=out)

    return changes.repartition(repository).sortWithinPartitions(repository, position, path).mapInPandas(run, schema)


def trimmed(lines: DataFrame, group: Sequence[str], drop_last: Sequence, per_group: int, total: int) -> DataFrame:
    """Lines that fit both budgets, in order of what is dropped last: first per group, then over all."""
    w = Window.partitionBy(*group).orderBy(*drop_last)
    kept = lines.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_group).drop("place")
    return kept.orderBy(*drop_last).limit(total)


def chains(steps: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(chain, score): paths of 2 to ``most`` steps along links that repeat no step, scored by their steps' severities.

    ``steps`` has (step, severity), ``links`` (src, dst). A chain scores its worst step plus a tenth for each other step.
    """
    edges = links.select("src", "dst").distinct()
    now = steps.select(F.array("step").alias("chain"), F.col("severity").alias("worst"))
    sev = steps.select(F.col("step").alias("dst"), "severity")
    out = None
    for _ in range(most - 1):
        ahead = now.join(edges, F.element_at("chain", -1) == edges["src"]).filter(~F.array_contains("chain", F.col("dst"))).join(sev, "dst")
        now = ahead.select(F.concat("chain", F.array("dst")).alias("chain"), F.greatest("worst", "severity").alias("worst"))
        out = now if out is None else out.union(now)
    return out.select("chain", (F.col("worst") + (F.size("chain") - 1) * 0.1).alias("score"))
