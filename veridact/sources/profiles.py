"""Readers of profiles: folded stacks, perf script, callgrind and LLVM sample profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def folded_stacks(lines: DataFrame) -> DataFrame:
    """(symbol, self_count, total_count) of lines ``a;b;c 12``: a frame counts once per stack in the total."""
    parts = lines.select(F.regexp_extract("value", r"^(.*) ([0-9]+)\s*$", 1).alias("stack"), F.regexp_extract("value", r"^(.*) ([0-9]+)\s*$", 2).alias("n")).filter("n <> ''")
    frames = parts.select(F.split("stack", ";").alias("frames"), F.col("n").cast("long").alias("n"))
    rows = frames.select(F.explode(F.array_distinct("frames")).alias("symbol"), F.element_at("frames", -1).alias("leaf"), "n")
    return rows.groupBy("symbol").agg(F.sum(F.when(F.col("symbol") == F.col("leaf"), F.col("n")).otherwise(0)).alias("self_count"), F.sum("n").alias("total_count"))


def perf_script(lines: DataFrame) -> DataFrame:
    """(symbol, event, module, count) of ``perf script`` lines (file, line_no, value).

    A line without indentation opens a sample and names its event, indented ones are its frames; samples are told apart
    by a running count of openings.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("value").rlike(r"^\S")
    numbered = lines.withColumns({"sample": F.sum(head.cast("int")).over(w), "event": F.last(F.when(head, F.regexp_extract("value", r"\s([\w.-]+)(?::\w+)?:\s*$", 1)), ignorenulls=True).over(w)})
    frame = r"^\s+[0-9a-f]+ (.+?)(?:\+0x[0-9a-f]+)? \(([^()]*)\)\s*$"
    frames = numbered.filter(~head).select("file", "sample", "event", F.regexp_extract("value", frame, 1).alias("symbol"), F.regexp_extract("value", frame, 2).alias("module")).filter("symbol <> ''")
    return frames.distinct().groupBy("symbol", "event", "module").agg(F.count("*").alias("count"))


def callgrind(files: DataFrame) -> DataFrame:
    """(symbol, source, line, cost_kind, count) of callgrind files (a column ``value`` with a whole file per row).

    Names are compressed by a dictionary that builds up line by line, so a file is read in order by one task.
    """
    name = re.compile(r"^(fn|fl|fi|fe|ob|cfn|cfi|cfl|cob)=(?:\((\d+)\))?\s*(.*)$")

    def parse(text: str) -> Iterator[tuple]:
        known: dict[tuple[str, str], str] = {}
        fn = source = ""
        call = False
        line_no = 0
        for line in text.splitlines():
            if m := name.match(line):
                kind, number, value = m.groups()
                family = "file" if kind in ("fl", "fi", "fe", "cfi", "cfl") else "object" if kind.endswith("ob") else "function"
                if number and value:
                    known[family, number] = value
                value = value or known.get((family, number), "")
                if kind == "fn":
                    fn = value
                elif kind in ("fl", "fi", "fe"):
                    source = value
            elif line.startswith("calls="):
                call = True
            elif re.match(r"^[+\-*]?\d*\s", line) and fn:
                place, *costs = line.split()
                line_no = line_no if place == "*" else line_no + int(place) if place[0] in "+-" else int(place)
                if costs:
                    yield fn, source, line_no, "inclusive" if call else "self", int(costs[0])
                call = False

    schema = "symbol string, source string, line int, cost_kind string, count long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for text in pdf["value"] if text for r in parse(text)], columns=["symbol", "source", "line", "cost_kind", "count"])

    return files.select("value").mapInPandas(run, schema).groupBy("symbol", "source", "line", "cost_kind").agg(F.sum("count").alias("count"))


def llvm_samples(lines: DataFrame) -> DataFrame:
    """(symbol, total, head) of LLVM sample profiles: lines ``name:total:head`` without indentation."""
    p = r"^([^\s:][^:]*):(\d+):(\d+)\s*$"
    rows = lines.select(F.regexp_extract("value", p, 1).alias("symbol"), F.regexp_extract("value", p, 2).alias("total"), F.regexp_extract("value", p, 3).alias("head")).filter("symbol <> ''")
    return rows.groupBy("symbol").agg(F.sum(F.col("total").cast("long")).alias("total"), F.sum(F.col("head").cast("long")).alias("head"))
