"""Readers of coverage reports: LCOV, Cobertura, JaCoCo and LLVM JSON."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOTALS = "source_path string, lines_found long, lines_hit long, branches_found long, branches_hit long, functions_found long, functions_hit long"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files. A line's number is its place in its file; files are read whole by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line_no", "value"))


def lcov(lines: DataFrame) -> DataFrame:
    """Totals per source of LCOV lines (file, line_no, value): the most hits of a line count, records of one source merge.

    ``SF:`` is carried forward to the lines below it within a report; the rest is grouping.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("source_path", F.last(F.when(F.col("value").startswith("SF:"), F.substring("value", 4, 4096)), ignorenulls=True).over(w))
    field = F.split(F.regexp_replace("value", "^[A-Z]+:", ""), ",")
    kind = F.regexp_extract("value", "^([A-Z]+):", 1)
    rows = tagged.filter(kind.isin("DA", "BRDA", "FN", "FNDA")).select("source_path", kind.alias("kind"), field.alias("f"))
    key = F.when(F.col("kind") == "BRDA", F.concat_ws(",", F.slice("f", 1, 3))).when(F.col("kind") == "FNDA", F.element_at("f", -1)).when(F.col("kind") == "FN", F.element_at("f", -1)).otherwise(F.get("f", 0))
    hits = F.when(F.col("kind") == "DA", F.get("f", 1)).when(F.col("kind") == "BRDA", F.nullif(F.get("f", 3), F.lit("-"))).when(F.col("kind") == "FNDA", F.get("f", 0))
    group = F.when(F.col("kind").isin("FN", "FNDA"), F.lit("functions")).when(F.col("kind") == "BRDA", F.lit("branches")).otherwise(F.lit("lines"))
    most = rows.select("source_path", group.alias("kind"), key.alias("key"), F.coalesce(hits.try_cast("long"), F.lit(0)).alias("hits")).groupBy("source_path", "kind", "key").agg(F.max("hits").alias("hits"))
    counts = [c for k in ("lines", "branches", "functions") for c in (F.count_if(F.col("kind") == k).alias(f"{k}_found"), F.count_if((F.col("kind") == k) & (F.col("hits") > 0)).alias(f"{k}_hit"))]
    return most.groupBy("source_path").agg(*counts)


def cobertura(reports: DataFrame) -> DataFrame:
    """Totals per source of Cobertura XML documents (a column ``value`` with one whole document per row)."""

    def parse(text: str) -> Iterator[tuple]:
        sources: dict[str, list[int]] = {}
        for cls in ET.fromstring(text).iter("class"):
            t = sources.setdefault(cls.get("filename", ""), [0] * 6)
            for line in cls.findall("lines/line"):
                t[0] += 1
                t[1] += int(line.get("hits", 0)) > 0
                if line.get("branch") == "true" and "(" in line.get("condition-coverage", ""):
                    hit, found = line.get("condition-coverage").split("(")[1].rstrip(")").split("/")
                    t[2] += int(found)
                    t[3] += int(hit)
            for m in cls.findall("methods/method"):
                t[4] += 1
                t[5] += any(int(x.get("hits", 0)) > 0 for x in m.findall("lines/line"))
        return ((k, *v) for k, v in sources.items())

    return _documents(reports, parse)


def jacoco(reports: DataFrame) -> DataFrame:
    """Totals per source file of JaCoCo XML documents."""

    def parse(text: str) -> Iterator[tuple]:
        for package in ET.fromstring(text).iter("package"):
            for f in package.findall("sourcefile"):
                c = {x.get("type"): (int(x.get("missed")), int(x.get("covered"))) for x in f.findall("counter")}
                totals = [n for k in ("LINE", "BRANCH", "METHOD") for n in (sum(c.get(k, (0, 0))), c.get(k, (0, 0))[1])]
                yield (f"{package.get('name')}/{f.get('name')}", *totals)

    return _documents(reports, parse)


def _documents(reports: DataFrame, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TOTALS.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([row for text in pdf["value"] if text for row in parse(text)], columns=names)

    parsed = reports.select("value").mapInPandas(run, TOTALS)
    sums = [F.sum(c).alias(c) for c in parsed.columns[1:]]
    return parsed.groupBy("source_path").agg(*sums)


def llvm_json(reports: DataFrame) -> DataFrame:
    """Totals per file of LLVM coverage JSON documents."""
    part = "struct<count:long,covered:long>"
    schema = f"data array<struct<files:array<struct<filename:string,summary:struct<lines:{part},branches:{part},functions:{part}>>>>>"
    files = reports.select(F.explode(F.from_json("value", schema)["data"]).alias("d")).select(F.explode("d.files").alias("f"))
    columns = [F.sum(F.coalesce(F.col(f"f.summary.{k}.{n}"), F.lit(0))).alias(f"{k}_{m}") for k in ("lines", "branches", "functions") for n, m in (("count", "found"), ("covered", "hit"))]
    return files.groupBy(F.col("f.filename").alias("source_path")).agg(*columns)


def with_rates(totals: DataFrame) -> DataFrame:
    """Totals with rates to eight places; a rate without anything found is null."""
    rate = lambda k: F.round(F.try_divide(F.col(f"{k}_hit").cast("double"), F.col(f"{k}_found")), 8).alias(f"{k}_rate")
    return totals.select("*", *[rate(k) for k in ("lines", "branches", "functions")])
