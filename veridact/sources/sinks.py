"""Writers: content-addressed tables, SARIF, VEX, and CSV with JSON cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's schema and rows that doesn't depend on their order: two sums of row hashes, and the count."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    s = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(7), row).cast("decimal(38,0)")).alias("b")).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{df.schema.simpleString()}|{s['n']}|{s['a']}|{s['b']}").hex


def publish(df: DataFrame, root: str) -> tuple[str, bool]:
    """Write a table below ``root`` under its fingerprint unless it is there already; the path, and whether it was written."""
    path = f"{root.rstrip('/')}/fingerprint={fingerprint(df)}"
    if _complete(df.sparkSession, path):
        return path, False
    df.write.mode("overwrite").parquet(path)
    return path, True


def _complete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result per finding (rule_id, level, message, path, start_line, end_line), in order of rule, path and line."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.orderBy("rule_id", "path", "start_line").select(F.to_json(result).alias("value"))


def dangling(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Results whose rule isn't declared; an export is valid only if there are none."""
    return results.join(rules, "rule_id", "left_anti")


def vex_statements(verdicts: DataFrame) -> DataFrame:
    """One JSON statement per vulnerability and status (cve_id, product, status), with its products in order."""
    g = verdicts.groupBy("cve_id", "status").agg(F.array_sort(F.collect_set("product")).alias("products"))
    products = F.transform("products", lambda p: F.struct(p.alias("@id")))
    return g.orderBy("cve_id", "status").select(F.to_json(F.struct(F.struct(F.col("cve_id").alias("name")).alias("vulnerability"), products.alias("products"), "status")).alias("value"))


def write_json_cells(df: DataFrame, path: str) -> None:
    """CSV in which each cell is JSON, so that null, text and numbers stay apart."""
    cell = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    filled = [F.when(F.col(f"`{c}`").isNull(), F.lit("null")).otherwise(cell(c)).alias(c) for c in df.columns]
    df.select(*filled).write.option("header", True).option("escape", '"').csv(path)


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, rows) of the line files below a path, digested where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    lines = F.octet_length("content") - F.octet_length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("sha256"), lines.cast("long").alias("rows"))


def index_receipt(index: DataFrame, key: str) -> DataFrame:
    """(key, tokens, total, sha256): a receipt for each row of an inverted index (token, key, tf), which a later check takes again and compares."""
    line = F.concat_ws(":", "token", F.col("tf").cast("string"))
    g = index.groupBy(key).agg(F.count("*").alias("tokens"), F.sum("tf").alias("total"), F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select(key, "tokens", "total", F.sha2(F.array_join("lines", ","), 256).alias("sha256"))
