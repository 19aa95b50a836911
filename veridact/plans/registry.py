"""Named queries and, where SQL can say the same, their SQL for an independent engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL if it has one."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of the supplied tables.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of a SELECT over the supplied tables, which both engines read alike: what an operator is given."""
    names = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", plain), **{t: table(spark, sf_dir, t) for t in names})


def packed_sql(source: str, columns: str, group: str, order: str, size: str, most_rows: int, most_size: int) -> str:
    """SQL for greedy batches: a recursion along each group's order, which carries the open batch's rows and size."""
    return f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM ({source})),
w AS (SELECT s.*, 1 AS n, {size} AS total, 0 AS batch FROM s WHERE k = 1
  UNION ALL SELECT s.*, CASE WHEN w.n >= {most_rows} OR w.total + s.{size} > {most_size} THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= {most_rows} OR w.total + s.{size} > {most_size} THEN s.{size} ELSE w.total + s.{size} END,
    w.batch + (w.n >= {most_rows} OR w.total + s.{size} > {most_size})::INT FROM w JOIN s ON s.{group} IS NOT DISTINCT FROM w.{group} AND s.k = w.k + 1)
SELECT {columns}, batch FROM w"""


#: SQL of immediate dominators over e(graph, src, dst, entry): what a node can't be reached without, nearest first.
DOMINATORS_SQL = """
n AS (SELECT graph, entry, src AS node FROM e UNION SELECT graph, entry, dst FROM e), x AS (SELECT graph, node AS gone FROM n UNION ALL SELECT DISTINCT graph, '' FROM n),
w(graph, gone, node) AS (SELECT x.graph, x.gone, n.entry FROM x JOIN (SELECT DISTINCT graph, entry FROM n) n USING (graph) WHERE x.gone <> n.entry UNION SELECT w.graph, w.gone, e.dst FROM w JOIN e ON e.graph = w.graph AND e.src = w.node AND e.dst <> w.gone),
r AS (SELECT graph, node FROM w WHERE gone = ''), d AS (SELECT a.graph, a.node, b.node AS dom FROM r a JOIN r b USING (graph) WHERE a.node <> b.node AND NOT EXISTS (SELECT 1 FROM w WHERE w.graph = a.graph AND w.gone = b.node AND w.node = a.node)),
c AS (SELECT graph, node, count(*) AS depth FROM d GROUP BY 1, 2), i AS (SELECT d.graph, d.node, max_by(d.dom, coalesce(c.depth, 0)) AS idom FROM d LEFT JOIN c ON c.graph = d.graph AND c.node = d.dom GROUP BY 1, 2)"""


def walk_sql(edges: str, seeds: str, depth: int, limit: int) -> str:
    """SQL of a walk both ways that admits so many nodes, by level and then by name."""
    return f"""
WITH RECURSIVE {edges}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, distance) AS (SELECT * FROM (VALUES {seeds}) UNION SELECT dst, distance + 1 FROM w JOIN b ON node = src WHERE distance < {depth}),
m AS (SELECT node, min(distance)::INT AS distance FROM w GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY distance, node) AS place FROM m)
SELECT node, distance, distance < {depth} AS expanded FROM k WHERE place <= {limit}"""
