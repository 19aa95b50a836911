"""Walks, paths, closure and components over edges drawn from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import graph as G
from veridact.operators import joins as J
from veridact.plans.registry import DOMINATORS_SQL, packed_sql, query, table, walk_sql

EDGES_SQL = (
    "e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
)
DAG_SQL = "e AS (SELECT p_brand AS src, p_type AS dst FROM part UNION SELECT p_type, 's' || p_size FROM part UNION SELECT 's' || p_size, p_name FROM part)"


def _edges(spark, sf):
    """Customers and suppliers to their nations, nations to their regions."""
    named = lambda t, a, b: table(spark, sf, t).select(F.concat(F.lit(a[0]), a[1]).alias("src"), F.concat(F.lit(b[0]), b[1]).alias("dst"))
    return named("customer", ("c", "c_custkey"), ("n", "c_nationkey")).union(named("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"))).union(named("nation", ("n", "n_nationkey"), ("r", "n_regionkey"))).distinct()


def _dag(spark, sf):
    """Brands to types to sizes to names of parts."""
    part, size = table(spark, sf, "part"), F.concat(F.lit("s"), "p_size")
    return part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).union(part.select("p_type", size)).union(part.select(size, "p_name")).distinct()


@query("gr01_trace", f"""
WITH RECURSIVE {EDGES_SQL}, w(node, distance) AS (SELECT 'c1', 0 UNION SELECT dst, distance + 1 FROM w JOIN e ON node = src WHERE distance < 3)
SELECT node, min(distance)::INT AS distance FROM w GROUP BY 1""")
def gr01(spark, sf):
    return G.neighbourhood(_edges(spark, sf), spark.createDataFrame([("c1",)], "node string"), 3).select("node", "distance")


@query("gr02_bidirectional", f"""
WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, distance) AS (SELECT 'n2', 0 UNION SELECT dst, distance + 1 FROM w JOIN b ON node = src WHERE distance < 2)
SELECT node, min(distance)::INT AS distance, min(distance) < 2 AS expanded FROM w GROUP BY 1""")
def gr02(spark, sf):
    return G.neighbourhood(G.both_ways(_edges(spark, sf)), spark.createDataFrame([("n2",)], "node string"), 2)


@query("gr04_limited_walk", walk_sql(EDGES_SQL, "('c1', 0), ('s3', 0)", 4, 40))
def gr04(spark, sf):
    """The first 40 nodes of a walk, level by level and by name; the bound shows in `expanded`."""
    return G.neighbourhood(G.both_ways(_edges(spark, sf)), spark.createDataFrame([("c1",), ("s3",)], "node string"), 4, limit=40)


@query("gr10_call_paths", f"""
WITH RECURSIVE {DAG_SQL}, w(path) AS (SELECT ['Brand#11', dst] FROM e WHERE src = 'Brand#11' UNION ALL SELECT list_append(path, dst) FROM w JOIN e ON path[len(path)] = src WHERE len(path) <= 5 AND NOT list_contains(path, dst))
SELECT array_to_string(path, '>') AS path FROM w""")
def gr10(spark, sf):
    found = G.paths(_dag(spark, sf), spark.createDataFrame([("Brand#11",)], "node string"), 5)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("gr13_closure", f"""
WITH RECURSIVE {DAG_SQL}, c AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c""")
def gr13(spark, sf):
    return G.closure(_dag(spark, sf))


@query("gr13b_reduction", f"""
WITH RECURSIVE {DAG_SQL}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e e2 JOIN c ON e2.dst = c.src WHERE e2.src = e.src AND c.dst = e.dst)""")
def gr13b(spark, sf):
    return G.reduction(_dag(spark, sf))


@query("gr05_dominators", f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT p_brand AS graph, 'n' || (p_partkey % 8) AS src, 'n' || ((p_partkey + p_size) % 8) AS dst, 'n0' AS entry FROM part UNION ALL SELECT p_brand, 'n0', 'n1', 'n0' FROM part)),
{DOMINATORS_SQL} SELECT r.graph, r.node, i.idom FROM r LEFT JOIN i USING (graph, node)""")
def gr05(spark, sf):
    """Immediate dominators of one small graph per part brand."""
    part = table(spark, sf, "part")
    edges = part.select(F.col("p_brand").alias("graph"), F.concat(F.lit("n"), F.col("p_partkey") % 8).alias("src"), F.concat(F.lit("n"), (F.col("p_partkey") + F.col("p_size")) % 8).alias("dst"), F.lit("n0").alias("entry"))
    rooted = edges.union(edges.select("graph", F.lit("n0"), F.lit("n1"), "entry")).distinct()
    return G.dominators(rooted, "graph", "entry")


@query("gr16_span_mapping", """
SELECT l_orderkey, l_linenumber, (l_linenumber * 10 + CASE WHEN 5 < l_linenumber * 10 THEN 3 ELSE 0 END)::INT AS start, (l_linenumber * 10 + 4 + CASE WHEN 5 < l_linenumber * 10 THEN 3 ELSE 0 END)::INT AS "end" FROM lineitem""")
def gr16(spark, sf):
    hunks = F.array(F.struct(F.lit(3).alias("old_start"), F.lit(3).alias("old_len"), F.lit(3).alias("new_start"), F.lit(6).alias("new_len")))
    span = G.mapped_span(hunks, F.col("l_linenumber") * 10, F.col("l_linenumber") * 10 + 4)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", span.alias("s")).select("l_orderkey", "l_linenumber", "s.start", "s.end")


@query("gr20_first_rule", """
SELECT p_partkey, coalesce(a.rule, b.rule) AS rule, CASE WHEN a.rule IS NOT NULL THEN 0 WHEN b.rule IS NOT NULL THEN 1 END AS tier FROM part
LEFT JOIN (VALUES ('Brand#11', 10, 'exact')) a(b, s, rule) ON p_brand = a.b AND p_size = a.s LEFT JOIN (VALUES ('Brand#11', 'brand'), ('Brand#12', 'brand12')) b(b, rule) ON p_brand = b.b""")
def gr20(spark, sf):
    exact = spark.createDataFrame([("Brand#11", 10, 0, "exact"), ("Brand#11", 10, 1, "later")], "p_brand string, p_size int, position int, rule string")
    brand = spark.createDataFrame([("Brand#11", 0, "brand"), ("Brand#12", 0, "brand12")], "p_brand string, position int, rule string")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return G.first_rule(part, ["p_partkey"], [(exact, ["p_brand", "p_size"]), (brand, ["p_brand"])]).select("p_partkey", "rule", "tier")


@query("dom47_islands", """
WITH r AS (SELECT user_id, event_id // 20 AS lo FROM events), d AS (SELECT DISTINCT user_id, lo FROM r), o AS (SELECT *, CASE WHEN lo > lag(lo) OVER (PARTITION BY user_id ORDER BY lo) + 1 THEN 1 ELSE 0 END AS opens FROM d),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY lo) AS island FROM o)
SELECT user_id, min(lo) AS low, max(lo) AS high, count(*) AS n FROM i GROUP BY user_id, island""")
def dom47(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 20).alias("lo")).distinct().withColumn("hi", F.col("lo"))
    return G.islands(rows, ["user_id"], "lo", "hi")


@query("dom25_greedy_batches", packed_sql("SELECT source, doc_id, n_chars FROM documents", "source, doc_id, n_chars", "source", "doc_id", "n_chars", 64, 100_000))
def dom25(spark, sf):
    """Documents of each source in batches of at most 64 documents and 100,000 characters."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return G.packed(docs, "source", ["doc_id"], "n_chars", 64, 100_000)
