"""Feeds and exports written from the supplied tables and read again, and events paired."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators.search import inverted_index
from veridact.plans.registry import query, select, table
from veridact.session import shared_path
from veridact.sources import feeds, sinks
from veridact.streaming import events as E

LAYERS = "SELECT c_custkey, 'CVE-2024-' || CAST(10000 + c_custkey AS VARCHAR(9)) AS cve_id, 'd' || CAST(c_custkey % 4 AS VARCHAR(9)) AS modified, CASE WHEN c_custkey % 7 > 0 THEN 'd' || CAST(c_custkey % 3 AS VARCHAR(9)) END AS later, 'CWE-' || CAST(c_nationkey AS VARCHAR(9)) AS cwe FROM customer"


@query("src19_layered_feed", f"""
WITH l AS (SELECT *, c_custkey % 2 = 0 AND (later IS NULL OR later >= modified) AS wins FROM ({LAYERS}))
SELECT cve_id, CASE WHEN wins THEN 'new' ELSE 'old' END AS status, CASE WHEN wins THEN later ELSE modified END AS last_modified, CASE WHEN wins THEN 'CWE-0' ELSE cwe END AS cwe FROM l""")
def src19(spark, sf):
    """Two gzipped layers of a vulnerability feed, of which the second has half the entries, some older than the first's."""
    rows, paths = select(spark, sf, LAYERS), [shared_path(spark, f"layer{i}") for i in range(2)]
    layer = lambda status, at, cwe: (F.col("cve_id"), F.lit(status).alias("status"), F.col(at).alias("last_modified"), F.array(cwe).alias("weaknesses"))
    rows.select(*layer("old", "modified", F.col("cwe"))).write.option("compression", "gzip").json(paths[0])
    rows.filter("c_custkey % 2 = 0").select(*layer("new", "later", F.lit("CWE-0"))).write.option("compression", "gzip").json(paths[1])
    current = feeds.nvd(spark, paths)
    return current.select("cve_id", "status", "last_modified").join(feeds.nvd_weaknesses(current), "cve_id")


SCORED = "SELECT 'CVE-2023-' || CAST(10000 + p_partkey AS VARCHAR(9)) AS cve_id, p_size / 100.0 AS epss, p_size / 50.0 AS percentile FROM part"


@query("src20_score_feed", f"SELECT cve_id, epss::DOUBLE AS epss, percentile::DOUBLE AS percentile FROM ({SCORED})")
def src20(spark, sf):
    """Score files as they are published: a comment on top, a header, gzipped."""
    path = shared_path(spark, "scores")
    rows = select(spark, sf, SCORED).select(F.concat_ws(",", "cve_id", F.col("epss").cast("string"), F.col("percentile").cast("string")).alias("value"))
    head = spark.createDataFrame([(0, "#model_version:v1,score_date:2024-01-01"), (1, "cve,epss,percentile")], "k int, value string")
    head.union(rows.select(F.lit(2), "value")).coalesce(1).sortWithinPartitions("k").select("value").write.option("compression", "gzip").text(path)
    return feeds.epss(spark, path)


@query("snk03_index_receipts", r"""
WITH t AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM benchmark), i AS (SELECT item_id, token, count(*) AS tf FROM t WHERE token <> '' GROUP BY 1, 2)
SELECT item_id, count(*) AS tokens, sum(tf)::BIGINT AS total, sha256(string_agg(token || ':' || tf, ',' ORDER BY token || ':' || tf)) AS sha256 FROM i GROUP BY 1""")
def snk03(spark, sf):
    return sinks.index_receipt(inverted_index(table(spark, sf, "benchmark"), "item_id", F.col("text")), "item_id")


REPORTED = "SELECT 'r' || CAST(p_size % 4 AS VARCHAR(9)) AS rule_id, CASE p_size % 2 WHEN 0 THEN 'error' ELSE 'note' END AS level, p_name AS message, 'f' || CAST(p_partkey AS VARCHAR(9)) AS path, p_size AS start_line, p_size + 2 AS end_line FROM part"


@query("snk06_sarif_results", f"""
SELECT '{{"ruleId":"' || rule_id || '","level":"' || level || '","message":{{"text":"' || message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || start_line || ',"endLine":' || end_line || '}}}}}}]}}' AS value, 1::BIGINT AS dangling FROM ({REPORTED})""")
def snk06(spark, sf):
    """SARIF results, and how many rules they name that no declared rule has."""
    findings = select(spark, sf, REPORTED)
    rules = spark.createDataFrame([("r0",), ("r1",), ("r2",)], "rule_id string")
    return sinks.sarif_results(findings).withColumn("dangling", F.lit(sinks.dangling(findings, rules).select("rule_id").distinct().count()).cast("long"))


JUDGED = "SELECT 'CVE-' || CAST(p_size AS VARCHAR(9)) AS cve_id, CASE p_partkey % 3 WHEN 0 THEN 'affected' WHEN 1 THEN 'not_affected' ELSE 'under_investigation' END AS status, 'pkg:x/' || CAST(p_partkey AS VARCHAR(9)) AS product FROM part"


@query("snk07_vex_statements", f"""
SELECT '{{"vulnerability":{{"name":"' || cve_id || '"}},"products":[' || string_agg(DISTINCT '{{"@id":"' || product || '"}}', ',' ORDER BY '{{"@id":"' || product || '"}}') || '],"status":"' || status || '"}}' AS value FROM ({JUDGED}) GROUP BY cve_id, status""")
def snk07(spark, sf):
    return sinks.vex_statements(select(spark, sf, JUDGED))


CALLS = "SELECT user_id, event_id % 60 AS call, event_id AS sequence, ts AS happened, CASE event_type WHEN 'view' THEN 'START' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PROGRESS' END AS type FROM events"


@query("str06_pairings", f"""
WITH g AS (SELECT user_id, call, count(*) FILTER (type = 'START') AS s, count(DISTINCT type) FILTER (type <> 'START') AS k, min(happened) FILTER (type = 'START') AS b, max(happened) FILTER (type <> 'START') AS e FROM ({CALLS}) WHERE type <> 'PROGRESS' GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN s > 1 OR k > 1 THEN 'conflict' WHEN s = 0 THEN 'unstarted' WHEN k = 0 THEN 'running' WHEN e < b THEN 'inconsistent' ELSE 'complete' END AS state FROM g)
SELECT user_id, call, state, CASE WHEN state = 'complete' THEN floor(epoch(e))::BIGINT - floor(epoch(b))::BIGINT END AS seconds, CASE state WHEN 'unstarted' THEN 'start' WHEN 'running' THEN 'terminal' END AS missing FROM t""")
def str06(spark, sf):
    return E.pairings(select(spark, sf, CALLS).withColumnRenamed("happened", "at"), ["user_id", "call"], ["START"], ["COMPLETED", "FAILED"])


@query("str04_silent", f"""
WITH g AS (SELECT user_id, max(happened) FILTER (type IN ('PROGRESS', 'COMPLETED')) AS last FROM ({CALLS}) GROUP BY 1)
SELECT user_id, last, epoch(TIMESTAMP '2024-01-20')::BIGINT - floor(epoch(last))::BIGINT AS silent_seconds, coalesce(epoch(TIMESTAMP '2024-01-20')::BIGINT - floor(epoch(last))::BIGINT > 86400 * 12, true) AS alert FROM g""")
def str04(spark, sf):
    return E.silent(select(spark, sf, CALLS).withColumnRenamed("happened", "at"), ["user_id"], ["PROGRESS", "COMPLETED"], "2024-01-20", 86400 * 12)
