"""Readers and writers over inputs drawn from the supplied tables: their texts are rendered in a format, then parsed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridact.plans.registry import query, table
from veridact.sources import coverage, documents, feeds, findings, history, profiles, sinks


def _lines(df, file, order, value):
    """Rendered lines as (file, line_no, value), one file for each value of a column."""
    return df.select(F.col(file).cast("string").alias("file"), F.row_number().over(Window.partitionBy(file).orderBy(*order)).alias("line_no"), value.alias("value"))


@query("src06_lcov", """
WITH l AS (SELECT p_brand, p_size, max(p_partkey % 4) AS hits FROM part GROUP BY 1, 2)
SELECT p_brand AS source_path, count(*) AS lines_found, count(*) FILTER (hits > 0) AS lines_hit, 0::BIGINT AS branches_found, 0::BIGINT AS branches_hit, 0::BIGINT AS functions_found, 0::BIGINT AS functions_hit FROM l GROUP BY 1""")
def src06(spark, sf):
    part = table(spark, sf, "part")
    head = part.select("p_brand", F.lit(-1).alias("p_partkey"), F.concat(F.lit("SF:"), "p_brand").alias("v")).distinct()
    body = part.select("p_brand", F.col("p_partkey").cast("int").alias("p_partkey"), F.concat(F.lit("DA:"), "p_size", F.lit(","), F.col("p_partkey") % 4).alias("v"))
    lines = head.union(body)
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return coverage.lcov(lines.select(F.col("p_brand").alias("file"), number.alias("line_no"), F.col("v").alias("value")))


@query("src07_cobertura", "SELECT p_brand AS source_path, count(*) AS lines_found, count(*) FILTER (p_size > 25) AS lines_hit, 0::BIGINT AS branches_found, 0::BIGINT AS branches_hit, 0::BIGINT AS functions_found, 0::BIGINT AS functions_hit FROM part GROUP BY 1")
def src07(spark, sf):
    line = F.concat(F.lit('<line number="'), "p_partkey", F.lit('" hits="'), (F.col("p_size") > 25).cast("int"), F.lit('"/>'))
    per = table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(line), "").alias("l"))
    doc = F.concat(F.lit('<coverage><class filename="'), "p_brand", F.lit('"><lines>'), "l", F.lit("</lines></class></coverage>"))
    return coverage.cobertura(per.select(doc.alias("value")))


@query("src08_jacoco", "SELECT n_name || '/A' AS source_path, (n_nationkey + 3)::BIGINT AS lines_found, 3::BIGINT AS lines_hit, 0::BIGINT AS branches_found, 0::BIGINT AS branches_hit, 0::BIGINT AS functions_found, 0::BIGINT AS functions_hit FROM nation")
def src08(spark, sf):
    doc = F.concat(F.lit('<report><package name="'), "n_name", F.lit('"><sourcefile name="A"><counter type="LINE" missed="'), "n_nationkey", F.lit('" covered="3"/></sourcefile></package></report>'))
    return coverage.jacoco(table(spark, sf, "nation").select(doc.alias("value")))


@query("src09_llvm_json", "SELECT n_name AS source_path, n_nationkey::BIGINT AS lines_found, (n_nationkey // 2)::BIGINT AS lines_hit FROM nation")
def src09(spark, sf):
    part = F.struct(F.struct(F.col("n_nationkey").alias("count"), F.floor(F.col("n_nationkey") / 2).alias("covered")).alias("lines"))
    doc = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.col("n_name").alias("filename"), part.alias("summary"))).alias("files"))).alias("data")))
    return coverage.llvm_json(table(spark, sf, "nation").select(doc.alias("value"))).select("source_path", "lines_found", "lines_hit")


@query("src10_folded_stacks", """
WITH s AS (SELECT 'u' || user_id % 7 AS a, event_type AS b, user_id AS n FROM events)
SELECT symbol, sum(self)::BIGINT AS self_count, sum(n)::BIGINT AS total_count FROM (SELECT a AS symbol, 0 AS self, n FROM s UNION ALL SELECT b, n, n FROM s) GROUP BY 1""")
def src10(spark, sf):
    stack = F.concat(F.lit("u"), F.col("user_id") % 7, F.lit(";"), "event_type", F.lit(" "), "user_id")
    return profiles.folded_stacks(table(spark, sf, "events").select(stack.alias("value")))


@query("src11_perf_script", """
SELECT 'f' || user_id % 5 AS symbol, event_type AS event, '/bin/p' AS module, count(*) AS count FROM events GROUP BY 1, 2""")
def src11(spark, sf):
    events = table(spark, sf, "events")
    head = events.select("user_id", "event_id", F.lit(0).alias("k"), F.concat(F.lit("prog 1 1.0: 1 "), "event_type", F.lit(":u:")).alias("v"))
    body = events.select("user_id", "event_id", F.lit(1), F.concat(F.lit("\tff0 f"), F.col("user_id") % 5, F.lit("+0x1 (/bin/p)")))
    lines = head.union(body)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id", "k"))
    return profiles.perf_script(lines.select(F.col("user_id").cast("string").alias("file"), number.alias("line_no"), F.col("v").alias("value")))


@query("src12_callgrind", "SELECT n_name AS symbol, 'a.c' AS source, n_regionkey::INT AS line, 'self' AS cost_kind, (n_nationkey + 1)::BIGINT AS count FROM nation")
def src12(spark, sf):
    text = F.concat(F.lit("fl=(1) a.c\nfn=(2) "), "n_name", F.lit("\n"), "n_regionkey", F.lit(" "), F.col("n_nationkey") + 1)
    return profiles.callgrind(table(spark, sf, "nation").select(text.alias("value")))


@query("src13_sample_profile", "SELECT event_type AS symbol, sum(user_id)::BIGINT AS total, count(*) AS head FROM events GROUP BY 1")
def src13(spark, sf):
    return profiles.llvm_samples(table(spark, sf, "events").select(F.concat_ws(":", "event_type", "user_id", F.lit(1)).alias("value")))


@query("src14_sarif", """
SELECT 'scan' AS tool, event_type AS rule_id, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warning' END AS level, 'u' || user_id AS path, (event_id % 100 + 1)::INT AS start_line FROM events""")
def src14(spark, sf):
    place = F.struct(F.struct(F.struct(F.concat(F.lit("u"), "user_id").alias("uri")).alias("artifactLocation"), F.struct((F.col("event_id") % 100 + 1).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("event_type").alias("ruleId"), F.when(F.col("event_id") % 2 == 0, F.lit("error")).alias("level"), F.array(place).alias("locations"))
    run = F.struct(F.struct(F.struct(F.lit("scan").alias("name")).alias("driver")).alias("tool"), F.array(result).alias("results"))
    docs = table(spark, sf, "events").select(F.to_json(F.struct(F.array(run).alias("runs"))).alias("value"))
    return findings.sarif(docs).select("tool", "rule_id", "level", "path", "start_line")


@query("src15_scanner_json", "SELECT 'grype' AS scanner, 'CVE-' || p_partkey AS rule_id, CASE WHEN p_size > 25 THEN 'high' ELSE 'unknown' END AS severity, p_name || '@' || p_size AS subject FROM part")
def src15(spark, sf):
    match = F.struct(F.struct(F.concat(F.lit("CVE-"), "p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.lit("High")).alias("severity")).alias("vulnerability"), F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version")).alias("artifact"))
    docs = table(spark, sf, "part").select(F.to_json(F.struct(F.array(match).alias("matches"))).alias("value"))
    return findings.flatten("grype", docs)


@query("src16_numstat_log", "SELECT md5(o_orderkey::VARCHAR) AS commit, 'c' || o_custkey AS author, 'p' || l_partkey AS path, l_quantity::BIGINT AS added, l_linenumber::BIGINT AS deleted FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def src16(spark, sf):
    orders = table(spark, sf, "orders")
    head = orders.select("o_orderkey", F.lit(0).alias("k"), F.lit(0).cast("long").alias("p"), F.concat(F.lit("commit "), F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit(" 100 c"), "o_custkey").alias("v"))
    line = table(spark, sf, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    body = line.select(F.col("l_orderkey"), F.col("l_linenumber"), "l_partkey", F.concat(F.col("l_quantity").cast("long"), F.lit("\t"), "l_linenumber", F.lit("\tp"), "l_partkey"))
    return history.numstat_log(_lines(head.union(body), "o_orderkey", ["o_orderkey", "k", "p"], F.col("v"))).filter("path IS NOT NULL").select("commit", "author", "path", "added", "deleted")


@query("src17_hunks", "SELECT 'abcdef' || lpad(p_partkey::VARCHAR, 6, '0') AS commit, 1::INT AS ordinal, p_size::INT AS old_start, 1::INT AS old_len, (p_size + 1)::INT AS new_start, 3::INT AS new_len FROM part")
def src17(spark, sf):
    part = table(spark, sf, "part")
    head = part.select("p_partkey", F.lit(0).alias("k"), F.concat(F.lit("commit abcdef"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("v"))
    body = part.select("p_partkey", F.lit(1), F.concat(F.lit("@@ -"), "p_size", F.lit(" +"), F.col("p_size") + 1, F.lit(",3 @@ x")))
    return history.hunks(_lines(head.union(body), "p_partkey", ["p_partkey", "k"], F.col("v")))


@query("src21_kev", "SELECT 'CVE-' || n_nationkey AS cve_id, n_name AS product, n_regionkey = 1 AS known_ransomware_use FROM nation")
def src21(spark, sf):
    entry = F.struct(F.concat(F.lit("CVE-"), "n_nationkey").alias("cveID"), F.col("n_name").alias("product"), F.when(F.col("n_regionkey") == 1, F.lit("Known")).otherwise(F.lit("Unknown")).alias("knownRansomwareCampaignUse"))
    docs = table(spark, sf, "nation").select(F.to_json(F.struct(F.lit("1").alias("catalogVersion"), F.array(entry).alias("vulnerabilities"))).alias("value"))
    return feeds.kev(docs).select("cve_id", "product", "known_ransomware_use")


@query("src22_osv_packages", "SELECT 'G-' || p_partkey AS id, p_brand AS ecosystem, p_name AS name, 'introduced:0,fixed:' || p_size AS events FROM part")
def src22(spark, sf):
    events = F.array(F.create_map(F.lit("introduced"), F.lit("0")), F.create_map(F.lit("fixed"), F.col("p_size").cast("string")))
    affected = F.array(F.struct(F.struct(F.col("p_brand").alias("ecosystem"), F.col("p_name").alias("name")).alias("package"), F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges")))
    docs = table(spark, sf, "part").select(F.concat(F.lit("G-"), "p_partkey").alias("id"), F.to_json(F.struct(affected.alias("affected"))).alias("raw_json"))
    return feeds.osv_packages(docs).select("id", "ecosystem", "name", F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["kind"], e["version"])), ",").alias("events"))


@query("src23_weakness_catalogue", "SELECT 'CWE-' || n_nationkey AS entry_id, 'cwe' AS kind, n_name AS name FROM nation")
def src23(spark, sf):
    doc = F.concat(F.lit('<Weakness_Catalog><Weakness ID="'), "n_nationkey", F.lit('" Name="'), "n_name", F.lit('"/></Weakness_Catalog>'))
    return feeds.weaknesses(table(spark, sf, "nation").select(doc.alias("value")))


@query("src24_ir_edges", "SELECT 'm' || n_nationkey AS module, 'f' || n_regionkey AS function, 'entry' AS src, b AS dst FROM nation, (VALUES ('a'), ('b')) t(b)")
def src24(spark, sf):
    text = F.concat(F.lit("define void @f"), "n_regionkey", F.lit("(i1 %c) {\nentry:\n  br i1 %c, label %a, label %b\na:\n  ret void\nb:\n  ret void\n}"))
    return documents.ir_edges(table(spark, sf, "nation").select(F.concat(F.lit("m"), "n_nationkey").alias("module"), text.alias("value")))


@query("src27_property_graph", "SELECT 'c' || c_custkey AS caller, 'c' || (c_custkey * 2) AS callee, c_custkey * 2 IN (SELECT c_custkey FROM customer) AS resolved FROM customer")
def src27(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    methods = c.select(F.concat(F.lit("m"), "k").alias("id"), F.lit("METHOD").alias("label"), F.concat(F.lit("c"), "k").alias("name"))
    calls = c.select(F.concat(F.lit("x"), "k").alias("id"), F.lit("CALL").alias("label"), F.concat(F.lit("c"), F.col("k") * 2).alias("name"))
    edges = c.select(F.concat(F.lit("m"), "k").alias("src"), F.concat(F.lit("x"), "k").alias("dst"), F.lit("CONTAINS").alias("label"))
    return documents.graph_csv(methods.union(calls), edges)


@query("src29_interfaces", "SELECT '/' || n_name AS path, m AS method, m || n_nationkey AS operation_id FROM nation, (VALUES ('get'), ('post')) t(m)")
def src29(spark, sf):
    ops = F.create_map(*[x for m in ("get", "post", "parameters") for x in (F.lit(m), F.struct(F.concat(F.lit(m), "n_nationkey").alias("operationId")))])
    doc = F.to_json(F.struct(F.create_map(F.concat(F.lit("/"), "n_name"), ops).alias("paths")))
    return documents.openapi_operations(table(spark, sf, "nation").select(doc.alias("value")))


@query("src30_chunks", "SELECT item_id, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, chr(10))) FROM benchmark) GROUP BY 1")
def src30(spark, sf):
    parts = documents.chunks(table(spark, sf, "benchmark"), "item_id", "text", max_lines=1, max_bytes=1 << 20)
    return parts.groupBy("item_id").agg(F.count("*").alias("n"))


@query("src31_crash_logs", "SELECT 'sanitizer' AS scanner, event_type AS rule_id, 'high' AS severity, 'f' || user_id AS subject FROM events")
def src31(spark, sf):
    log = F.concat(F.lit("==1==ERROR: AddressSanitizer: "), "event_type", F.lit(" on x\n    #0 0xab in f"), "user_id", F.lit(" a.c:3"))
    return findings.flatten("sanitizer", table(spark, sf, "events").select(log.alias("value")))
