"""Runs, tags, coverage and reviews of the supplied tables, summed up."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import reports as R
from veridact.plans.registry import query, select

RUNS = "SELECT event_id AS sequence, CASE WHEN event_id % 23 > 0 THEN ts END AS happened, CASE WHEN user_id % 9 > 0 THEN 'j' || CAST(user_id % 9 AS VARCHAR(9)) END AS job, CASE WHEN event_id % 3 > 0 THEN 'a' || CAST(event_id % 3 AS VARCHAR(9)) END AS attempt, CASE event_id % 40 WHEN 7 THEN 'JOB_STARTED' WHEN 20 THEN 'JOB_COMPLETED' WHEN 33 THEN 'JOB_FAILED' ELSE 'PROGRESS' END AS type FROM events"


@query("agg29_job_spans", f"""
WITH e AS (SELECT * FROM ({RUNS}) WHERE happened IS NOT NULL), g AS (SELECT job, coalesce(attempt, '-') AS attempt, min(happened) AS first, min_by(happened, sequence) FILTER (type = 'JOB_STARTED') AS begun, max_by(happened, sequence) FILTER (type IN ('JOB_COMPLETED', 'JOB_FAILED')) AS ended,
  max_by(type, sequence) FILTER (type IN ('JOB_COMPLETED', 'JOB_FAILED')) AS how, count(*) AS events FROM e WHERE job IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, floor((epoch_us(coalesce(begun, first)) - (SELECT epoch_us(min(happened)) FROM e)) / 1000)::BIGINT AS s, floor((epoch_us(ended) - (SELECT epoch_us(min(happened)) FROM e)) / 1000)::BIGINT AS f FROM g)
SELECT job, attempt, CASE how WHEN 'JOB_COMPLETED' THEN 'SUCCEEDED' WHEN 'JOB_FAILED' THEN 'FAILED' ELSE 'RUNNING' END AS status, s AS start_ms, CASE WHEN f IS NOT NULL THEN greatest(s, f) END AS end_ms, events FROM m""")
def agg29(spark, sf):
    rows = select(spark, sf, RUNS).withColumnRenamed("happened", "at")
    return R.job_spans(rows, {"JOB_COMPLETED": "SUCCEEDED", "JOB_FAILED": "FAILED"})


TAGGED = "SELECT 'ns:' || CAST(l_partkey % 12 AS VARCHAR(9)) AS tag, l_orderkey AS subject, l_suppkey AS component, CASE l_returnflag WHEN 'R' THEN 'verified' WHEN 'A' THEN 'observed' ELSE 'derived' END AS basis, CASE WHEN l_linenumber % 2 = 0 THEN 'red' ELSE 'red,blue' END AS lens FROM lineitem"
ROLLUP = [(f"ns:{i}", f"n{i % 4}", f"fam{i % 2}") for i in range(9)]


@query("agg19_tag_cloud", f"""
WITH t AS (SELECT *, CASE WHEN split_part(tag, ':', 2)::INT < 9 THEN 'n' || (split_part(tag, ':', 2)::INT % 4) ELSE tag END AS node, CASE WHEN split_part(tag, ':', 2)::INT < 9 THEN 'fam' || (split_part(tag, ':', 2)::INT % 2) ELSE 'other' END AS family FROM ({TAGGED}))
SELECT node, family, count(DISTINCT subject) AS subjects, count(DISTINCT component) AS components, count(*) AS assignments, (['derived', 'observed', 'verified'])[max(list_position(['derived', 'observed', 'verified'], basis))] AS strongest, bool_and(basis = 'derived') AS derived_only,
  string_agg(DISTINCT tag, ',' ORDER BY tag) AS leaves, CASE WHEN bool_or(lens = 'red,blue') THEN 'blue,red' ELSE 'red' END AS lenses FROM t GROUP BY 1, 2""")
def agg19(spark, sf):
    records = select(spark, sf, TAGGED).withColumn("lenses", F.split("lens", ","))
    found = R.tag_cloud(records, spark.createDataFrame(ROLLUP, "tag string, node string, family string"), ["derived", "observed", "verified"])
    return found.withColumns({"leaves": F.array_join("leaves", ","), "lenses": F.array_join("lenses", ",")})


PARTS = "SELECT 's' || CAST(p_partkey AS VARCHAR(9)) AS source, p_size AS lines_total, p_size / 2 AS half, p_size % 7 AS branches_total, p_size % 3 AS branches_covered FROM part"


@query("agg23_coverage_totals", f"""
SELECT sum(lines_total)::BIGINT AS lines_total, sum(floor(half))::BIGINT AS lines_covered, sum(branches_total)::BIGINT AS branches_total, sum(branches_covered)::BIGINT AS branches_covered, 0::BIGINT AS functions_total, 0::BIGINT AS functions_covered,
  round(sum(floor(half)) / sum(lines_total), 8) AS lines_rate, round(sum(branches_covered) / sum(branches_total), 8) AS branches_rate, NULL::DOUBLE AS functions_rate FROM ({PARTS})""")
def agg23(spark, sf):
    rows = select(spark, sf, PARTS).select("source", "lines_total", F.floor("half").alias("lines_covered"), "branches_total", "branches_covered", F.lit(0).alias("functions_total"), F.lit(0).alias("functions_covered"))
    return R.coverage_totals(rows)


FACTS = """
SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 3 > 0 END AS exact, CASE user_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' END AS coverage, CASE event_id % 4 WHEN 0 THEN 'agree' WHEN 1 THEN 'not_covered' WHEN 2 THEN 'conflict' END AS cross_check,
       CASE user_id % 4 WHEN 0 THEN 'sink_site' WHEN 1 THEN 'entry_point' WHEN 2 THEN 'range_fact' ELSE 'dataflow_path' END AS family, CASE event_id % 7 WHEN 0 THEN 'memory' WHEN 1 THEN 'unclassified' END AS sink, CASE event_id % 2 WHEN 0 THEN 'remote' END AS source, event_id % 6 = 0 AS applies FROM events"""


@query("gr18_admissibility", f"""
SELECT event_id, concat_ws(',', CASE WHEN exact IS NOT TRUE THEN 'inexact_location' END, CASE WHEN coverage IS DISTINCT FROM 'complete' THEN 'incomplete_coverage' END, CASE WHEN cross_check IS NULL THEN 'cross_check_missing' WHEN cross_check = 'conflict' THEN 'cross_check_conflict' END,
  CASE WHEN family = 'sink_site' AND coalesce(sink, 'unclassified') = 'unclassified' THEN 'unclassified_sink' END, CASE WHEN family = 'entry_point' AND source IS NULL THEN 'unclassified_source' END, CASE WHEN family = 'range_fact' AND NOT applies THEN 'range_not_applicable' END,
  CASE WHEN family = 'dataflow_path' AND source IS NULL THEN 'unclassified_source' END, CASE WHEN family = 'dataflow_path' AND coalesce(sink, 'unclassified') = 'unclassified' THEN 'unclassified_sink' END) AS reasons FROM ({FACTS})""")
def gr18(spark, sf):
    why = R.ineligibility(*[F.col(c) for c in ("exact", "coverage", "cross_check", "family", "sink", "source", "applies")])
    return select(spark, sf, FACTS).select("event_id", F.array_join(why, ",").alias("reasons"))


LEADS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'semgrep:py' WHEN 1 THEN 'bandit' WHEN 2 THEN 'gosec' ELSE 'semgrep' END AS scanner, CASE user_id % 3 WHEN 0 THEN ' Style ' WHEN 1 THEN 'error' END AS native_severity, event_type || '.r' || CAST(user_id % 5 AS VARCHAR(9)) AS rule FROM events"
CLASSES = [("semgrep", ["style"], ["view.*"]), ("b*", [], ["*.r1", "click.r?"]), ("*", ["never"], ["purchase.r3"])]


@query("flt18_lead_filter", f"""
SELECT *, CASE WHEN scanner LIKE 'semgrep%' AND (lower(trim(native_severity)) = 'style' OR rule LIKE 'view.%') THEN 0 WHEN scanner LIKE 'b%' AND (rule LIKE '%.r1' OR rule LIKE 'click.r_') THEN 1 WHEN rule = 'purchase.r3' THEN 2 END AS filtered FROM ({LEADS})""")
def flt18(spark, sf):
    return R.filtered_leads(select(spark, sf, LEADS), CLASSES)


PATHS = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'vendor/x/' WHEN 1 THEN 'src/gen/' WHEN 2 THEN '' ELSE 'src/' END || 'f' || CAST(p_partkey AS VARCHAR(9)) || CASE p_partkey % 3 WHEN 0 THEN '.min.js' WHEN 1 THEN '.lock' ELSE '.c' END AS path FROM part"


@query("flt16_exclusion_category", f"SELECT path, CASE WHEN path LIKE 'vendor/%' THEN 'vendored' WHEN path LIKE '%gen/%' THEN 'generated' WHEN path LIKE '%.min.js' THEN 'generated' WHEN path LIKE '%.lock' THEN 'lock' END AS category FROM ({PATHS})")
def flt16(spark, sf):
    rules = [("vendored", ["vendor/**"]), ("generated", ["**/gen/**", "*.min.js"]), ("lock", ["*.lock"])]
    return select(spark, sf, PATHS).select("path", R.excluded(F.col("path"), rules).alias("category"))


VOLUME = "SELECT 'sc' || CAST(event_id % 4 AS VARCHAR(9)) AS scanner, CASE WHEN event_id % 6 = 0 THEN 'd' END AS duplicate_of, CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'low' WHEN 'click' THEN 'odd' END AS severity FROM events"
KLOC = "SELECT 'sc' || CAST(s_suppkey AS VARCHAR(9)) AS scanner, s_suppkey * 1000 AS lines FROM supplier WHERE s_suppkey < 6 AND s_suppkey <> 2"


@query("agg17_volume", f"""
WITH f AS (SELECT scanner, count(*) AS n, count(duplicate_of) AS d, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'low') AS l, count(*) FILTER (severity IS NULL OR severity NOT IN ('high', 'medium', 'low')) AS u FROM ({VOLUME}) GROUP BY 1)
SELECT scanner, coalesce(n, 0) AS findings, coalesce(d, 0) AS duplicates, round(d / n, 6) AS duplicate_rate, 'high=' || coalesce(h, 0) || ',medium=0,low=' || coalesce(l, 0) AS severities, coalesce(u, 0) AS unknown, round(coalesce(n, 0) * 1000 / nullif(k.lines, 0), 6) AS per_kloc FROM f FULL JOIN ({KLOC}) k USING (scanner)""")
def agg17(spark, sf):
    found = R.volume(select(spark, sf, VOLUME), "scanner", ["high", "medium", "low"], select(spark, sf, KLOC))
    return found.withColumns({c: F.round(c, 6) for c in ("duplicate_rate", "per_kloc")})


CRASHES = "SELECT l_suppkey AS bucket, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS position, l_quantity AS occurrences FROM lineitem WHERE l_partkey % 3 = 0"
FIXES = "SELECT s_suppkey AS bucket, s_suppkey % 9 + 2 AS position FROM supplier"


@query("lif06_fix_support", f"""
WITH g AS (SELECT f.bucket, coalesce(sum(occurrences) FILTER (c.position < f.position), 0) AS b, coalesce(sum(occurrences) FILTER (c.position >= f.position), 0) AS a, coalesce(sum(occurrences) FILTER (c.position IS NULL), 0) AS u FROM ({FIXES}) f LEFT JOIN ({CRASHES}) c USING (bucket) GROUP BY 1)
SELECT bucket, b AS before, a AS after, u AS undated, CASE WHEN a > 0 THEN 'contradicted' WHEN b > 0 AND u = 0 THEN 'supported' ELSE 'unknown' END AS support FROM g""")
def lif06(spark, sf):
    return R.support_for_fix(select(spark, sf, CRASHES), select(spark, sf, FIXES), "bucket")


BASE = "SELECT 'c' || CAST(o_custkey AS VARCHAR(9)) AS canary, CASE o_orderkey % 2 WHEN 0 THEN 'recall' ELSE 'cost' END AS metric, min(CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 1000 END) AS value FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1, 2"
NOW = BASE.replace("o_orderkey % 3 < 2", "o_orderkey % 3 > 0").replace("o_totalprice / 1000", "o_totalprice / 990")


@query("lif05_canary_drift", f"""
SELECT canary, metric, b.value AS before, n.value AS after, CASE WHEN n.canary IS NULL THEN 'missing' WHEN b.canary IS NULL THEN 'new' WHEN b.value IS NULL OR n.value IS NULL THEN 'unmeasured' WHEN CASE metric WHEN 'cost' THEN n.value - b.value > 0 ELSE b.value - n.value > 20 END THEN 'drifted' ELSE 'stable' END AS state
FROM ({BASE}) b FULL JOIN ({NOW}) n USING (canary, metric)""")
def lif05(spark, sf):
    return R.drift(select(spark, sf, BASE), select(spark, sf, NOW), {"recall": 20.0}, ["cost"])


PROPOSED = "SELECT 'p' || CAST(o_custkey % 3 AS VARCHAR(9)) AS predicate, CASE WHEN o_custkey % 2 = 0 THEN 'CWE-79' END AS cwe, 'e' || CAST(o_orderkey % 4 AS VARCHAR(9)) AS e1, 'e' || CAST(o_custkey % 4 AS VARCHAR(9)) AS e2, 'q' || CAST(o_orderkey % 5 AS VARCHAR(9)) AS pre FROM orders"


@query("lif13_merged_claims", f"""
WITH c AS (SELECT *, CASE WHEN e1 = e2 THEN e1 WHEN e1 < e2 THEN e1 || ',' || e2 ELSE e2 || ',' || e1 END AS entities FROM ({PROPOSED}))
SELECT sha256(predicate || chr(31) || coalesce(cwe, '') || chr(31) || replace(entities, ',', chr(30))) AS identity, predicate, cwe, entities, string_agg(DISTINCT pre, ',' ORDER BY pre) AS preconditions, count(*) AS proposals FROM c GROUP BY predicate, cwe, entities""")
def lif13(spark, sf):
    rows = select(spark, sf, PROPOSED).withColumns({"entities": F.array("e1", "e2"), "preconditions": F.array("pre")})
    return R.merged_claims(rows).withColumns({c: F.array_join(c, ",") for c in ("entities", "preconditions")})


HEADS = "SELECT 'l' || CAST(o_orderkey AS VARCHAR(9)) AS lead, CASE WHEN o_orderkey % 4 > 0 THEN 'l' || CAST(o_orderkey - o_orderkey % 4 AS VARCHAR(9)) END AS duplicate_of, CASE WHEN o_custkey % 3 > 0 THEN 'CWE-' || CAST(o_custkey % 3 AS VARCHAR(9)) END AS cwe, 'f' || CAST(o_custkey % 10 AS VARCHAR(9)) AS path FROM orders"


@query("lif16_root_causes", f"""
WITH l AS ({HEADS}) SELECT l.lead, coalesce(l.duplicate_of, l.lead) AS population, substr(sha256(coalesce(h.cwe, '') || chr(31) || h.path), 1, 16) AS root_cause FROM l LEFT JOIN l h ON h.lead = coalesce(l.duplicate_of, l.lead) AND h.duplicate_of IS NULL""")
def lif16(spark, sf):
    return R.root_causes(select(spark, sf, HEADS))


ADDRESSES = """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'https://GitHub.com/Own/Repo.git' WHEN 1 THEN 'git@github.com:own/my.repo.git' WHEN 2 THEN 'git+ssh://git@gitlab.com/a/b/' WHEN 3 THEN 'https://example.org/a/b' WHEN 4 THEN 'https://github.com/only' WHEN 5 THEN 'not a url' WHEN 6 THEN 'https://github.com:443/a/b?x=1' END AS url FROM part"""


@query("dom07_repository", f"""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'github.com/own/repo' WHEN 1 THEN 'github.com/own/my.repo' WHEN 2 THEN 'gitlab.com/a/b' WHEN 6 THEN 'github.com/a/b' END AS repository FROM ({ADDRESSES})""")
def dom07(spark, sf):
    found = R.repository(F.col("url"), ["github.com", "gitlab.com"])
    return select(spark, sf, ADDRESSES).select("p_partkey", found.alias("r")).select("p_partkey", F.when(F.col("r").isNotNull(), F.concat_ws("/", "r.host", "r.owner", "r.name")).alias("repository"))


RULED = "SELECT event_id, 'sc' || CAST(event_id % 3 AS VARCHAR(9)) AS scanner, 'r' || CAST(event_id % 5 AS VARCHAR(9)) AS rule, CASE WHEN user_id % 3 > 0 THEN 'CWE-' || CAST(user_id % 6 AS VARCHAR(9)) END AS cwe FROM events"


@query("dom14_triage", f"""
SELECT event_id, CASE WHEN scanner = 'sc1' AND rule = 'r2' THEN 'drop' WHEN scanner = 'sc2' AND rule = 'r0' THEN 'keep' WHEN cwe = 'CWE-4' THEN 'later' ELSE 'review' END AS triage, CASE WHEN (scanner = 'sc1' AND rule = 'r2') OR (scanner = 'sc2' AND rule = 'r0') THEN 'rule' WHEN cwe = 'CWE-4' THEN 'cwe' ELSE 'default' END AS basis FROM ({RULED})""")
def dom14(spark, sf):
    by_rule = spark.createDataFrame([("sc1", "r2", "drop"), ("sc2", "r0", "keep")], "scanner string, rule string, triage string")
    by_cwe = spark.createDataFrame([("CWE-4", "later")], "cwe string, triage string")
    return R.triaged(select(spark, sf, RULED), by_rule, by_cwe, "review").select("event_id", "triage", "basis")


@query("dom15_sides", "SELECT c_custkey, CASE WHEN ('0x' || substr(sha256(c_custkey::VARCHAR || '|' || c_mktsegment), 1, 8))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM customer")
def dom15(spark, sf):
    return select(spark, sf, "SELECT c_custkey, c_mktsegment FROM customer").select("c_custkey", R.side(F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("side"))


SAID = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN ' ' END AS fix, CASE WHEN c_nationkey > 9 THEN c_mktsegment END AS owner FROM customer"


@query("dom20_completeness", f"SELECT 'fix' AS field, count(*) FILTER (trim(fix) <> '') AS present, count(*) FILTER (trim(fix) = '') AS absent, count(*) FILTER (fix IS NULL) AS unknown FROM ({SAID}) UNION ALL SELECT 'owner', count(owner), 0, count(*) - count(owner) FROM ({SAID})")
def dom20(spark, sf):
    return R.completeness(select(spark, sf, SAID), "c_custkey", ["fix", "owner"])


CITED = "SELECT role, 'r' || CAST(conv_id * 3 AS VARCHAR(9)) AS reference FROM conversations"
KNOWN = "SELECT 'r' || CAST(doc_id AS VARCHAR(9)) AS reference FROM documents WHERE doc_id % 2 = 0"
REVIEWED = "SELECT 'v' || CAST(o_custkey % 5 AS VARCHAR(9)) AS reviewer, o_orderstatus AS decision, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' END AS verified FROM orders"


@query("dom21_citations", f"""
WITH c AS (SELECT c.role, k.reference IS NOT NULL AS hit FROM ({CITED}) c LEFT JOIN (SELECT DISTINCT reference FROM ({KNOWN})) k USING (reference))
SELECT 'cited' AS kind, role AS subject, count(*) AS n, count(*) FILTER (hit) AS met, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM c GROUP BY GROUPING SETS ((), (role))
UNION ALL SELECT 'overturned', reviewer, count(*), count(*) FILTER (verified <> decision), round(count(*) FILTER (verified <> decision) / count(*), 6) FROM ({REVIEWED}) WHERE verified IS NOT NULL GROUP BY 2""")
def dom21(spark, sf):
    a, b = R.citations(*[select(spark, sf, s) for s in (CITED, KNOWN, REVIEWED)])
    both = a.select(F.lit("cited").alias("kind"), F.col("role").alias("subject"), F.col("cited").alias("n"), F.col("resolved").alias("met"), "rate").union(b.select(F.lit("overturned"), "reviewer", "verified", "overturned", "rate"))
    return both.withColumn("rate", F.round("rate", 6))


OPEN = "SELECT event_id AS finding, CASE event_type WHEN 'error' THEN 'not_redetected' WHEN 'view' THEN 'fix_candidate' ELSE 'persisting' END AS state, user_id % 4 AS rank, user_id % 50 AS age FROM events"


@query("dom22_rechecks", f"""
WITH a AS (SELECT * FROM ({OPEN}) WHERE state <> 'persisting'), r AS (SELECT finding, row_number() OVER (ORDER BY rank DESC, age DESC, finding) AS place FROM a) SELECT finding, place::INT AS place, (SELECT count(*) FROM a) - 25 AS left_out FROM r WHERE place <= 25""")
def dom22(spark, sf):
    kept, left_out = R.rechecks(select(spark, sf, OPEN), ["not_redetected", "fix_candidate"], 25)
    return kept.withColumn("left_out", F.lit(left_out).cast("long"))


STATED = "SELECT event_id AS statement, CASE event_type WHEN 'error' THEN 'confirmed' ELSE 'likely' END AS state, CASE WHEN event_id % 11 > 0 THEN 'r' || CAST(event_id % 30 AS VARCHAR(9)) || ',r' || CAST(user_id % 40 AS VARCHAR(9)) ELSE '' END AS refs FROM events"
HELD = "SELECT 'r' || CAST(n_nationkey AS VARCHAR(9)) AS reference FROM nation"


@query("dom33_demoted", f"""
WITH s AS ({STATED}), u AS (SELECT statement, r FROM s, unnest(string_split(refs, ',')) t(r) WHERE refs <> ''), l AS (SELECT statement, string_agg(DISTINCT r, ',' ORDER BY r) AS lost FROM u WHERE r NOT IN (SELECT reference FROM ({HELD})) GROUP BY 1)
SELECT s.statement, CASE WHEN lost IS NOT NULL OR refs = '' THEN 'unsupported' ELSE state END AS state, coalesce(lost, '') AS unresolved FROM s LEFT JOIN l USING (statement)""")
def dom33(spark, sf):
    rows = select(spark, sf, STATED).withColumn("references", F.filter(F.split("refs", ","), lambda r: r != "")).drop("refs")
    return R.demoted(rows, select(spark, sf, HELD)).withColumn("unresolved", F.array_join("unresolved", ","))


MODULES = "SELECT 'm' || CAST(c_custkey AS VARCHAR(9)) AS module, c_custkey % 60 + 5 AS lines FROM customer"
PIECES = "SELECT 'm' || CAST(o_custkey AS VARCHAR(9)) AS module, 's' || CAST(o_orderkey AS VARCHAR(9)) AS subject, CAST(o_orderkey % 20 + 1 AS INT) AS start, CAST(o_orderkey % 20 + o_orderkey % 45 + 1 AS INT) AS stop FROM orders"
HINTS = "SELECT 'm' || CAST(l_suppkey % 150 AS VARCHAR(9)) AS module, CAST(l_partkey % 25 AS INT) AS line FROM lineitem WHERE l_partkey % 4 = 0"


@query("dom35_subjects", f"""
WITH m AS ({MODULES}), p AS ({PIECES}), h AS (SELECT DISTINCT * FROM ({HINTS})), k AS (SELECT module, '<module>' AS subject, 1 AS start, lines AS stop, NULL AS gap FROM m WHERE lines <= 30
  UNION ALL SELECT p.module, subject, start, stop, CASE WHEN stop - start + 1 > 30 THEN 'subject_too_long' END FROM p JOIN m USING (module) WHERE lines > 30)
SELECT module, subject, CASE WHEN gap IS NULL THEN start END::INT AS start, CASE WHEN gap IS NULL THEN stop END::INT AS stop, CASE WHEN gap IS NULL THEN EXISTS (SELECT 1 FROM h WHERE h.module = k.module AND line BETWEEN start AND stop) END AS hinted, gap FROM k""")
def dom35(spark, sf):
    kept, gaps = R.subjects(select(spark, sf, MODULES), select(spark, sf, PIECES).withColumnRenamed("stop", "end"), select(spark, sf, HINTS), 30)
    return kept.unionByName(gaps, allowMissingColumns=True).withColumnRenamed("end", "stop")


COMMANDS = """
SELECT c_custkey AS command, 'cc ' || CASE c_custkey % 6 WHEN 0 THEN '-L -lhidden -lz' WHEN 1 THEN '-l ssl -o -lout' WHEN 2 THEN '-l:libpq.so.5 -framework Cocoa' WHEN 3 THEN '-I -l m.c' WHEN 4 THEN '-lz -lz -l-bad' ELSE 'main.c -l' END || ' -lc' || CAST(c_nationkey % 3 AS VARCHAR(9)) AS line FROM customer"""


@query("dom06_link_candidates", f"""
WITH c AS ({COMMANDS}), f AS (SELECT command, 'c' || split_part(line, ' -lc', 2) AS name, 'link_flag' AS kind, '-lc' || split_part(line, ' -lc', 2) AS value FROM c WHERE command % 6 <> 5
  UNION ALL SELECT command, 'z', 'link_flag', '-lz' FROM c WHERE command % 6 IN (0, 4) UNION ALL SELECT command, 'ssl', 'link_flag', 'ssl' FROM c WHERE command % 6 = 1
  UNION ALL SELECT command, 'pq', 'exact_library_name', '-l:libpq.so.5' FROM c WHERE command % 6 = 2 UNION ALL SELECT command, 'Cocoa', 'framework', 'Cocoa' FROM c WHERE command % 6 = 2)
SELECT name, kind, min(value) AS value, count(DISTINCT command) AS commands, 0::BIGINT AS left_out FROM f GROUP BY 1, 2""")
def dom06(spark, sf):
    rows = select(spark, sf, COMMANDS).select("command", F.split("line", " ").alias("argv"))
    found, left_out = R.link_candidates(rows, ["-L", "-o", "-I", "-isystem"], 4096)
    return found.withColumn("left_out", F.lit(left_out).cast("long"))


PRIOR = "SELECT o_orderkey AS finding, CASE o_orderkey % 4 WHEN 0 THEN 'persisting' WHEN 1 THEN 'fixed' WHEN 2 THEN 'not_redetected' ELSE 'not_covered' END AS state, CASE o_custkey % 3 WHEN 0 THEN 'high' ELSE 'low' END AS severity, o_custkey % 5 > 0 AS change_known FROM orders"
CURRENT = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'new' ELSE 'persisting' END AS state FROM orders"
AGES = "SELECT o_orderkey AS finding, o_custkey % 9 AS age FROM orders"


@query("lif03_lifecycle_metrics", f"""
WITH p AS (SELECT * FROM ({PRIOR}) JOIN ({AGES}) USING (finding))
SELECT count(*) FILTER (state = 'persisting') AS n_persisting, count(*) FILTER (state = 'fixed') AS n_fixed, count(*) FILTER (state = 'not_redetected') AS n_not_redetected, count(*) FILTER (state = 'not_covered') AS n_not_covered, 0::BIGINT AS n_regressed,
  round(count(*) FILTER (state = 'persisting') / count(*), 6) AS persisting_rate, round(count(*) FILTER (state = 'fixed') / count(*), 6) AS fixed_rate, round(count(*) FILTER (state = 'not_redetected') / count(*), 6) AS not_redetected_rate, round(count(*) FILTER (state = 'not_covered') / count(*), 6) AS not_covered_rate, 0::DOUBLE AS regressed_rate,
  count(*) FILTER (NOT change_known) AS change_unknown, (SELECT count(*) FROM ({CURRENT}) WHERE state = 'new') AS introduced, (median(age) FILTER (state = 'persisting' AND severity = 'high'))::DOUBLE AS median_age FROM p""")
def lif03(spark, sf):
    states = ["persisting", "fixed", "not_redetected", "not_covered", "regressed"]
    found = R.lifecycle_metrics(select(spark, sf, PRIOR), select(spark, sf, CURRENT), states, select(spark, sf, AGES))
    return found.withColumns({f"{s}_rate": F.round(f"{s}_rate", 6) for s in states})


EDGES = "SELECT 'f' || CAST(l_suppkey % 40 AS VARCHAR(9)) AS caller, CASE l_linenumber % 4 WHEN 0 THEN 'agree' WHEN 1 THEN 'conflict' WHEN 2 THEN 'not_covered' ELSE 'secondary_only' END AS state FROM lineitem"
OWN = "SELECT 'f' || CAST(p_partkey AS VARCHAR(9)) AS function FROM part WHERE p_partkey BETWEEN 3 AND 60"


@query("agg36_scorecard", f"""
WITH f AS ({OWN}), c AS ({EDGES}), g AS (SELECT f.function, count(*) FILTER (state = 'agree') AS agree, count(*) FILTER (state = 'conflict') AS conflict, count(*) FILTER (state = 'not_covered') AS not_covered, count(*) FILTER (state = 'secondary_only') AS secondary_only, count(state) AS total FROM f LEFT JOIN c ON caller = f.function GROUP BY 1)
SELECT * FROM g UNION ALL SELECT NULL, count(*) FILTER (state = 'agree'), count(*) FILTER (state = 'conflict'), count(*) FILTER (state = 'not_covered'), count(*) FILTER (state = 'secondary_only'), count(*) FROM c WHERE caller NOT IN (SELECT function FROM f)""")
def agg36(spark, sf):
    states = ["agree", "conflict", "not_covered", "secondary_only"]
    own, lost = R.scorecard(select(spark, sf, OWN), select(spark, sf, EDGES), states)
    rest = lost.agg(*[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(s) for s in states], F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return own.union(rest.select(F.lit(None).cast("string"), *states, "total"))


WANTED = "SELECT p_partkey AS seed, 'src/' || CAST(p_partkey % 20 AS VARCHAR(9)) AS path, 'n' || CAST(p_size % 5 AS VARCHAR(9)) AS name FROM part"
DEFINED = "SELECT 'fn' || CAST(c_custkey AS VARCHAR(9)) AS function, 'src/' || CAST(c_custkey % 25 AS VARCHAR(9)) AS path, 'n' || CAST(c_nationkey % 7 AS VARCHAR(9)) AS name FROM customer WHERE c_custkey < 120"
COMPILED = "SELECT 'fn' || CAST(o_custkey AS VARCHAR(9)) AS function, 'u' || CAST(o_orderkey % 9 AS VARCHAR(9)) AS unit FROM orders WHERE o_custkey % 3 > 0"


@query("dom50_scope_seeds", f"""
WITH w AS ({WANTED}), d AS ({DEFINED}), m AS (SELECT seed, count(function) AS n, min(function) AS f FROM w LEFT JOIN d USING (path, name) GROUP BY 1), u AS (SELECT function, min(unit) AS unit FROM ({COMPILED}) GROUP BY 1)
SELECT seed, CASE WHEN n = 1 THEN f END AS function, CASE WHEN n = 1 THEN unit END AS unit, CASE WHEN n = 0 THEN 'function_not_found' WHEN n > 1 THEN 'function_ambiguous' WHEN unit IS NULL THEN 'unit_not_found' END AS reason FROM m LEFT JOIN u ON u.function = m.f AND n = 1""")
def dom50(spark, sf):
    return R.scope_seeds(*[select(spark, sf, s) for s in (WANTED, DEFINED, COMPILED)])
