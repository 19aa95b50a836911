"""Findings of the supplied tables: joined, scored, deduplicated, ranked and shared out."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import findings as O
from veridact.plans.registry import query, select

ITEMS = "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 3 > 0 THEN 'function' ELSE 'file' END AS scope, 'f' || CAST(l_partkey % 30 AS VARCHAR(9)) AS path, l_partkey % 5 AS start, l_partkey % 5 + l_suppkey % 3 AS \"end\" FROM lineitem"
HISTORY = "SELECT 'file' AS kind, 'f' || CAST(p_partkey AS VARCHAR(9)) AS path, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS \"end\", p_size AS churn FROM part WHERE p_partkey < 20 UNION ALL SELECT 'symbol', 'f' || CAST(p_partkey % 30 AS VARCHAR(9)), p_partkey % 5, p_partkey % 5 + 1, min(p_size) FROM part WHERE p_partkey % 2 = 0 GROUP BY 2, 3, 4"


def _quoted(sql: str) -> str:
    return sql.replace('"', "`")


@query("jn02_scoped_history", f"""
WITH i AS ({ITEMS}), h AS ({HISTORY}) SELECT l_orderkey, l_linenumber, l_suppkey, scope, i.path, i.start, i."end", coalesce(s.churn, f.churn) AS churn, CASE WHEN s.kind IS NULL AND f.kind IS NULL THEN 'history_scope_unmatched' END AS gap FROM i
LEFT JOIN h s ON scope = 'function' AND s.kind = 'symbol' AND s.path = i.path AND s.start = i.start AND s."end" = i."end" LEFT JOIN h f ON scope = 'file' AND f.kind = 'file' AND f.path = i.path""")
def jn02(spark, sf):
    return O.joined_by_scope(select(spark, sf, _quoted(ITEMS)), select(spark, sf, _quoted(HISTORY)), ["churn"])


DIAGNOSTICS = """
SELECT 'd' || CAST(event_id AS VARCHAR(9)) AS diagnostic, CASE user_id % 4 WHEN 0 THEN 'core.memory' WHEN 1 THEN 'alpha.command' WHEN 2 THEN 'style' ELSE '' END AS name, 'f' || CAST(event_id % 12 AS VARCHAR(9)) AS path, CASE WHEN event_id % 11 > 0 THEN event_id % 40 END AS line, event_id % 90 AS offs FROM events"""
SINKS = "SELECT 's' || CAST(p_partkey AS VARCHAR(9)) AS sink, CASE p_size % 2 WHEN 0 THEN 'memory' ELSE 'command' END AS class, 'f' || CAST(p_partkey % 12 AS VARCHAR(9)) AS path, p_partkey % 40 AS start_line, p_partkey % 40 + p_size % 3 AS end_line FROM part WHERE p_partkey < 60"
KLASS = "CASE name WHEN 'core.memory' THEN 'memory' WHEN 'alpha.command' THEN 'command' END"


def _diagnostics(spark, sf):
    rows = select(spark, sf, DIAGNOSTICS)
    return rows.select("diagnostic", F.col("name").alias("check"), O.sink_class(F.col("name"), ["core.", "alpha."], {"memory": "memory", "command": "command"}).alias("class"), "path", "line", F.col("offs").alias("offset"))


@query("jn28_corroborated", f"""
WITH d AS (SELECT *, {KLASS} AS class FROM ({DIAGNOSTICS})), s AS ({SINKS}), m AS (SELECT sink, diagnostic FROM d JOIN s USING (class, path) WHERE line BETWEEN start_line AND end_line),
a AS (SELECT 'sink' AS kind, sink AS subject, string_agg(DISTINCT diagnostic, ',' ORDER BY diagnostic) AS diagnostics FROM m GROUP BY 2)
SELECT * FROM a UNION ALL SELECT 'suggested', path || ':' || offs || ':' || class, string_agg(DISTINCT diagnostic, ',' ORDER BY diagnostic) FROM d WHERE class IS NOT NULL AND line IS NOT NULL AND diagnostic NOT IN (SELECT diagnostic FROM m) GROUP BY 2
UNION ALL SELECT 'unmapped', coalesce(nullif(name, ''), '(unnamed)'), count(*)::VARCHAR FROM d WHERE class IS NULL GROUP BY 2""")
def jn28(spark, sf):
    met, rest, unmapped = O.corroborated(_diagnostics(spark, sf), select(spark, sf, SINKS))
    a = met.select(F.lit("sink").alias("kind"), F.col("sink").alias("subject"), F.array_join("diagnostics", ",").alias("diagnostics"))
    b = rest.select(F.lit("suggested"), F.concat_ws(":", "path", F.col("offset").cast("string"), "class"), F.array_join("diagnostics", ","))
    return a.union(b).union(unmapped.select(F.lit("unmapped"), "check", F.col("n").cast("string")))


@query("dom02_sink_class", f"SELECT diagnostic, {KLASS} AS class FROM ({DIAGNOSTICS})")
def dom02(spark, sf):
    return _diagnostics(spark, sf).select("diagnostic", "class")


TRIAGE = "SELECT 'l' || CAST(o_orderkey AS VARCHAR(9)) AS lead, CASE o_orderkey % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'unresolved' ELSE 'survived' END AS status, o_orderkey % 9 > 0 AS admitted, CASE WHEN o_custkey % 7 > 0 THEN 'fam' || CAST(o_custkey % 3 AS VARCHAR(9)) END AS family, o_orderstatus AS scanner FROM orders"
OUTCOMES = "SELECT 'l' || CAST(o_orderkey AS VARCHAR(9)) AS lead, CASE o_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'open' END AS outcome FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 5 = 0"


@query("agg14_effectiveness", f"""
WITH r AS (SELECT t.*, o.outcome FROM ({TRIAGE}) t LEFT JOIN ({OUTCOMES}) o USING (lead) WHERE admitted), g AS (
SELECT family, scanner, CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(scanner) = 0 THEN 'scanner' END AS level, count(*) FILTER (outcome = 'true') AS true_leads, count(*) FILTER (outcome = 'false') AS false_leads, count(*) FILTER (outcome = 'true' AND status = 'survived') AS true_kept,
  count(*) FILTER (outcome = 'true' AND status = 'removed') AS true_gone, count(*) FILTER (outcome = 'false' AND status = 'survived') AS false_kept, count(*) FILTER (outcome = 'false' AND status = 'removed') AS false_gone FROM r GROUP BY GROUPING SETS ((), (family), (scanner)))
SELECT *, round(true_kept / nullif(true_kept + true_gone, 0), 6) AS retention, round(false_gone / nullif(false_kept + false_gone, 0), 6) AS removal FROM g""")
def agg14(spark, sf):
    found = O.effectiveness(select(spark, sf, TRIAGE), select(spark, sf, OUTCOMES), ["family", "scanner"])
    return found.withColumns({c: F.round(c, 6) for c in ("retention", "removal")})


ALIKE = "SELECT 'o' || CAST(event_id AS VARCHAR(9)) AS lead, CASE WHEN event_id % 13 > 0 THEN 'f' || CAST(event_id % 6 AS VARCHAR(9)) END AS path, event_id % 4 AS line, CASE user_id % 3 WHEN 0 THEN 'CWE-79,CWE-89' ELSE '' END AS cwes, CASE event_id % 5 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'opengrep' WHEN 2 THEN 'bandit' ELSE 'gosec' END AS scanner, 'r' || CAST(user_id % 4 AS VARCHAR(9)) AS rule, CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'low' ELSE 'medium' END AS severity FROM events"


@query("agg25_duplicates", f"""
WITH l AS (SELECT *, CASE WHEN path IS NULL THEN lead WHEN cwes <> '' THEN 'cwe' || cwes ELSE CASE WHEN scanner IN ('semgrep', 'opengrep') THEN 'pack' ELSE scanner END || rule END AS k, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM ({ALIKE})),
w AS (SELECT *, first_value(lead) OVER (PARTITION BY path, line, k ORDER BY r, lead) AS canon, min(scanner) OVER (PARTITION BY path, line, k) <> max(scanner) OVER (PARTITION BY path, line, k) AS several FROM l)
SELECT lead, CASE WHEN canon <> lead THEN canon END AS duplicate_of, CASE WHEN canon <> lead THEN CASE WHEN cwes <> '' THEN 'same_cwe' WHEN several THEN 'shared_rule_pack' ELSE 'same_rule' END END AS method FROM w""")
def agg25(spark, sf):
    leads = select(spark, sf, ALIKE).withColumn("cwes", F.filter(F.split("cwes", ","), lambda c: c != ""))
    return O.duplicates(leads, {"semgrep": "pack", "opengrep": "pack"}, ["high", "medium", "low"]).select("lead", "duplicate_of", "method")


EXPECTED = "SELECT DISTINCT 'r' || CAST(p_size % 6 AS VARCHAR(9)) AS rule, 'f' || CAST(p_partkey AS VARCHAR(9)) AS path, p_partkey % 9 AS line, p_partkey % 3 = 0 AS positive, CASE WHEN p_partkey % 3 = 1 THEN 'known-false-negative' ELSE 'exclusion' END AS kind, CASE WHEN p_partkey % 6 = 0 THEN 'e1' END AS exception FROM part"
FOUND = "SELECT 'r' || CAST((p_size + p_partkey % 2 * (p_partkey % 5)) % 7 AS VARCHAR(9)) AS rule, 'f' || CAST(p_partkey AS VARCHAR(9)) AS path, p_partkey % 9 AS line FROM part WHERE p_partkey % 4 > 0"


@query("agg40_rule_scores", f"""
WITH e AS ({EXPECTED}), f AS (SELECT DISTINCT * FROM ({FOUND})), m AS (SELECT e.*, f.rule IS NOT NULL AS hit FROM e LEFT JOIN f USING (rule, path, line)),
t AS (SELECT rule, count(*) FILTER (positive AND hit AND exception IS NULL) AS tp, count(*) FILTER (positive AND NOT hit) AS fn, count(*) FILTER (NOT positive AND kind = 'known-false-negative' AND NOT hit) AS kfn, count(*) FILTER (positive AND hit AND exception IS NOT NULL) AS kfp,
  count(*) FILTER (NOT positive AND kind = 'exclusion' AND NOT hit) AS ee, count(*) FILTER (NOT positive AND kind = 'exclusion' AND hit) AS ve FROM m GROUP BY 1), s AS (SELECT rule, count(*) AS fp FROM f WHERE (rule, path, line) NOT IN (SELECT (rule, path, line) FROM e) GROUP BY 1)
SELECT rule, coalesce(tp, 0) AS true_positives, coalesce(fn, 0) AS false_negatives, coalesce(kfn, 0) AS known_false_negatives, coalesce(fp, 0) AS false_positives, coalesce(kfp, 0) AS known_false_positives, coalesce(ee, 0) AS expected_exclusions, coalesce(ve, 0) AS violated_exclusions FROM t FULL JOIN s USING (rule)""")
def agg40(spark, sf):
    return O.rule_scores(select(spark, sf, EXPECTED), select(spark, sf, FOUND))


SEEN = """
SELECT CASE o_orderstatus WHEN 'F' THEN 'declared' WHEN 'O' THEN 'package' ELSE 'native' END AS source, CASE WHEN o_orderkey % 17 > 0 THEN 'lib' || CAST(o_custkey % 20 AS VARCHAR(9)) ELSE ' ' END AS name, CASE WHEN o_custkey % 20 < 5 THEN 'pkg:x/' || CAST(o_custkey % 5 AS VARCHAR(9)) END AS purl,
       CASE WHEN o_orderkey % 3 > 0 THEN '1.' || CAST(o_orderkey % 3 AS VARCHAR(9)) END AS version, CASE WHEN o_custkey % 2 = 0 THEN 'npm' END AS ecosystem, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS direct,
       CASE WHEN o_orderkey % 5 = 0 THEN 'git/' || CAST(o_orderkey % 7 AS VARCHAR(9)) END AS repository, CASE o_orderkey % 31 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' WHEN 2 THEN 'test' END AS exposure FROM orders"""


@query("agg21_dependencies", f"""
WITH s AS (SELECT *, CASE exposure WHEN 'test' THEN 1 WHEN 'dev' THEN 2 WHEN 'prod' THEN 3 END AS r FROM ({SEEN}) WHERE trim(name) <> ''), g AS (SELECT CASE WHEN purl IS NULL THEN name END AS own, purl, version, ecosystem, min_by(name, row(source, name)) AS name, string_agg(DISTINCT name, ',' ORDER BY name) AS aliases, bool_or(direct) AS direct,
  min_by(repository, row(source, repository)) FILTER (repository IS NOT NULL) AS repository, max(r) AS r, count(*) AS observations FROM s GROUP BY 1, 2, 3, 4)
SELECT name, purl, version, ecosystem, aliases, direct, repository, coalesce((['test', 'dev', 'prod'])[r], 'prod') AS exposure, CASE WHEN r IS NULL THEN 'conservative-default' ELSE 'maximum-observed-evidence' END AS exposure_basis, observations FROM g""")
def agg21(spark, sf):
    return O.merged_dependencies(select(spark, sf, SEEN), ["test", "dev", "prod"]).withColumn("aliases", F.array_join("aliases", ","))


RISKS = """
SELECT CASE WHEN o_orderkey % 19 > 0 THEN 'p' || CAST(o_orderkey AS VARCHAR(9)) END AS finding, CAST(o_orderkey AS VARCHAR(9)) AS claim, CASE o_custkey % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'informational' WHEN 5 THEN 'medium' END AS severity,
       CASE o_orderkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' END AS composed, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reachable, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS score FROM orders"""


@query("win16_risk_first", f"""
WITH r AS (SELECT *, coalesce(list_position(['unknown', 'informational', 'low', 'medium', 'high', 'critical'], severity), 1) AS s, coalesce(list_position(['unknown', 'informational', 'low', 'medium', 'high', 'critical'], composed), 1) AS c FROM ({RISKS})),
t AS (SELECT *, CASE WHEN s = 6 THEN 0 WHEN s = 5 THEN 1 WHEN c > s AND c > 3 THEN 2 WHEN s = 4 AND coalesce(reachable, false) THEN 3 WHEN s = 4 THEN 4 WHEN s = 3 THEN 5 WHEN s = 2 THEN 6 ELSE 7 END AS tier FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY tier, coalesce(score, 0) DESC, coalesce(finding, ''), claim) AS rank FROM t) SELECT claim, tier, rank, rank <= 100 AS selected FROM k""")
def win16(spark, sf):
    return O.risk_first(select(spark, sf, RISKS), 100).select("claim", "tier", "rank", "selected")


SIGNALS = "SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal / 10000 END AS lps, c_custkey % 11 / 10.0 AS sii, CASE WHEN c_custkey % 3 = 0 THEN 1.5 ELSE 0.25 END AS hotspot, c_nationkey % 7 AS sites, c_custkey % 6 AS high, c_custkey % 4 AS medium, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey % 9 END AS low, c_custkey % 2 AS info, c_custkey % 13 = 0 AS kev, c_custkey % 10 / 10.0 AS epss, CASE WHEN c_custkey % 8 > 0 THEN c_custkey % 4 = 0 END AS exposed, c_custkey % 9 = 0 AS tainted FROM customer"
WEIGHTS = {"lps": 1000, "sii": 1000, "hotspot": 1000, "sites": 1000, "hint_high": 250, "hint_medium": 100, "hint_low": 30, "hint_info": 10, "hints_max": 1000, "kev": 250, "epss": 250, "exposed": 50, "tainted": 50}


@query("win17_rank_points", f"""
SELECT c_custkey, (floor(least(greatest(coalesce(lps, 0), 0), 1) * 1000) + floor(least(sii::DOUBLE, 1) * 1000) + floor(least(hotspot::DOUBLE, 1) * 1000) + floor(least(sites / 4, 1) * 1000) + least(1000, high * 250 + medium * 100 + coalesce(low, 0) * 30 + info * 10)
  + CASE WHEN kev THEN 250 ELSE 0 END + floor(epss::DOUBLE * 250) + CASE WHEN exposed THEN 50 ELSE 0 END + CASE WHEN tainted THEN 50 ELSE 0 END)::BIGINT AS points FROM ({SIGNALS})""")
def win17(spark, sf):
    rows = select(spark, sf, SIGNALS).withColumns({c: F.col(c).cast("double") for c in ("lps", "sii", "hotspot", "epss")})
    rows = rows.withColumn("hints", F.struct(*[F.col(k).cast("long").alias(k) for k in ("high", "medium", "low", "info")]))
    return rows.select("c_custkey", O.rank_points(rows, WEIGHTS).cast("long").alias("points"))


QUEUES = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'lead' ELSE 'hunt' END AS lane, 'p' || CAST(o_orderkey AS VARCHAR(9)) AS package, o_custkey % 10 AS rank FROM orders WHERE o_orderkey < 400"


@query("win19_fair_share", f"""
WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY rank, package) AS n FROM ({QUEUES})), z AS (SELECT count(*) FILTER (lane = 'lead') AS nl, count(*) FILTER (lane = 'hunt') AS nh FROM q),
w(turn, l, h, lane) AS (SELECT 0, 0, 0, '' UNION ALL SELECT turn + 1, l + (pick = 'lead')::INT, h + (pick = 'hunt')::INT, pick FROM (SELECT w.*, CASE WHEN l < nl AND (l < 75 OR h >= nh) AND (NOT (h < nh AND (h < 75 OR l >= nl)) OR l / 75.0 <= h / 75.0) THEN 'lead' WHEN h < nh AND (h < 75 OR l >= nl) THEN 'hunt' END AS pick FROM w, z WHERE turn < 150) WHERE pick IS NOT NULL)
SELECT w.lane, package, turn FROM w JOIN q ON q.lane = w.lane AND q.n = CASE w.lane WHEN 'lead' THEN l ELSE h END""")
def win19(spark, sf):
    return O.fair_share(select(spark, sf, QUEUES), 0.5, 150)


BUILT = "SELECT 'u' || CAST(p_partkey % 4 AS VARCHAR(9)) AS unit, 's' || CAST(p_partkey % 40 AS VARCHAR(9)) AS source, 'o' || CAST(p_partkey % 40 + p_size % 2 * 100 AS VARCHAR(9)) AS object FROM part"
LINKED = "SELECT DISTINCT 'u' || CAST(p_partkey % 4 AS VARCHAR(9)) AS unit, 'o' || CAST(p_partkey % 40 AS VARCHAR(9)) AS input, CASE WHEN p_size % 3 = 0 THEN 'b' ELSE 'a' END || CAST(p_partkey % 8 AS VARCHAR(9)) AS output, p_size % 3 > 0 AS static FROM part UNION SELECT 'u' || CAST(p_partkey % 4 AS VARCHAR(9)), 'a' || CAST(p_partkey % 8 AS VARCHAR(9)), 'b' || CAST(p_partkey % 3 AS VARCHAR(9)), false FROM part"
PAIRS = "SELECT p_partkey AS pair, 'u' || CAST(p_partkey % 4 AS VARCHAR(9)) AS unit, 's' || CAST(p_partkey % 40 AS VARCHAR(9)) AS \"left\", 's' || CAST((p_partkey + 4 * p_size) % 40 AS VARCHAR(9)) AS \"right\" FROM part"


@query("dom09_continuity", f"""
WITH b AS (SELECT DISTINCT * FROM ({BUILT})), l AS ({LINKED}), e AS (SELECT b.unit, source, output AS binary FROM b JOIN l ON l.unit = b.unit AND l.input = b.object AND NOT static UNION SELECT b.unit, source, m.output FROM b JOIN l ON l.unit = b.unit AND l.input = b.object AND l.static JOIN l m ON m.unit = b.unit AND m.input = l.output AND NOT m.static),
p AS ({PAIRS}), c AS (SELECT pair, count(*) AS n, min(x.binary) AS one FROM p JOIN e x ON x.unit = p.unit AND x.source = p."left" JOIN e y ON y.unit = p.unit AND y.source = p."right" AND y.binary = x.binary GROUP BY 1)
SELECT p.*, CASE WHEN n = 1 THEN one END AS binary, CASE WHEN n IS NULL THEN 'not_shown' WHEN n > 1 THEN 'ambiguous' ELSE 'continuous' END AS state FROM p LEFT JOIN c USING (pair)""")
def dom09(spark, sf):
    ends = O.binaries_of(select(spark, sf, BUILT).distinct(), select(spark, sf, LINKED))
    return O.same_binary(select(spark, sf, _quoted(PAIRS)), ends)


CLAIMED = [("", "all"), ("https://", "secure"), ("https://w", "web"), ("http://", "plain")]


@query("dom38_unique_claims", "SELECT DISTINCT url AS path, CASE WHEN url IS NULL THEN NULL WHEN url LIKE 'https://w%' THEN 'web' WHEN url LIKE 'https://%' THEN 'secure' WHEN url LIKE 'http://%' THEN 'plain' ELSE 'all' END AS dataset FROM pages")
def dom38(spark, sf):
    return O.owned_paths(select(spark, sf, "SELECT url AS path FROM pages"), spark.createDataFrame(CLAIMED, "prefix string, dataset string"))


MEMORY = "SELECT 'f' || CAST(l_partkey % 20 AS VARCHAR(9)) AS path, l_linenumber AS line, 'm' || CAST(l_suppkey AS VARCHAR(9)) AS fact FROM lineitem"
PLACES = "SELECT event_id AS site, 'f' || CAST(event_id % 25 AS VARCHAR(9)) AS path, CAST(event_id % 8 AS INT) AS line FROM events"


@query("dom11_memory_context", f"""
WITH m AS (SELECT DISTINCT site, fact FROM ({PLACES}) JOIN ({MEMORY}) USING (path, line)), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY fact) AS k, count(*) OVER (PARTITION BY site) AS n FROM m)
SELECT site, coalesce(string_agg(fact, ',' ORDER BY fact) FILTER (k <= 4), '') AS facts, greatest(coalesce(max(n), 0) - 4, 0) AS omitted FROM (SELECT site FROM ({PLACES})) LEFT JOIN r USING (site) GROUP BY 1""")
def dom11(spark, sf):
    return O.memory_context(select(spark, sf, PLACES), select(spark, sf, MEMORY), 4).withColumn("facts", F.array_join("facts", ","))


FILES = "SELECT item_id AS file, replace(replace(text, '. ', '.' || chr(10)), 'the', 'theQ') AS text FROM benchmark"


@query("dom31_rule_hits", f"""
WITH l AS (SELECT file, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({FILES})),
c AS (SELECT file, line, value, unnest(range(1, length(value) + 1)) AS col FROM l)
SELECT file, 'double' AS rule, line::INT AS line, col::INT AS "column" FROM c WHERE substr(value, col, 4) = 'theQ' UNION ALL SELECT file, 'comma', line::INT, col::INT FROM c WHERE substr(value, col, 1) = ','""")
def dom31(spark, sf):
    return O.rule_hits(select(spark, sf, FILES.replace("chr(10)", "'\\n'")), [("double", "the[Q]"), ("comma", ","), ("never", "zzz+")])


TERMS = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Test,unit' WHEN 1 THEN ' prod , dev' WHEN 2 THEN 'dev' WHEN 3 THEN 'what' ELSE '' END AS terms FROM customer"


@query("dom08_maximal_exposure", f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'prod' WHEN 2 THEN 'dev' ELSE 'prod' END AS exposure, CASE WHEN c_custkey % 5 < 3 THEN 'maximum-observed-evidence' ELSE 'conservative-default' END AS basis FROM ({TERMS})")
def dom08(spark, sf):
    rows = select(spark, sf, TERMS).withColumn("terms", F.split("terms", ","))
    return O.maximal_exposure(rows, "c_custkey", "terms", {"test": "test", "unit": "test", "dev": "dev", "prod": "prod"}, ["test", "dev", "prod"], "prod")


SHOULD = [("elf", "pie", "yes"), ("elf", "relro", "full"), ("pe", "aslr", "yes"), ("pe", "relro", None)]
MEASURED = "SELECT 'b' || CAST(p_partkey AS VARCHAR(9)) AS \"binary\", CASE p_partkey % 2 WHEN 0 THEN 'elf' ELSE 'pe' END AS family, CASE p_size % 3 WHEN 0 THEN 'pie' WHEN 1 THEN 'relro' ELSE 'aslr' END AS \"check\", CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'full' WHEN 2 THEN 'no' END AS value FROM part"


@query("dom29_hardening", f"""
WITH o AS ({MEASURED}), e(family, "check", wanted) AS (VALUES ('elf', 'pie', 'yes'), ('elf', 'relro', 'full'), ('pe', 'aslr', 'yes'), ('pe', 'relro', NULL))
SELECT b."binary", e."check", CASE WHEN wanted IS NULL THEN 'not_applicable' WHEN o.value IS NULL THEN 'unknown' WHEN o.value = wanted THEN 'met' ELSE 'unmet' END AS state FROM (SELECT DISTINCT "binary", family FROM o) b JOIN e USING (family) LEFT JOIN o ON o."binary" = b."binary" AND o."check" = e."check" """)
def dom29(spark, sf):
    return O.hardening(spark.createDataFrame(SHOULD, "family string, check string, value string"), select(spark, sf, _quoted(MEASURED)))
