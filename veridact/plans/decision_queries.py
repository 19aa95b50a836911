"""Decision tables over findings made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import decisions as D
from veridact.plans.registry import query, select


def _list(column: str):
    """A comma-joined text as an array; an empty text is an empty one."""
    return F.filter(F.split(F.col(column), ","), lambda x: x != "")


CLAIMS = "SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 32 END AS duplicate_of, o_custkey % 5 AS entity, o_orderkey % 3 <> 0 AS verifier_independent FROM orders"
RELATIONS = """
SELECT l_orderkey AS claim_id, CASE l_linenumber WHEN 1 THEN 'source_to_sink_reachability' WHEN 2 THEN 'configuration_enables' ELSE 'guard_absent' END AS predicate,
       CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END AS kind, l_tax > 0.01 AS counted FROM lineitem"""
REQUIRED = """
SELECT o_orderkey AS claim_id, 'source_to_sink_reachability' AS predicate FROM orders
UNION ALL SELECT o_orderkey, 'configuration_enables' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'guard_absent' FROM orders WHERE o_orderpriority < '3'"""


@query("lif09_adjudication", f"""
WITH c AS ({CLAIMS}), r AS ({RELATIONS}), q AS ({REQUIRED}), x AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0),
p AS (SELECT q.claim_id, q.predicate, count(*) FILTER (kind = 'supports') > 0 AS s, count(*) FILTER (kind = 'contradicts') > 0 AS n
      FROM q LEFT JOIN r ON q.claim_id = r.claim_id AND q.predicate = r.predicate AND r.counted GROUP BY 1, 2),
g AS (SELECT claim_id, bool_or(s AND n) AS conflict, bool_or(n AND NOT s) AS against, bool_or(s AND NOT n) AS held, bool_or(NOT s AND NOT n) AS unsaid,
      bool_or(n AND NOT s AND predicate = 'source_to_sink_reachability') AS a1, bool_or(n AND NOT s AND predicate = 'configuration_enables') AS a2,
      string_agg('unresolved_contradiction:' || predicate, ',' ORDER BY predicate) FILTER (s AND n) AS gc,
      string_agg('missing_direct_evidence:' || predicate, ',' ORDER BY predicate) FILTER (NOT s AND NOT n) AS gu FROM p GROUP BY 1),
d AS (SELECT c.*, g.*, x1.k IS NOT NULL AS own, x2.k IS NOT NULL AS orig,
      CASE WHEN x1.k IS NOT NULL OR x2.k IS NOT NULL THEN 'r1_duplicate' WHEN entity = 4 THEN 'r2_out_of_scope' WHEN conflict THEN 'r3_unresolved_contradiction' WHEN against THEN 'r4_direct_contradiction'
           WHEN NOT unsaid AND verifier_independent THEN 'r5_confirmed' WHEN held THEN 'r6_supported' ELSE 'r7_insufficient_evidence' END AS deciding_row
      FROM c JOIN g USING (claim_id) LEFT JOIN x x1 ON x1.k = claim_id LEFT JOIN x x2 ON x2.k = duplicate_of)
SELECT claim_id, deciding_row,
       CASE deciding_row WHEN 'r1_duplicate' THEN 'duplicate' WHEN 'r2_out_of_scope' THEN 'out_of_scope' WHEN 'r4_direct_contradiction' THEN CASE WHEN a1 THEN 'not_reachable' WHEN a2 THEN 'not_exploitable_in_observed_configuration' ELSE 'contradicted' END
            WHEN 'r5_confirmed' THEN 'confirmed' WHEN 'r6_supported' THEN 'supported' ELSE 'insufficient_evidence' END AS state,
       CASE WHEN orig THEN duplicate_of WHEN own THEN claim_id END AS duplicate_of,
       coalesce(CASE WHEN deciding_row = 'r3_unresolved_contradiction' THEN gc WHEN deciding_row IN ('r6_supported', 'r7_insufficient_evidence') THEN gu END, '') AS gaps FROM d""")
def lif09(spark, sf):
    claims = select(spark, sf, CLAIMS).withColumns({"affected": F.array("entity"), "scope": F.array(*[F.lit(k).cast("long") for k in range(4)])})
    existing = select(spark, sf, "SELECT o_orderkey AS claim_id FROM orders WHERE o_orderkey % 7 = 0")
    return D.adjudicate(claims, select(spark, sf, RELATIONS), select(spark, sf, REQUIRED), existing).withColumn("gaps", F.array_join("gaps", ","))


SHIP = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'supported' ELSE 'proposed' END AS state,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '5' THEN 'low' END AS severity,
       CASE WHEN o_custkey % 3 = 0 THEN 'sca,sast' ELSE 'sast' END AS families, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 4 = 0 END AS kev,
       o_orderkey % 2 = 0 AS distinct_model, CASE WHEN o_orderkey % 7 = 0 THEN 'taint_path,exposure' ELSE '' END AS missing FROM orders"""


@query("lif10_ship_block", f"""
WITH i AS ({SHIP}), j AS (SELECT *, coalesce(severity IN ('high', 'critical'), false) AS sev, families LIKE 'sca%' AND coalesce(kev, false) AS k, state IN ('confirmed', 'supported') AS pub FROM i),
s AS (SELECT *, CASE WHEN state = 'confirmed' AND (sev OR k) AND distinct_model THEN 'ship_blocking' WHEN state = 'confirmed' AND (sev OR k) THEN 'pending_distinct_verification' WHEN state = 'supported' AND (sev OR k) THEN 'needs_verification'
  WHEN pub AND (severity IS NULL OR missing <> '') THEN 'decision_pending' ELSE 'not_ship_blocking' END AS status FROM j)
SELECT o_orderkey, status, concat_ws(',', CASE WHEN sev THEN 'technical_severity_' || severity END, CASE WHEN k THEN 'kev_listed_dependency' END, CASE WHEN pub AND severity IS NULL THEN 'technical_severity_unrated' END,
  CASE WHEN pub AND missing <> '' THEN 'missing_factor_exposure,missing_factor_taint_path' END, CASE status WHEN 'pending_distinct_verification' THEN 'verifier_model_not_distinct' WHEN 'needs_verification' THEN 'claim_not_confirmed' END) AS reasons FROM s""")
def lif10(spark, sf):
    found = D.ship_block(F.col("state"), F.col("severity"), _list("families"), F.col("kev"), F.col("distinct_model"), _list("missing"))
    return select(spark, sf, SHIP).select("o_orderkey", found.alias("d")).select("o_orderkey", "d.status", F.array_join("d.reasons", ",").alias("reasons"))


VEX = """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN ' Reachable ' WHEN 1 THEN 'unreachable_in_target' WHEN 2 THEN 'unreachable_in_target' WHEN 3 THEN '' WHEN 4 THEN 'Unknown' WHEN 5 THEN 'call_path_reachable' END AS reach,
       CASE WHEN p_size % 4 = 0 THEN 'partial,no_symbols' ELSE '' END AS gaps, p_size % 9 = 0 AS run_gap FROM part"""


@query("lif11_reachability", f"""
WITH i AS ({VEX}), j AS (SELECT p_partkey, lower(trim(coalesce(reach, ''))) AS r, concat_ws(',', nullif(gaps, ''), CASE WHEN run_gap THEN 'run_coverage_gaps' END) AS g FROM i),
s AS (SELECT *, CASE WHEN r IN ('reachable', 'call_path_reachable') THEN 'affected' WHEN r = 'unreachable_in_target' AND g = '' THEN 'not_affected' ELSE 'under_investigation' END AS status FROM j)
SELECT p_partkey, status, CASE WHEN status = 'not_affected' THEN 'vulnerable_code_not_in_execute_path' END AS justification,
       CASE WHEN status = 'under_investigation' AND g = '' THEN coalesce(nullif(r, ''), 'coverage_unverified') ELSE g END AS gap_reasons FROM s""")
def lif11(spark, sf):
    found = D.vex_status(F.col("reach"), _list("gaps"), F.col("run_gap"))
    return select(spark, sf, VEX).select("p_partkey", found.alias("d")).select("p_partkey", "d.status", "d.justification", F.array_join("d.gap_reasons", ",").alias("gap_reasons"))


PACKAGES = "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'confirmed' ELSE 'supported' END AS state, CASE WHEN p_size < 5 THEN 'poc_outcome_unavailable' WHEN p_size > 45 THEN 'attack_chain_unavailable' ELSE '' END AS withheld FROM part"


@query("lif12_publication_buckets", f"SELECT p_partkey, CASE WHEN withheld <> '' THEN 'withheld' WHEN state = 'confirmed' THEN 'publishable' ELSE 'verification_backlog' END AS bucket FROM ({PACKAGES})")
def lif12(spark, sf):
    return select(spark, sf, PACKAGES).select("p_partkey", D.publication_bucket(F.col("state"), F.col("state"), _list("withheld")).alias("bucket"))


CRASHES = "SELECT c_custkey, 'Id-' || CAST(c_nationkey AS VARCHAR(9)) AS debug_id, 'c' || CAST(c_custkey % 40 AS VARCHAR(9)) AS code_id, 'cl' || CAST(c_custkey % 30 AS VARCHAR(9)) AS changelist, c_mktsegment AS f0, 'f' || CAST(c_nationkey AS VARCHAR(9)) AS p1 FROM customer"


@query("lif14_crash_binding", f"""
WITH i AS ({CRASHES}), j AS (SELECT *, lower(replace(debug_id, '-', '')) IN ('id3', 'id7') AS d, code_id IN ('c9') AS c, changelist = 'cl5' AS r, f0 = 'MACHINERY' AS fn, p1 IN ('f1', 'f2') AS fp FROM i)
SELECT c_custkey, CASE WHEN d OR c THEN 'build_matched' WHEN r THEN 'revision_matched' WHEN fn OR fp THEN 'symbol_matched' ELSE 'unbound' END AS tier,
       CASE WHEN d OR c OR r THEN '' ELSE concat_ws(',', CASE WHEN fn THEN '0' END, CASE WHEN fp THEN '1' END) END AS matched_frames,
       CASE WHEN d OR c THEN concat_ws(',', CASE WHEN c THEN 'code_id_matched' END, CASE WHEN d THEN 'debug_id_matched' END) WHEN r THEN 'changelist_matched' WHEN fn OR fp THEN concat_ws(',', CASE WHEN fp THEN 'file_matched' END, CASE WHEN fn THEN 'function_matched' END) ELSE 'no_match' END AS reasons FROM j""")
def lif14(spark, sf):
    none = F.lit(None).cast("string")
    reports = select(spark, sf, CRASHES).select(
        "c_custkey", "changelist", none.alias("version"), F.array(F.struct("debug_id", "code_id")).alias("modules"),
        F.array(F.struct(F.col("f0").alias("function"), none.alias("file")), F.struct(none.alias("function"), F.col("p1").alias("file"))).alias("frames"),
    )
    ids, functions, paths = (spark.createDataFrame([(v,) for v in vs], f"{c} string") for c, vs in (("debug_id", ["ID3", "i-d 7", "C9", "--"]), ("name", ["MACHINERY"]), ("path", ["f1", "f2"])))
    found = D.crash_binding(reports, "c_custkey", ids, F.lit("cl5"), functions, paths)
    return found.withColumns({"matched_frames": F.array_join(F.transform("matched_frames", lambda k: k.cast("string")), ","), "reasons": F.array_join("reasons", ",")})


CHAINS = """
SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN 'u' || CAST(o_custkey % 3 AS VARCHAR(9)) ELSE '' END AS u1, CASE WHEN o_orderkey % 4 > 0 THEN 'u' || CAST(o_orderkey % 2 AS VARCHAR(9)) END AS u2,
       CASE o_custkey % 4 WHEN 0 THEN 'net' WHEN 1 THEN ' app' ELSE '' END AS b1, CASE o_orderkey % 3 WHEN 0 THEN 'app' ELSE '' END AS b2,
       CASE o_custkey % 5 WHEN 0 THEN 'SSRF' WHEN 1 THEN 'Open Redirect' WHEN 2 THEN 'xss' ELSE NULL END AS p1, CASE o_orderkey % 5 WHEN 0 THEN 'SQL injection' WHEN 1 THEN 'path-traversal' WHEN 2 THEN 'privilege_misuse' ELSE 'style' END AS p2,
       CASE WHEN o_orderkey % 13 = 0 THEN 'cwe-502' END AS c2, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'critical' END AS s1,
       CASE o_custkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'none' ELSE 'medium' END AS s2, o_custkey % 6 = 0 AS d1, CASE WHEN o_orderkey % 17 = 0 THEN 'privilege' WHEN o_orderkey % 19 = 0 THEN 'trust_boundary' ELSE '' END AS dims FROM orders"""


@query("lif15_chain_severity", f"""
WITH i AS ({CHAINS}), j AS (SELECT *, (trim(b1) <> '' AND b2 <> '' AND trim(b1) <> b2) OR dims = 'trust_boundary' AS tb, d1 AS drift, d1 OR p1 IN ('SSRF', 'Open Redirect') IS TRUE AS piv,
  p2 = 'SQL injection' OR coalesce(c2, '') = 'cwe-502' AS crit, coalesce(u1, '') <> '' AND u2 IS NOT NULL AND u1 <> u2 AS unit FROM i),
k AS (SELECT *, crit OR p2 = 'path-traversal' AS strong FROM j), m AS (SELECT *, dims = 'privilege' OR (piv AND (p2 = 'privilege_misuse' OR strong) AND NOT tb AND NOT drift) AS priv,
  list_position(['low', 'medium', 'high', 'critical'], s1) AS r1, list_position(['low', 'medium', 'high', 'critical'], s2) AS r2 FROM k),
n AS (SELECT *, greatest(r1, r2) AS base, tb OR drift OR priv OR unit AS crossed FROM m)
SELECT o_orderkey, CASE WHEN r1 IS NULL OR r2 IS NULL OR r2 = 0 THEN NULL ELSE (['low', 'medium', 'high', 'critical'])[CASE WHEN base = 4 THEN 4 WHEN r1 >= 2 AND r2 >= 2 AND crossed THEN
   CASE WHEN crit AND (piv OR base = 3) THEN 4 WHEN base = 3 AND strong THEN 4 WHEN piv OR strong THEN greatest(base, 3) ELSE base END ELSE base END] END AS severity,
  concat_ws(',', CASE WHEN tb THEN '0:trust_boundary' END, CASE WHEN drift THEN '0:spec_drift_pivot' END, CASE WHEN priv THEN '0:privilege_boundary' END, CASE WHEN unit THEN '0:cross_unit' END) AS crossings FROM n""")
def lif15(spark, sf):
    def step(k: int):
        cwe, drift = (F.lit(None).cast("string"), F.col("d1")) if k == 1 else (F.col("c2"), F.lit(False))
        return F.struct(F.col(f"u{k}").alias("unit"), F.col(f"b{k}").alias("boundary"), F.col(f"p{k}").alias("predicate"), cwe.alias("cwe"), F.col(f"s{k}").alias("severity"), drift.alias("drift"))

    chains = select(spark, sf, CHAINS).select("o_orderkey", F.array(step(1), step(2)).alias("steps"), F.array(_list("dims")).alias("dims"))
    found = chains.select("o_orderkey", D.chain_severity(F.col("steps"), F.col("dims")).alias("d"))
    return found.select("o_orderkey", "d.severity", F.array_join("d.crossings", ",").alias("crossings"))


GUARDS = """
SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'F' THEN 'dominating' ELSE 'partial' END AS state, CASE l_linenumber % 4 WHEN 0 THEN NULL ELSE l_linenumber % 4 < 3 END AS constrains,
       CASE WHEN l_suppkey % 9 > 0 THEN l_suppkey % 9 * 8 ELSE 0 END AS object_bytes, CASE l_partkey % 7 WHEN 0 THEN '<' WHEN 1 THEN '<=' WHEN 2 THEN '>' WHEN 3 THEN '>=' WHEN 4 THEN '==' WHEN 5 THEN '!=' ELSE 'in' END AS operator,
       CASE WHEN l_partkey % 3 = 0 THEN l_orderkey % 70 END AS lhs, CASE WHEN l_partkey % 5 < 3 THEN l_orderkey % 60 END AS rhs, CASE l_returnflag WHEN 'R' THEN 'false_branch' WHEN 'A' THEN 'true_branch' ELSE 'both' END AS polarity FROM lineitem"""


@query("gr19_guard_bound", f"""
WITH i AS ({GUARDS}), j AS (SELECT *, coalesce(rhs, lhs) AS k, CASE WHEN rhs IS NULL THEN CASE operator WHEN '<' THEN '>' WHEN '<=' THEN '>=' WHEN '>' THEN '<' WHEN '>=' THEN '<=' ELSE operator END ELSE operator END AS rel FROM i),
t AS (SELECT *, CASE WHEN polarity = 'false_branch' THEN CASE rel WHEN '<' THEN '>=' WHEN '<=' THEN '>' WHEN '>' THEN '<=' WHEN '>=' THEN '<' WHEN '==' THEN '!=' WHEN '!=' THEN '==' END ELSE rel END AS taken FROM j),
r AS (SELECT *, CASE WHEN state <> 'dominating' THEN 'not_dominating' WHEN constrains IS NOT TRUE THEN 'operand_not_constrained' WHEN object_bytes = 0 THEN 'destination_size_unknown' WHEN operator = 'in' THEN 'operator_unknown' WHEN polarity = 'both' THEN 'polarity_unknown'
  WHEN lhs IS NOT NULL AND rhs IS NOT NULL THEN 'both_constant' WHEN k IS NULL THEN 'no_constant' WHEN taken NOT IN ('<', '<=', '==') THEN 'no_upper_bound' WHEN k > object_bytes + (taken = '<')::INT THEN 'exceeds_destination' END AS why FROM t)
SELECT l_orderkey, l_linenumber, why IS NULL AS bounded, coalesce(why, 'n ' || taken || ' ' || k::VARCHAR) AS reason FROM r""")
def gr19(spark, sf):
    guard = F.struct("state", "constrains", "object_bytes", "operator", F.col("lhs").alias("left"), F.col("rhs").alias("right"), "polarity")
    rows = select(spark, sf, GUARDS).withColumn("g", guard)
    return rows.select("l_orderkey", "l_linenumber", D.guard_bound(F.col("g")).alias("d")).select("l_orderkey", "l_linenumber", "d.*")


VERIFIERS = """
SELECT o_orderkey AS claim_id, 'a' || CAST(o_custkey % 20 AS VARCHAR(9)) AS actor_id, CASE WHEN o_orderkey % 9 > 0 THEN 'k' || CAST(o_orderkey % 40 AS VARCHAR(9)) ELSE '' END AS conversation_id, CASE WHEN o_custkey % 2 = 0 THEN 'h' || CAST(o_custkey % 8 AS VARCHAR(9)) END AS cache_key,
       CASE WHEN o_orderkey % 10 = 1 THEN 'seen' END AS prior_response, o_orderstatus AS provider, CASE WHEN o_orderkey % 12 > 0 THEN 'claim a' || CAST(o_orderkey % 30 AS VARCHAR(9)) END AS request FROM orders"""
ACTORS = """
SELECT l_orderkey AS claim_id, 'a' || CAST(l_suppkey % 20 AS VARCHAR(9)) AS actor_id, 'k' || CAST(l_partkey % 40 AS VARCHAR(9)) AS conversation_id, CASE WHEN l_linenumber < 3 THEN 'h' || CAST(l_partkey % 8 AS VARCHAR(9)) END AS cache_key,
       CAST(NULL AS VARCHAR(9)) AS prior_response, l_linestatus AS provider, CAST(NULL AS VARCHAR(9)) AS request FROM lineitem"""
SUPPORT = "SELECT l_orderkey AS claim_id, CASE l_partkey % 3 WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' ELSE 'SHIP' END AS predicate FROM lineitem WHERE l_tax > 0.02"
NEEDED = "SELECT o_orderkey AS claim_id, 'AIR' AS predicate FROM orders UNION ALL SELECT o_orderkey, 'RAIL' FROM orders WHERE o_orderkey % 4 = 1"


@query("dom16_independence", f"""
WITH v AS ({VERIFIERS}), a AS ({ACTORS}), s AS ({SUPPORT}), n AS ({NEEDED}),
f AS (SELECT v.claim_id, bool_or(a.actor_id = v.actor_id) AS f1, bool_or(v.prior_response IS NOT NULL) AS f2, bool_or(v.conversation_id = '' OR a.conversation_id = v.conversation_id) AS f3, bool_or(a.cache_key = v.cache_key) AS f4,
  bool_or(v.request IS NULL) AS f5, bool_or(contains(v.request, a.actor_id)) AS f6, bool_or(a.provider = v.provider) AS f7 FROM v LEFT JOIN a USING (claim_id) GROUP BY 1),
l AS (SELECT claim_id, string_agg('verifier_lacks_independent_support:' || predicate, ',' ORDER BY predicate) AS lacking FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.claim_id = n.claim_id AND s.predicate = n.predicate) GROUP BY 1),
g AS (SELECT claim_id, concat_ws(',', CASE WHEN f1 THEN 'verifier_actor_not_distinct' END, CASE WHEN f2 THEN 'verifier_conversation_has_prior_response' END, CASE WHEN f3 THEN 'verifier_conversation_not_fresh' END, lacking,
  CASE WHEN f7 THEN 'verifier_provider_not_distinct' END, CASE WHEN f5 THEN 'verifier_request_check_unavailable' END, CASE WHEN f6 THEN 'verifier_request_contains_forbidden_marker' END, CASE WHEN f4 THEN 'verifier_shares_cache_entry' END) AS gaps FROM f LEFT JOIN l USING (claim_id))
SELECT claim_id, gaps, gaps = '' AS independent FROM g""")
def dom16(spark, sf):
    found = D.independence_gaps(*[select(spark, sf, s) for s in (VERIFIERS, ACTORS, SUPPORT, NEEDED)], distinct_provider=True)
    return found.withColumn("gaps", F.array_join("gaps", ","))


LEADS = """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-787' WHEN 2 THEN 'CWE-9999' END AS cwe, CASE c_nationkey % 4 WHEN 0 THEN 'api:http' WHEN 1 THEN 'lang:c' WHEN 2 THEN 'api:auth' ELSE '' END AS tag,
       c_mktsegment AS t1, c_nationkey % 3 AS w1, 'lang:rust' AS t2, 1 AS w2 FROM customer"""
COVERS = [("web", "CWE-79"), ("web", "api:*"), ("memory", "CWE-7*"), ("memory", "lang:c"), ("auth", "api:auth"), ("builder", "BUILD*"), ("memory", "lang:*"), ("aaa", "lang:*")]


@query("dom36_routing", f"""
WITH i AS ({LEADS}), o AS (SELECT *, CASE cwe WHEN 'CWE-79' THEN 'web' WHEN 'CWE-787' THEN 'memory' END AS p0, CASE tag WHEN 'api:http' THEN 'web' WHEN 'lang:c' THEN 'memory' WHEN 'api:auth' THEN 'auth' END AS p1,
  CASE WHEN t1 = 'BUILDING' AND w1 > 1 THEN 'builder' ELSE 'aaa' END AS p2 FROM i)
SELECT c_custkey, coalesce(p0, p1, p2) AS persona, CASE WHEN p0 IS NOT NULL THEN 'lead_cwe' WHEN p1 IS NOT NULL THEN 'location_tags' ELSE 'component_tags' END AS basis FROM o""")
def dom36(spark, sf):
    leads = select(spark, sf, LEADS).select("c_custkey", "cwe", _list("tag").alias("location_tags"), F.create_map("t1", "w1", "t2", F.col("w2").cast("long")).alias("component_tags"))
    return D.route_persona(leads, "c_custkey", spark.createDataFrame(COVERS, "persona string, pattern string"))


OWED = """
SELECT p_partkey AS claim_id, CASE p_size % 4 WHEN 0 THEN 'injection' WHEN 1 THEN 'authz' ELSE 'other' END AS security_predicate, CASE WHEN p_partkey % 5 = 0 THEN 'CWE-798' WHEN p_partkey % 5 = 1 THEN 'CWE-20' END AS cwe,
       CASE p_size % 3 WHEN 0 THEN 'feature_flag' ELSE 'local_access' END AS pre, CASE p_partkey % 7 WHEN 0 THEN 'compile_unit:x' ELSE 'function:y' END AS entity FROM part"""
FAMILIES = [("CWE-798", None, "secrets"), (None, "authz", "access"), (None, "injection", "default")]
FAMILY_NEEDS = [("secrets", "secret_valid"), ("access", "identity_reaches"), ("access", "check_absent"), ("default", "source_to_sink_reachability"), ("default", "guard_absent")]


@query("dom13_obligations", f"""
WITH i AS ({OWED}), f AS (SELECT *, CASE WHEN cwe = 'CWE-798' THEN 'secrets' WHEN security_predicate = 'authz' THEN 'access' ELSE 'default' END AS family FROM i)
SELECT claim_id, predicate FROM f JOIN (VALUES ('secrets', 'secret_valid'), ('access', 'identity_reaches'), ('access', 'check_absent'), ('default', 'source_to_sink_reachability'), ('default', 'guard_absent')) q(family, predicate) USING (family)
UNION SELECT claim_id, 'configuration_enables' FROM f WHERE pre = 'feature_flag' OR entity LIKE 'compile_unit:%'""")
def dom13(spark, sf):
    claims = select(spark, sf, OWED).withColumns({"preconditions": F.array("pre"), "affected": F.array("entity")})
    families = spark.createDataFrame(FAMILIES, "cwe string, security_predicate string, family string")
    return D.required_predicates(claims, families, spark.createDataFrame(FAMILY_NEEDS, "family string, predicate string"), ["feature_flag"], ["compile_unit", "build_action"])


FACTORS = """
SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'confirmed' END AS verification, CASE c_custkey % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'local' WHEN 2 THEN 'remote' END AS attacker_control,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'public' WHEN 'MACHINERY' THEN 'local' WHEN 'FURNITURE' THEN 'internal_network' END AS exposure, CASE c_custkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS impact FROM customer"""
# Points of factors that tell how exploitable a weakness is.
POINTS = {"verification": {"supported": 20, "confirmed": 40}, "attacker_control": {"internal": 0, "direct_unclassified": 10, "local": 15, "remote": 25}, "exposure": {"local": 0, "internal_network": 5, "public": 10}}


@query("fn_risk_interval", f"""
WITH i AS ({FACTORS}), p AS (SELECT *, CASE verification WHEN 'supported' THEN 20 WHEN 'confirmed' THEN 40 END AS v, CASE attacker_control WHEN 'internal' THEN 0 WHEN 'local' THEN 15 WHEN 'remote' THEN 25 END AS a, CASE exposure WHEN 'local' THEN 0 WHEN 'internal_network' THEN 5 WHEN 'public' THEN 10 END AS e FROM i),
s AS (SELECT *, coalesce(v, 0) + coalesce(a, 0) + coalesce(e, 0) AS known, coalesce(v, 20) + coalesce(a, 0) + coalesce(e, 0) AS lo, coalesce(v, 40) + coalesce(a, 25) + coalesce(e, 10) AS hi FROM p),
b AS (SELECT *, CASE WHEN lo >= 60 THEN 'high' WHEN lo >= 40 THEN 'medium' ELSE 'low' END AS bl, CASE WHEN hi >= 60 THEN 'high' WHEN hi >= 40 THEN 'medium' ELSE 'low' END AS bh FROM s),
r AS (SELECT *, CASE WHEN bl = bh THEN bl END AS rating FROM b)
SELECT c_custkey, known, lo AS floor, hi AS ceiling, rating, concat_ws(',', CASE WHEN a IS NULL THEN 'attacker_control' END, CASE WHEN e IS NULL THEN 'exposure' END, CASE WHEN v IS NULL THEN 'verification' END) AS unresolved,
  CASE WHEN rating IS NULL OR impact IS NULL THEN NULL WHEN impact = 'critical' THEN CASE rating WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'high' ELSE 'medium' END WHEN impact = 'high' THEN rating WHEN impact = 'medium' AND rating = 'high' THEN 'medium' ELSE 'low' END AS severity FROM r""")
def fn_risk_interval(spark, sf):
    found = D.risk_interval({n: F.col(n) for n in POINTS}, POINTS, 40, 60)
    rows = select(spark, sf, FACTORS).select("c_custkey", "impact", found.alias("r")).select("c_custkey", "impact", "r.*")
    return rows.select("c_custkey", "known", "floor", "ceiling", "rating", F.array_join("unresolved", ",").alias("unresolved"), D.technical_severity(F.col("impact"), F.col("rating")).alias("severity"))


HARM = """
SELECT l_partkey, CASE l_linenumber % 3 WHEN 0 THEN ' Integrity' ELSE 'Confidentiality' END AS scope,
       CASE l_suppkey % 9 WHEN 0 THEN 'Read  Memory' WHEN 1 THEN 'Unexpected State' WHEN 2 THEN 'DoS: Amplification' WHEN 3 THEN 'Modify Memory' ELSE 'Other' END AS impact FROM lineitem WHERE l_orderkey % 5 = 0"""


@query("fn_cwe_impact", f"""
WITH i AS ({HARM}), g AS (SELECT *, bool_or(trim(scope) = 'Integrity' AND impact <> 'Unexpected State') OVER (PARTITION BY l_partkey) AS integral FROM i),
s AS (SELECT l_partkey, CASE impact WHEN 'Read  Memory' THEN CASE WHEN integral THEN 3 ELSE 2 END WHEN 'Unexpected State' THEN 1 WHEN 'DoS: Amplification' THEN 2 WHEN 'Modify Memory' THEN 3 END AS r, impact = 'Read  Memory' AND integral AS up FROM g WHERE impact <> 'Other')
SELECT l_partkey, (['low', 'medium', 'high'])[max(r)] AS impact, max(CASE WHEN up THEN r * 2 + 1 ELSE r * 2 END) % 2 = 1 AS raised FROM s GROUP BY 1""")
def fn_cwe_impact(spark, sf):
    return D.cwe_impact(select(spark, sf, HARM).withColumns({"scopes": F.array("scope"), "impacts": F.array("impact")}), "l_partkey")
