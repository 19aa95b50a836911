"""Signals of changes, and versions and packages, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridact.operators import change as C
from veridact.operators import versions as V
from veridact.plans.registry import query, select, table

# The precedence that SemVer 2.0.0 gives as its example, with texts that are no versions.
ORDERED = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "99999999999999999999.0.0"]
ALIKE = {"1.0.0+build.1": 8, "1.2.0+exp.sha.5114f85": 10}
INVALID = ["v1.2.3", "1.0.0-01", "1.0", "01.0.0", "1.0.0-", "1.0.0+", "1.0.0-a..b", "", "1.0.0 "]
TEXTS = [*ORDERED, *ALIKE, *INVALID]
RANKS = ", ".join(f"({i}, '{t}', {ORDERED.index(t) + 1 if t in ORDERED else ALIKE.get(t, 'NULL')})" for i, t in enumerate(TEXTS))


@query("ver01_semver_order", f"""
SELECT p_partkey, text, rank::INT AS rank FROM part JOIN (VALUES {RANKS}) v(k, text, rank) ON p_partkey % {len(TEXTS)} = k""")
def ver01(spark, sf):
    texts = F.array(*[F.lit(t) for t in TEXTS])
    rows = table(spark, sf, "part").select("p_partkey", F.get(texts, (F.col("p_partkey") % len(TEXTS)).cast("int")).alias("text")).withColumn("key", V.version_key(F.col("text")))
    ranks = rows.filter("key IS NOT NULL").select("key").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy("key")))
    return rows.join(F.broadcast(ranks), "key", "left").select("p_partkey", "text", "rank")


PACKAGES = """
SELECT CASE p_size % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'Go' WHEN 2 THEN 'PyPI' ELSE 'Debian:11' END AS ecosystem, 'Pkg' || CAST(p_partkey % 10 AS VARCHAR(9)) AS name, p_partkey % 10 AS k, p_partkey % 5 AS minor,
       CASE WHEN p_size % 4 = 1 AND p_partkey % 3 > 0 THEN 'v1.' ELSE '1.' END || CAST(p_partkey % 5 AS VARCHAR(9)) || '.0' AS version FROM part"""


@query("ver05_package_match", f"""
WITH p AS (SELECT DISTINCT * FROM ({PACKAGES})),
a(ecosystem, k, advisory, lo, hi, gap, gone) AS (VALUES ('npm', 1, 'A1', 0, 2, NULL, false), ('npm', 1, 'A2', 3, 4, NULL, false), ('PyPI', 2, 'A3', 9, 9, 'range_ordering_unsupported:PyPI', false), ('Go', 3, 'A4', 1, 3, NULL, false),
  ('npm', 4, 'A5', 9, 9, 'range_type_unsupported:GIT', false), ('npm', 1, 'A6', 9, 9, NULL, true), ('PyPI', 5, 'A7', 0, 3, NULL, false), ('npm', 6, 'A8', 9, 9, 'advisory_record_missing', false), ('Go', 7, 'A9', 9, 9, 'range_event_unparseable:Go', false)),
j AS (SELECT p.*, a.advisory, a.gap, CASE WHEN gone THEN 'withdrawn' WHEN minor >= lo AND minor < hi THEN 'affected' WHEN gap IS NOT NULL THEN 'undetermined' WHEN advisory IS NOT NULL THEN 'not_affected' END AS status FROM p LEFT JOIN a USING (ecosystem, k))
SELECT ecosystem, name, version, coalesce(string_agg(advisory, ',' ORDER BY advisory) FILTER (status = 'affected'), '') AS matches, coalesce(string_agg(advisory, ',' ORDER BY advisory) FILTER (status = 'undetermined'), '') AS undetermined,
  count(*) FILTER (status = 'not_affected') AS not_affected, count(*) FILTER (status = 'withdrawn') AS withdrawn,
  concat_ws(',', CASE WHEN ecosystem = 'Debian:11' THEN 'ecosystem_not_indexed:Debian:11' END, string_agg(gap, ',' ORDER BY gap) FILTER (status = 'undetermined')) AS gaps,
  CASE WHEN ecosystem = 'Debian:11' OR bool_or(status = 'undetermined') THEN 'partial' ELSE 'complete' END AS status FROM j GROUP BY 1, 2, 3""")
def ver05(spark, sf):
    def ranges(*rs):
        return [{"type": t, "events": [{"kind": k, "version": v} for k, v in events]} for t, events in rs]

    rows = [
        ("A1", "npm", "pkg1", [], ranges(("SEMVER", [("introduced", "0"), ("fixed", "1.2.0")]))), ("A2", "npm", "PKG1", ["1.3.0"], []), ("A3", "PyPI", "pkg2", [], ranges(("ECOSYSTEM", [("introduced", "0")]))),
        ("A4", "Go", "pkg3", [], ranges(("SEMVER", [("last_affected", "1.2.0"), ("introduced", "v1.1.0")]))), ("A5", "npm", "pkg4", [], ranges(("GIT", [("introduced", "0")]))), ("A6", "npm", "pkg1", ["1.0.0"], []),
        ("A7", "PyPI", "pkg5", [], ranges(("SEMVER", [("introduced", "0"), ("limit", "1.3.0")]), ("GIT", [("introduced", "0")]))), ("A8", "npm", "pkg6", ["1.0.0"], []), ("A9", "Go", "pkg7", [], ranges(("SEMVER", [("introduced", "1.x")]))),
    ]
    affected = spark.createDataFrame(rows, "advisory_id string, ecosystem string, name string, versions array<string>, ranges array<struct<type:string,events:array<struct<kind:string,version:string>>>>")
    advisories = spark.createDataFrame([(f"A{i}", "2020" if i == 6 else " " if i == 1 else None) for i in (1, 2, 3, 4, 5, 6, 7, 9)], "advisory_id string, withdrawn string")
    indexed = spark.createDataFrame([("npm",), ("Go",), ("PyPI",)], "ecosystem string")
    found = V.match_packages(select(spark, sf, PACKAGES), affected, advisories, indexed)
    return found.withColumns({c: F.array_join(c, ",") for c in ("matches", "undetermined", "gaps")})


REVIEWS = """
SELECT o_orderkey, o_orderdate AS created, o_custkey % 900 AS merge_s, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey % 500 END AS head_s, 'r' || CAST(o_orderkey % 3 AS VARCHAR(9)) AS author,
       'r' || CAST(o_custkey % 3 AS VARCHAR(9)) AS reviewer, o_custkey % 700 AS at_s, 'c' || CAST(o_orderkey % 2 AS VARCHAR(9)) AS commit_id, o_orderkey % 4 = 0 AS twice, 100 * (o_custkey % 9) AS again_s FROM orders"""


@query("chg01_review_speed", f"""
WITH i AS ({REVIEWS}), a AS (SELECT o_orderkey, at_s, commit_id FROM i WHERE reviewer <> author UNION ALL SELECT o_orderkey, again_s, 'c1' FROM i WHERE twice),
f AS (SELECT o_orderkey, min(at_s) AS any_s, min(at_s) FILTER (commit_id = 'c0') AS head_at FROM a GROUP BY 1)
SELECT i.o_orderkey, any_s AS first_seconds, head_at - head_s AS head_seconds, (any_s < 300) OR (head_at - head_s < 300) AS fast_approval, merge_s < 300 AS fast_merge, coalesce(head_at IS NOT NULL, false) AS head_approved,
  any_s IS NOT NULL AND head_at IS NULL AS stale_approval, any_s IS NULL AS unapproved, CASE WHEN head_s IS NULL THEN 'incomplete' ELSE 'known' END AS status FROM i LEFT JOIN f USING (o_orderkey)""")
def chg01(spark, sf):
    after = lambda c: F.expr(f"timestampadd(SECOND, {c}, created)")
    rows = select(spark, sf, REVIEWS)
    one = F.struct("reviewer", after("at_s").alias("at"), F.col("commit_id").alias("commit"))
    two = F.struct(F.lit("r9").alias("reviewer"), after("again_s").alias("at"), F.lit("c1").alias("commit"))
    approvals = F.when(F.col("twice"), F.array(one, two)).otherwise(F.array(one))
    found = C.review_speed(F.col("created"), after("head_s"), after("merge_s"), F.lit("c0"), approvals, F.col("author"))
    return rows.select("o_orderkey", found.alias("r")).select("o_orderkey", "r.*")


# The zone's clocks in SQL: daylight saving from the first Sunday of April to the last of October, at two, until 2006, from the second Sunday of March to the first of November after.
CLOCKS = """
WITH t AS (SELECT o_orderkey, o_orderdate + to_hours((o_orderkey * 7 % 24)::INT) AS t0 FROM orders), y AS (SELECT *, year(t0) AS y FROM t),
b AS (SELECT *, make_date(y, 4, 1) + ((7 - dayofweek(make_date(y, 4, 1))) % 7)::INT AS starts, make_date(y, 10, 31) - dayofweek(make_date(y, 10, 31))::INT AS ends FROM y),
l AS (SELECT *, t0 - to_hours(CASE WHEN t0 >= starts + INTERVAL 7 HOUR AND t0 < ends + INTERVAL 6 HOUR THEN 4 ELSE 5 END) AS here FROM b)"""


@query("chg03_off_hours", f"{CLOCKS} SELECT o_orderkey, dayofweek(here) IN (0, 6) OR strftime(here, '%H:%M') < '09:00' OR strftime(here, '%H:%M') >= '17:30' AS off_hours FROM l")
def chg03(spark, sf):
    """The supplied orders are from the years before 2006."""
    at = F.expr("timestampadd(HOUR, CAST(o_orderkey * 7 % 24 AS INT), o_orderdate)")
    return table(spark, sf, "orders").select("o_orderkey", C.off_hours(at, "America/New_York", "09:00", "17:30").alias("off_hours"))


TOUCHED = "SELECT l_orderkey AS change_id, 'k' || CAST(l_partkey % 12 AS VARCHAR(9)) AS component, CAST(l_quantity AS BIGINT) AS churn FROM lineitem"
ROOTS = [(f"k{i}", r) for i, r in enumerate(["", "a", "a/b", "a/b/c", "c", "ca", "d/e", "d", "f", "g", "h", "i"])]


@query("chg04_scope_sprawl", f"""
WITH RECURSIVE o AS (SELECT change_id, component, sum(churn) AS churn FROM ({TOUCHED}) GROUP BY 1, 2), z AS (SELECT change_id FROM o GROUP BY 1 HAVING count(*) <= 4),
s AS (SELECT a.component AS l, b.component AS r, count(*) AS n FROM o a JOIN o b ON a.change_id = b.change_id AND a.component <> b.component JOIN z ON z.change_id = a.change_id GROUP BY 1, 2),
q(l, r) AS (VALUES ('k1', 'k2'), ('k1', 'k3'), ('k2', 'k3'), ('k6', 'k7')), x AS (SELECT l, r FROM q UNION SELECT r, l FROM q),
e AS (SELECT a.change_id, a.component AS l, b.component AS r FROM o a JOIN o b ON a.change_id = b.change_id AND a.component <> b.component LEFT JOIN s ON s.l = a.component AND s.r = b.component LEFT JOIN x ON x.l = a.component AND x.r = b.component LEFT JOIN z ON z.change_id = a.change_id
  WHERE x.l IS NOT NULL OR coalesce(s.n, 0) - (z.change_id IS NOT NULL)::INT >= 90),
w(change_id, component, seen) AS (SELECT change_id, component, component FROM o UNION SELECT w.change_id, w.component, e.r FROM w JOIN e ON e.change_id = w.change_id AND e.l = w.seen),
g AS (SELECT change_id, component, min(seen) AS grp FROM w GROUP BY 1, 2), p AS (SELECT change_id, grp, sum(churn) AS churn FROM o JOIN g USING (change_id, component) GROUP BY 1, 2),
t AS (SELECT change_id, sum(churn) AS total, count(*) AS n FROM p GROUP BY 1), f AS (SELECT change_id, t.n, total, sum(-(churn / total) * log2(churn / total)) AS bits, max(churn / total) AS top FROM p JOIN t USING (change_id) GROUP BY ALL)
SELECT change_id, n AS groups, total::BIGINT AS churn, round(CASE WHEN n > 1 THEN bits / log2(n) ELSE 0 END, 6) AS entropy, round(top, 6) AS top_share, n >= 3 AND total >= 60 AND CASE WHEN n > 1 THEN bits / log2(n) ELSE 0 END >= 0.8 AS sprawling FROM f""")
def chg04(spark, sf):
    found = C.scope_sprawl(select(spark, sf, TOUCHED), spark.createDataFrame(ROOTS, "component string, root string"), support=90, most=4, groups=3, churn=60, entropy=0.8)
    return found.withColumns({c: F.round(c, 6) for c in ("entropy", "top_share")})


CHANGED = """
SELECT l_orderkey AS unit, CASE l_partkey % 6 WHEN 0 THEN 'src/m' WHEN 1 THEN 'tests/test_m' WHEN 2 THEN 'api/v' WHEN 3 THEN 'docs/m' WHEN 4 THEN 'lib/m' ELSE 'src/m' END || CAST(l_suppkey % 4 AS VARCHAR(9)) ||
       CASE l_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.py' WHEN 2 THEN '.proto' WHEN 3 THEN '.md' WHEN 4 THEN '.py' ELSE '_test.py' END AS path, l_suppkey % 3 AS component, CAST(l_quantity AS BIGINT) AS churn FROM lineitem"""


@query("chg05_test_churn", f"""
WITH c AS ({CHANGED}), r AS (SELECT *, CASE WHEN path LIKE 'tests/%' OR path LIKE '%_test.py' THEN 'test' WHEN path LIKE '%.proto' THEN 'contract' WHEN path LIKE '%.py' THEN 'production' END AS role FROM c),
m AS (SELECT *, replace(replace(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', ''), 'test_', ''), '_test', '') AS stem FROM r WHERE role IS NOT NULL),
s AS (SELECT unit, stem, count(DISTINCT path) AS n FROM m WHERE role = 'production' GROUP BY 1, 2), k AS (SELECT DISTINCT unit, component FROM m WHERE role = 'production'),
t AS (SELECT m.unit, m.churn, s.n, s.n IS NOT NULL OR k.unit IS NOT NULL AS tied FROM m LEFT JOIN s ON s.unit = m.unit AND s.stem = m.stem LEFT JOIN k ON k.unit = m.unit AND k.component = m.component WHERE role = 'test'),
u AS (SELECT unit, sum(churn) FILTER (tied) AS a, sum(churn) FILTER (NOT tied) AS b, count(*) FILTER (n > 1) AS amb FROM t GROUP BY 1),
z AS (SELECT unit, coalesce(sum(churn) FILTER (role = 'production'), 0) AS p, coalesce(sum(churn) FILTER (role = 'contract'), 0) AS q FROM m GROUP BY 1)
SELECT unit, p::BIGINT AS production, q::BIGINT AS contract, coalesce(a, 0)::BIGINT AS associated, coalesce(b, 0)::BIGINT AS unassociated, coalesce(amb, 0) AS ambiguous, p + q >= 30 AND coalesce(a, 0) = 0 AS untested_production, q > 0 AND coalesce(a, 0) + coalesce(b, 0) = 0 AS untested_contract
FROM z LEFT JOIN u USING (unit)""")
def chg05(spark, sf):
    return C.test_churn(select(spark, sf, CHANGED), ["tests/**", "*_test.py"], ["**/*.proto"], [".py"], 30)


FLAGS = "SELECT o_custkey, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey % 3 = 0 END AS fast, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 2 = 0 END AS stale, o_orderstatus = 'F' AS late FROM orders"


@query("chg06_flag_counts", f"""
WITH i AS ({FLAGS}), u AS (SELECT o_custkey, 'fast' AS flag, fast AS v FROM i UNION ALL SELECT o_custkey, 'stale', stale FROM i UNION ALL SELECT o_custkey, 'late', late FROM i)
SELECT o_custkey, flag, CASE WHEN count(v) > 0 THEN count(*) FILTER (v) END AS n, CASE WHEN count(v) = 0 THEN 'unavailable' WHEN count(v) < count(*) THEN 'partial' ELSE 'available' END AS availability FROM u GROUP BY 1, 2""")
def chg06(spark, sf):
    return C.flag_counts(select(spark, sf, FLAGS), "o_custkey", ["fast", "stale", "late"])


EXPORTS = """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '{"id": "d1", "status": "success", "at": "2024-01-01T10:00:00Z"}' WHEN 1 THEN '{"id": "d2", "status": "odd", "at": "2024-01-01T10:00:00+02:00"}' WHEN 2 THEN '{"id": "d3", "status": "failed", "at": "2024-01-01T10:00:00"}'
  WHEN 3 THEN 'not json' WHEN 4 THEN '{"status": "success"}' WHEN 5 THEN '{"id": "d6", "status": "failed", "at": "2024-02-30T10:00:00Z"}' ELSE '{"id": "d7"}' END AS body FROM orders"""


@query("chg10_accepted_records", f"""
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'd1' WHEN 6 THEN 'd7' END AS id, CASE o_orderkey % 7 WHEN 1 THEN 'status:status' WHEN 2 THEN 'timestamp:at' WHEN 3 THEN 'malformed' WHEN 4 THEN 'missing:id' WHEN 5 THEN 'timestamp:at' END AS rejected FROM ({EXPORTS})""")
def chg10(spark, sf):
    found = C.accepted_records(select(spark, sf, EXPORTS), "body", "id string, status string, at string", ["id"], ["at"], {"status": ["success", "failed"]})
    return found.select("o_orderkey", F.col("record.id").alias("id"), "rejected")
