"""Upserts, versions, snapshot comparison, decision tables and scalar functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.functions import paths as P
from veridact.operators import lifecycle as L
from veridact.operators import versions as V
from veridact.plans.registry import query, table


@query("ups01_layered", """
WITH r AS (SELECT user_id % 50 || event_type AS key, event_id AS layer, CASE WHEN event_id % 29 = 0 THEN NULL ELSE floor(value)::BIGINT END AS modified FROM events),
n AS (SELECT *, max(CASE WHEN modified IS NULL THEN layer END) OVER (PARTITION BY key) AS ln FROM r)
SELECT key, layer, modified FROM n WHERE ln IS NULL OR layer >= ln QUALIFY row_number() OVER (PARTITION BY key ORDER BY modified DESC NULLS LAST, layer DESC) = 1""")
def ups01(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.col("user_id") % 50, "event_type").alias("key"), F.col("event_id").alias("layer"), F.when(F.col("event_id") % 29 != 0, F.floor("value")).alias("modified"))
    return L.layered_upsert(rows, "key", "layer", "modified")


@query("ups02_newest", """
SELECT user_id, max(struct_pack(m := ts, b := event_type)).b AS event_type FROM events GROUP BY user_id""")
def ups02(spark, sf):
    newest, _ = L.newest_only(table(spark, sf, "events").select("user_id", "ts", "event_type"), "user_id", "ts", "event_type")
    return newest.select("user_id", "event_type")


@query("ups02b_conflicts", "SELECT o_custkey, o_orderdate::DATE::VARCHAR AS day FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1")
def ups02b(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_orderstatus")
    return L.newest_only(rows, "o_custkey", "day", "o_orderstatus")[1]


@query("lif01_lifecycle", """
WITH a AS (SELECT DISTINCT user_id * 10 + ascii(event_type) % 10 AS id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-08' AND value > 70), b AS (SELECT DISTINCT user_id * 10 + ascii(event_type) % 10 AS id FROM events WHERE ts >= TIMESTAMP '2024-01-23' AND value > 70)
SELECT a.id AS prior_id, b.id AS current_id, CASE WHEN b.id IS NOT NULL THEN 'persisting' WHEN a.user_id % 3 <> 0 THEN 'not_redetected' ELSE 'not_covered' END AS state FROM a LEFT JOIN b USING (id)
UNION ALL SELECT NULL, b.id, 'new' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def lif01(spark, sf):
    key = (F.col("user_id") * 10 + F.ascii("event_type") % 10).alias("id")
    hot = table(spark, sf, "events").filter("value > 70")
    a = hot.filter("ts < TIMESTAMP_NTZ '2024-01-08'").select(key, (F.col("user_id") % 3 != 0).alias("covered")).distinct()
    b = hot.filter("ts >= TIMESTAMP_NTZ '2024-01-23'").select(key).distinct()
    matches = a.join(b, "id").select(F.col("id").alias("prior_id"), F.col("id").alias("current_id"))
    return L.compare(a, b, matches, "id", "covered")


@query("lif04_trend", """
WITH a AS (SELECT o_orderpriority AS metric, round(avg(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS metric, round(avg(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT metric, a.v AS before, b.v AS after, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'new' WHEN (CASE WHEN metric = '1-URGENT' THEN a.v - b.v ELSE b.v - a.v END) < -100 THEN 'regression'
 WHEN (CASE WHEN metric = '1-URGENT' THEN a.v - b.v ELSE b.v - a.v END) > 100 THEN 'improved' ELSE 'passed' END AS state FROM a FULL JOIN b USING (metric)""")
def lif04(spark, sf):
    orders = table(spark, sf, "orders")
    a, b = (orders.filter(c).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg("o_totalprice"), 2).alias("value")) for c in ("o_orderstatus = 'F'", "o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'"))
    return L.trend(a, b, ["1-URGENT"], 100)


@query("lif08_crosswalk", """
WITH f AS (SELECT user_id, bool_or(event_type = 'error') AS e, bool_or(event_type = 'purchase' AND value > 90) AS p, bool_or(event_type = 'signup') AS s FROM events GROUP BY 1)
SELECT user_id, 'failed_buyer' AS tag FROM f WHERE e AND p UNION ALL SELECT user_id, 'newcomer' FROM f WHERE s""")
def lif08(spark, sf):
    kind = F.col("event_type")
    rules = [("failed_buyer", [kind == "error", (kind == "purchase") & (F.col("value") > 90)]), ("newcomer", [kind == "signup"])]
    return L.crosswalk(table(spark, sf, "events"), "user_id", rules)


@query("dom03_one_role", """
SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN 'fr' WHEN url LIKE '%/en/%' THEN 'en' WHEN url LIKE '%/de/%' THEN 'de' ELSE 'unclaimed' END AS role FROM pages""")
def dom03(spark, sf):
    rows = [(F.col("url").contains(f"/{x}/"), x) for x in ("fr", "en", "de")]
    return table(spark, sf, "pages").select("page_id", L.first_true(rows, "unclaimed").alias("role"))


@query("dom23_pair_expansion", "SELECT l_orderkey, l_linenumber, unnest(['defect', 'control']) AS role FROM lineitem WHERE l_returnflag = 'R'")
def dom23(spark, sf):
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.explode(F.array(F.lit("defect"), F.lit("control"))).alias("role"))


@query("dom42_role_outcomes", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY 1")
def dom42(spark, sf):
    g = table(spark, sf, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    return g.groupBy("role").agg(F.sum("n").alias("turns"), F.count("*").alias("conversations"), F.round(F.sum("c") / F.sum("n"), 4).alias("mean_chars"))


@query("ver02_range_sweep", """
SELECT p_partkey, (p_size >= 10 AND p_size < 20) OR (p_size >= 30 AND p_size <= 40) AS affected FROM part""")
def ver02(spark, sf):
    events = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in (("introduced", "10.0.0"), ("fixed", "20.0.0"), ("introduced", "30.0.0"), ("last_affected", "40.0.0"))])
    return table(spark, sf, "part").select("p_partkey", V.in_range(F.concat("p_size", F.lit(".0.0")), events).alias("affected"))


@query("ver04_verdict", """
SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'withdrawn' WHEN p_size = 7 OR p_size >= 40 THEN 'affected' WHEN p_partkey % 5 = 0 THEN 'undetermined' ELSE 'not_affected' END AS verdict FROM part""")
def ver04(spark, sf):
    text = F.concat("p_size", F.lit(".0.0"))
    events = F.array(F.struct(F.lit("introduced").alias("kind"), F.lit("40.0.0").alias("version")))
    listed = F.when((F.col("p_partkey") % 5 == 0) & (F.col("p_size") != 7), F.lit(None)).otherwise(F.col("p_size") == 7)
    return table(spark, sf, "part").select("p_partkey", V.verdict(listed, V.in_range(text, events), F.col("p_partkey") % 17 == 0).alias("verdict"))


@query("fn_cwe_number", r"""
SELECT event_id, CASE WHEN regexp_matches(t, '^(cwe[-_ ]?)?0*[0-9]{1,5}$') THEN regexp_extract(t, '^(?:cwe[-_ ]?)?0*([0-9]{1,5})$', 1)::INT END AS cwe
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'cwe-' || user_id WHEN 1 THEN '00' || user_id ELSE 'none' END AS t FROM events)""")
def fn_cwe(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("CWE-"), "user_id")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("00"), "user_id")).otherwise(F.lit("none"))
    return table(spark, sf, "events").select("event_id", P.cwe_number(text).alias("cwe"))


@query("fn_severity_band", "SELECT event_id, CASE WHEN value / 12 > 10 THEN 'unknown' WHEN value = 0 THEN 'none' WHEN value / 12 < 4 THEN 'low' WHEN value / 12 < 7 THEN 'medium' WHEN value / 12 < 9 THEN 'high' ELSE 'critical' END AS band FROM events")
def fn_band(spark, sf):
    return table(spark, sf, "events").select("event_id", P.cvss_band(F.col("value") / 12).alias("band"))


@query("fn_month_window", "SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 6 MONTH)::DATE::VARCHAR AS start FROM orders")
def fn_month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.add_months(F.col("o_orderdate").cast("date"), -6).cast("string").alias("start"))


@query("chg02_deployment", """
SELECT e.event_id, min(p.ts) AS deployed_at FROM (SELECT * FROM events WHERE event_type = 'signup') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND p.ts >= e.ts GROUP BY 1""")
def chg02(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "events").filter(F.col("event_type").isin("signup", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)
    return rows.withColumn("deployed_at", nxt).filter("event_type = 'signup'").select("event_id", "deployed_at")


@query("str05_latest_status", "SELECT user_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS status FROM events GROUP BY 1")
def str05(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("str10_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str10(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("str10b_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def str10b(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")
