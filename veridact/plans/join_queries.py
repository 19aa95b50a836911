"""Joins beyond equality over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import joins as J
from veridact.plans.registry import query, table

SPAN_SQL = "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS day FROM orders"


def _orders_by_day(spark, sf):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", day.alias("day"))


@query("jn01_left_join", """
SELECT c_custkey, n_name, s_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey""")
def jn01(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    supplier = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("s_name"))
    return table(spark, sf, "customer").join(nation, "c_nationkey", "left").join(supplier, "c_nationkey", "left").select("c_custkey", "n_name", "s_name")


@query("jn03_composite_key", """
SELECT a.l_orderkey, a.l_linenumber, count(b.l_orderkey) AS n FROM lineitem a LEFT JOIN lineitem b
  ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND b.l_quantity > 25 GROUP BY a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey""")
def jn03(spark, sf):
    line = table(spark, sf, "lineitem")
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    counts = line.filter("l_quantity > 25").groupBy(*keys).agg(F.count("*").alias("m"))
    out = line.join(counts, keys, "left").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.sum(F.coalesce("m", F.lit(0))).alias("n"))
    return out.select("l_orderkey", "l_linenumber", "n")


@query("jn04_range_suppression", f"""
WITH o AS ({SPAN_SQL}), s AS (SELECT o_custkey AS cust, day AS lo, day + 30 AS hi FROM o WHERE o_orderpriority = '1-URGENT')
SELECT DISTINCT o.o_orderkey FROM o JOIN s ON o.o_custkey = s.cust AND o.day BETWEEN s.lo AND s.hi""")
def jn04(spark, sf):
    orders = _orders_by_day(spark, sf).withColumn("day_end", F.col("day"))
    spans = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("day").alias("lo"), (F.col("day") + 30).alias("hi"))
    met = J.overlap_join(orders, spans, ["o_custkey"], ("day", "day_end"), ("lo", "hi"), width=32)
    return met.select("o_orderkey").distinct()


@query("jn05_overlap_tolerance", f"""
WITH o AS ({SPAN_SQL})
SELECT a.o_orderkey AS report, b.o_orderkey AS defect FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.day - 3 <= b.day + 10 AND b.day <= a.day + 5 + 3
WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'""")
def jn05(spark, sf):
    orders = _orders_by_day(spark, sf)
    reports = orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("report"), F.col("day").alias("rs"), (F.col("day") + 5).alias("re"))
    defects = orders.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("defect"), F.col("day").alias("ds"), (F.col("day") + 10).alias("de"))
    return J.overlap_join(reports, defects, ["o_custkey"], ("rs", "re"), ("ds", "de"), width=16, tolerance=3).select("report", "defect")


@query("jn06_overlap_self_join", """
SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size < b.p_size + 2 AND b.p_size < a.p_size + 2 AND a.p_partkey < b.p_partkey AND a.p_type = b.p_type""")
def jn06(spark, sf):
    a = table(spark, sf, "part").select("p_brand", "p_type", F.col("p_partkey").alias("a_key"), F.col("p_size").alias("a_lo"), (F.col("p_size") + 1).alias("a_hi"))
    b = table(spark, sf, "part").select("p_brand", "p_type", F.col("p_partkey").alias("b_key"), F.col("p_size").alias("b_lo"), (F.col("p_size") + 1).alias("b_hi"))
    met = J.overlap_join(a, b, ["p_brand", "p_type"], ("a_lo", "a_hi"), ("b_lo", "b_hi"), width=4)
    return met.filter("a_key < b_key").select("a_key", "b_key")


@query("jn07_point_in_interval", """
SELECT e.event_id, i.p_partkey FROM events e JOIN (SELECT p_partkey, p_partkey * 37 AS lo, p_partkey * 37 + p_size AS hi FROM part) i
  ON e.event_id >= i.lo AND e.event_id < i.hi""")
def jn07(spark, sf):
    intervals = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 37).alias("lo"), (F.col("p_partkey") * 37 + F.col("p_size")).alias("hi"))
    events = table(spark, sf, "events").select("event_id")
    return J.point_in_interval(events, "event_id", intervals, "lo", "hi").select("event_id", "p_partkey")


@query("jn08_point_in_2d_span", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber > 2 OR (l_linenumber = 2 AND l_quantity >= 10)) AND (l_linenumber < 4 OR (l_linenumber = 4 AND l_quantity <= 20))""")
def jn08(spark, sf):
    inside = J.inside_span(F.col("l_linenumber"), F.col("l_quantity"), (F.lit(2), F.lit(10.0)), (F.lit(4), F.lit(20.0)))
    return table(spark, sf, "lineitem").filter(inside).select("l_orderkey", "l_linenumber")


@query("jn10_best_candidate", """
SELECT l_orderkey, l_suppkey AS best_supplier FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_extendedprice, l_suppkey, l_linenumber) = 1""")
def jn10(spark, sf):
    order = F.struct((-F.col("l_discount")).alias("d"), "l_extendedprice", "l_suppkey", "l_linenumber")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_suppkey", order).alias("best_supplier"))


@query("jn11_either_endpoint", """
SELECT DISTINCT n.n_name, c.c_custkey FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey OR n.n_nationkey = c.c_custkey""")
def jn11(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    return J.either_key(nation, customer, F.col("n_nationkey") == F.col("c_nationkey"), F.col("n_nationkey") == F.col("c_custkey"), ["n_name", "c_custkey"])


@query("jn12_longest_prefix", """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
r AS (SELECT DISTINCT regexp_extract(path, '^[^/]+') AS root FROM p UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)/', 1) FROM p)
SELECT p.page_id, max_by(r.root, length(r.root)) AS root FROM p LEFT JOIN (SELECT * FROM r WHERE root <> '') r ON p.path = r.root OR starts_with(p.path, r.root || '/') GROUP BY p.page_id""")
def jn12(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    hosts = pages.select(F.regexp_extract("path", "^[^/]+", 0).alias("root"))
    folders = pages.select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("root"))
    roots = hosts.union(folders).filter("root <> ''").distinct()
    return J.longest_prefix(pages, "path", roots, "root", ["page_id"]).select("page_id", "root")


@query("jn13_innermost_span", """
WITH s AS (SELECT p_partkey, (p_partkey % 50) AS lo, (p_partkey % 50) + p_size AS hi FROM part), l AS (SELECT range AS line FROM range(0, 100))
SELECT line, p_partkey FROM l JOIN s ON line BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY line ORDER BY hi - lo, -lo, p_partkey) = 1""")
def jn13(spark, sf):
    spans = table(spark, sf, "part").select(F.lit(1).alias("file"), "p_partkey", (F.col("p_partkey") % 50).alias("lo"), (F.col("p_partkey") % 50 + F.col("p_size")).alias("hi"))
    lines = spark.range(100).select(F.lit(1).alias("file"), F.col("id").alias("line"), F.col("id").alias("line_end"))
    met = J.overlap_join(lines, spans, ["file"], ("line", "line_end"), ("lo", "hi"), width=16)
    return J.innermost(met.select("line", "p_partkey", "lo", "hi"), ["line"], "lo", "hi", "p_partkey").select("line", "p_partkey")


@query("jn15_case_insensitive", "SELECT a.n_nationkey AS a_key, b.r_regionkey AS b_key FROM nation a JOIN region b ON lower(substr(a.n_name, 1, 2)) = lower(upper(substr(b.r_name, 1, 2)))")
def jn15(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a_key"), F.lower(F.substring("n_name", 1, 2)).alias("k"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("b_key"), F.lower(F.upper(F.substring("r_name", 1, 2))).alias("k"))
    return a.join(b, "k").select("a_key", "b_key")


@query("jn17_semi_join_union", """
SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size = 50)""")
def jn17(spark, sf):
    part = table(spark, sf, "part")
    ids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).union(part.filter("p_size = 50").select("p_partkey"))
    return part.join(ids, "p_partkey", "left_semi").select("p_partkey")


@query("jn18_parent_child", "SELECT a.event_id, b.event_id AS parent FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_id // 2 = b.event_id")
def jn18(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    parent = e.select(F.col("event_id").alias("parent"), "user_id", F.col("event_id").alias("parent_key"))
    child = e.withColumn("parent_key", F.floor(F.col("event_id") / 2))
    return child.join(parent, ["user_id", "parent_key"], "left").select("event_id", "parent")


@query("jn20_nominate", """
WITH d AS (SELECT DISTINCT user_id, event_type, event_id // 20 AS e FROM events)
SELECT DISTINCT a.user_id AS left_id, b.user_id AS right_id FROM d a JOIN d b ON a.e = b.e AND a.user_id < b.user_id AND a.event_type IS DISTINCT FROM b.event_type""")
def jn20(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.floor(F.col("event_id") / 20).alias("e")).distinct()
    return J.nominate(rows, "user_id", "e", "event_type")


@query("jn21_tiered_match", """
WITH a AS (SELECT event_id AS id, user_id || ':' || event_type || ':' || floor(value)::BIGINT AS exact, user_id || ':' || event_type AS moved FROM events WHERE ts < TIMESTAMP '2024-01-10'),
b AS (SELECT event_id AS id, user_id || ':' || event_type || ':' || floor(value)::BIGINT AS exact, user_id || ':' || event_type AS moved FROM events WHERE ts >= TIMESTAMP '2024-01-20'),
a1 AS (SELECT *, row_number() OVER (PARTITION BY exact ORDER BY id) AS n FROM a), b1 AS (SELECT *, row_number() OVER (PARTITION BY exact ORDER BY id) AS n FROM b),
m1 AS (SELECT a1.id AS prior_id, b1.id AS current_id FROM a1 JOIN b1 USING (exact, n)),
a2 AS (SELECT *, row_number() OVER (PARTITION BY moved ORDER BY id) AS n FROM a WHERE id NOT IN (SELECT prior_id FROM m1)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY moved ORDER BY id) AS n FROM b WHERE id NOT IN (SELECT current_id FROM m1))
SELECT prior_id, current_id, 'exact' AS tier FROM m1 UNION ALL SELECT a2.id, b2.id, 'relocated' FROM a2 JOIN b2 USING (moved, n)""")
def jn21(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat_ws(":", "user_id", "event_type", F.floor("value")).alias("exact"), F.concat_ws(":", "user_id", "event_type").alias("moved"), "ts")
    prior, current = e.filter("ts < TIMESTAMP_NTZ '2024-01-10'"), e.filter("ts >= TIMESTAMP_NTZ '2024-01-20'")
    return J.tiered_match(prior, current, "id", [("exact", "exact"), ("relocated", "moved")])


@query("jn23_alias", """
WITH s AS (SELECT user_id, list(DISTINCT event_type) AS t, count(*) AS n FROM events GROUP BY 1)
SELECT a.user_id, CASE WHEN list_has_any(a.t, ['error', 'signup']) THEN 'may' WHEN a.n > 60 THEN 'no' ELSE 'unknown' END AS alias FROM s a""")
def jn23(spark, sf):
    sets = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"), F.count("*").alias("n"))
    return sets.select("user_id", J.may_alias(F.col("t"), F.array(F.lit("error"), F.lit("signup")), F.col("n") > 60).alias("alias"))


@query("jn24_equi_or_range", f"""
WITH o AS ({SPAN_SQL}) SELECT DISTINCT a.o_orderkey AS frame, b.o_orderkey AS finding FROM o a JOIN o b
ON a.o_custkey = b.o_custkey AND (a.day = b.day OR (b.day >= a.day AND b.day <= a.day + 7)) AND a.o_orderkey <> b.o_orderkey""")
def jn24(spark, sf):
    orders = _orders_by_day(spark, sf)
    a = orders.select("o_custkey", F.col("o_orderkey").alias("frame"), F.col("day").alias("fs"), (F.col("day") + 7).alias("fe"))
    b = orders.select("o_custkey", F.col("o_orderkey").alias("finding"), F.col("day").alias("gs"), F.col("day").alias("ge"))
    ranged = J.overlap_join(a, b, ["o_custkey"], ("fs", "fe"), ("gs", "ge"), width=16).select("frame", "finding")
    equal = a.join(b.withColumnRenamed("gs", "fs"), ["o_custkey", "fs"]).select("frame", "finding")
    return ranged.union(equal).filter("frame <> finding").distinct()


@query("jn25_missed", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn25(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("jn26_enrichment", """
SELECT l.l_orderkey, l.l_linenumber, p.p_brand, s.s_name, n.n_name, r.r_name FROM lineitem l LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey
LEFT JOIN nation n ON s_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey""")
def jn26(spark, sf):
    geo = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(geo, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return line.select("l_orderkey", "l_linenumber", "p_brand", "s_name", "n_name", "r_name")


@query("jn29_as_of", """
SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p
ON e.user_id = p.user_id AND e.ts > p.ts""")
def jn29(spark, sf):
    events = table(spark, sf, "events")
    purchases = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    out = J.as_of(errors, purchases.select("user_id", F.col("ts").alias("bought_at"), "purchase"), ["user_id"], "ts", "bought_at", "purchase")
    return out.select("event_id", F.col("last_purchase"))


@query("jn30_links_of_subject", """
SELECT l_partkey AS other FROM lineitem WHERE l_suppkey = 5 AND l_quantity > 10 UNION SELECT l_orderkey FROM lineitem WHERE l_suppkey = 5 AND l_discount > 0.05""")
def jn30(spark, sf):
    line = table(spark, sf, "lineitem").filter("l_suppkey = 5")
    return line.filter("l_quantity > 10").select(F.col("l_partkey").alias("other")).union(line.filter("l_discount > 0.05").select("l_orderkey")).distinct()


@query("jn09_ordered_match", """
SELECT user_id, length(regexp_replace(string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' ELSE 'x' END, '' ORDER BY ts, event_id), '^(?:[^v]*(v)(?:[^c]*(c)(?:[^p]*(p))?)?)?.*$', '\\1\\2\\3')) AS n
  FROM events GROUP BY user_id""")
def jn09(spark, sf):
    paths = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("path"))
    matched = J.ordered_match(F.array(*[F.lit(s) for s in ("view", "click", "purchase")]), F.col("path"))
    strict = F.when(F.get(matched, 0) < 0, 0).when(F.get(matched, 1) < 0, 1).when(F.get(matched, 2) < 0, 2).otherwise(3)
    return paths.select("user_id", strict.cast("long").alias("n"))


@query("jn14_own_line_overlap", """
WITH c AS (SELECT l_orderkey, l_linenumber * 10 AS lo, l_linenumber * 10 + 9 AS hi FROM lineitem), s AS (SELECT l_orderkey, l_partkey, l_partkey % 50 AS slo, l_partkey % 50 + l_quantity::BIGINT AS shi FROM lineitem)
SELECT l_partkey, sum(least(hi, shi) - greatest(lo, slo) + 1)::BIGINT AS lines FROM c JOIN s USING (l_orderkey) WHERE lo <= shi AND slo <= hi GROUP BY 1""")
def jn14(spark, sf):
    line = table(spark, sf, "lineitem")
    c = line.select("l_orderkey", (F.col("l_linenumber") * 10).alias("lo"), (F.col("l_linenumber") * 10 + 9).alias("hi"))
    s = line.select("l_orderkey", "l_partkey", (F.col("l_partkey") % 50).alias("slo"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("long")).alias("shi"))
    met = J.overlap_join(c, s, ["l_orderkey"], ("lo", "hi"), ("slo", "shi"), width=32)
    return met.groupBy("l_partkey").agg(F.sum(F.least("hi", "shi") - F.greatest("lo", "slo") + 1).cast("long").alias("lines"))
