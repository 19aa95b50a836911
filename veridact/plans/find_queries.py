"""Scans, facets, search, pages and set operations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.functions import paths as P
from veridact.operators import evidence as E
from veridact.operators import search as S
from veridact.plans.registry import query, table


@query("src01_entity_scan", """
SELECT o.o_orderkey AS identity, o.o_orderstatus AS kind, l.l_partkey AS path_id, l.l_linenumber AS start_line
FROM orders o LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) l ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderstatus IN ('O', 'P') ORDER BY o.o_orderkey, l.l_partkey, l.l_suppkey LIMIT 500""")
def src01(spark, sf):
    entities = table(spark, sf, "orders").select(F.col("o_orderkey").alias("identity"), F.col("o_orderstatus").alias("kind"))
    locations = table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("path_id"), F.col("l_linenumber").alias("start_line"), "l_suppkey")
    scanned = E.scan_entities(entities, locations, ["O", "P"])
    return scanned.orderBy("identity", "path_id", "l_suppkey").limit(500).drop("l_suppkey")


@query("src02_relation_scan", """
SELECT l_orderkey || '-' || l_linenumber AS relation_id, l_returnflag AS kind, l_orderkey AS source_id, l_partkey AS target_id
FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def src02(spark, sf):
    rows = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("R", "A"))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("relation_id"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))


@query("src03_coverage_scan", """
SELECT 'orders' AS area, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def src03(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.lit("orders").alias("area"), F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
    return a.union(table(spark, sf, "lineitem").groupBy(F.lit("lineitem"), "l_linestatus").agg(F.count("*")))


@query("src04_shard_selection", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = 'Brand#13' OR starts_with(p_type, 'PROMO')")
def src04(spark, sf):
    return table(spark, sf, "part").filter((F.col("p_brand") == "Brand#13") | F.col("p_type").startswith("PROMO")).select("p_partkey", "p_brand", "p_type")


@query("flt01_find", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 101")
def flt01(spark, sf):
    found = E.find(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None})
    return S.page(found.select("o_orderkey", "o_custkey"), ["o_orderkey"], 100)


@query("flt02_artifact_facets", "SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = 'Brand#21' AND p_size = 10")
def flt02(spark, sf):
    return E.find(table(spark, sf, "part"), {"p_brand": "Brand#21", "p_type": None, "p_size": 10}).select("p_partkey", "p_name", "p_size")


@query("flt03_observation_ranges", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity <= 30 AND l_quantity + 5 >= 20 AND length(l_linestatus) >= 1""")
def flt03(spark, sf):
    rows = E.find(table(spark, sf, "lineitem"), {"l_returnflag": "R", "l_linestatus": None})
    return rows.filter(E.overlapping(F.col("l_quantity"), F.col("l_quantity") + 5, 20, 30) & (F.length("l_linestatus") >= 1)).select("l_orderkey", "l_linenumber")


@query("flt04_closed_facets", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def flt04(spark, sf):
    return E.find(table(spark, sf, "supplier"), {"s_nationkey": 7, "s_name": None}).select("s_suppkey", "s_name")


@query("flt05_hotspots_by_score", """
SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer
QUALIFY c_acctbal >= 5000""")
def flt05(spark, sf):
    from veridact.operators.ranking import global_rank

    ranked = global_rank(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")])
    return ranked.filter("c_acctbal >= 5000")


@query("flt06_nonzero_signal", """
SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') <> 0""")
def flt06(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("metrics"))
    return maps.filter(E.nonzero_signal(F.col("metrics"), "error")).select("user_id")


@query("flt07_inventory_facets", "SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src2')")
def flt07(spark, sf):
    return E.find(table(spark, sf, "documents"), {"lang": "fr"}).filter(F.col("source").isin("src1", "src2")).select("doc_id", "lang", "source")


@query("flt08_named_set", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def flt08(spark, sf):
    return E.find(table(spark, sf, "events"), {"event_type": "purchase"}).filter("value > 50").select("event_id", "user_id")


@query("flt09_within_subject", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 10) AND l_returnflag = 'N'")
def flt09(spark, sf):
    subjects = table(spark, sf, "orders").filter("o_custkey = 10").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").filter("l_returnflag = 'N'").join(subjects, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("flt11_first_present_alias", """
SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), nullif(json_extract_string(props, '$.k'), ''), 'none') AS label FROM events""")
def flt11(spark, sf):
    alias = E.first_present(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k"), F.lit("none"))
    return table(spark, sf, "events").select("event_id", alias.alias("label"))


@query("flt12_audit_trace", """
SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1))""")
def flt12(spark, sf):
    parts = table(spark, sf, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    orders = table(spark, sf, "lineitem").join(parts, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(orders, "o_orderkey", "left_semi").select("o_custkey").distinct()


@query("flt13_log_filter", "SELECT event_id, ts, event_type FROM events WHERE event_type IN ('error', 'signup') AND user_id = 5")
def flt13(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type").isin("error", "signup") & (F.col("user_id") == 5)).select("event_id", "ts", "event_type")


@query("flt14_glob", r"SELECT page_id FROM pages WHERE regexp_matches(regexp_replace(url, '^https?://', ''), '^[^/]*/[^/][^/]/.*$')")
def flt14(spark, sf):
    return table(spark, sf, "pages").filter(P.matches_glob(F.regexp_replace("url", "^https?://", ""), "*/??/**")).select("page_id")


@query("flt17_counted_exclusions", """
SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN lang <> 'en' THEN 'foreign' END AS category, count(*) AS n FROM documents
GROUP BY 1 HAVING category IS NOT NULL""")
def flt17(spark, sf):
    return E.excluded_counts(table(spark, sf, "documents"), F.when(F.col("n_chars") < 500, F.lit("short")).when(F.col("lang") != "en", F.lit("foreign")))


@query("flt19_scope_grants", "SELECT event_id FROM events WHERE event_type IN (SELECT event_type FROM events WHERE user_id = 3)")
def flt19(spark, sf):
    events = table(spark, sf, "events")
    return E.within_grants(events, events.filter("user_id = 3"), "event_type").select("event_id")


@query("flt20_secret_rows", r"SELECT doc_id FROM documents WHERE regexp_matches(text, 'AKIA[A-Z0-9]{16}|token = .[0-9a-f]{40}')")
def flt20(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").rlike('AKIA[A-Z0-9]{16}|token = .[0-9a-f]{40}')).select("doc_id")


@query("flt21_null_preserving", "SELECT conv_id, turn, coalesce(nullif(trim(text), ''), nullif(role, '')) AS label FROM conversations")
def flt21(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", E.first_present(F.trim("text"), F.col("role")).alias("label"))


@query("lim01_keyset_page", "SELECT o_totalprice, o_orderkey FROM orders WHERE (o_totalprice, o_orderkey) > (200000.0, 100) ORDER BY o_totalprice, o_orderkey LIMIT 51")
def lim01(spark, sf):
    return S.page(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 50, (200000.0, 100))


@query("lim03_offset_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 21 OFFSET 40")
def lim03(spark, sf):
    return S.offset_page(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], 20, 40)


@query("lim04_byte_budget", """
SELECT item_id FROM (SELECT item_id, sum(strlen('{"item_id":' || item_id || '}')) OVER (ORDER BY item_id) AS total FROM benchmark) WHERE total <= 300""")
def lim04(spark, sf):
    return S.within_bytes(table(spark, sf, "benchmark").select("item_id").orderBy("item_id").limit(100), ["item_id"], 300)


@query("lim05_bounded_gaps", """
SELECT user_id, array_to_string(list_slice(list_sort(list(DISTINCT event_type)), 1, 2), ',') AS gaps, greatest(count(DISTINCT event_type) - 2, 0) AS omitted FROM events GROUP BY user_id""")
def lim05(spark, sf):
    sets = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("all"))
    return sets.select("user_id", F.array_join(F.slice("all", 1, 2), ",").alias("gaps"), F.greatest(F.size("all") - 2, F.lit(0)).cast("long").alias("omitted"))


@query("lim06_top_per_group", """
SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY l_orderkey) - 2, 0) AS omitted
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) QUALIFY row_number() OVER w <= 2""")
def lim06(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    top = S.top_per_group(rows, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey")], 2, with_omitted=True)
    return top.drop("l_partkey").withColumn("place", F.col("place").cast("long"))


@query("lim07_shortest_then_limit", """
WITH best AS (SELECT l_partkey, min(struct_pack(q := l_quantity, k := l_orderkey)) AS b FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, b.q AS steps, b.k AS path_id FROM best ORDER BY steps, path_id, l_partkey LIMIT 50""")
def lim07(spark, sf):
    best = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min(F.struct(F.col("l_quantity").alias("q"), F.col("l_orderkey").alias("k"))).alias("b"))
    return best.select("l_partkey", F.col("b.q").alias("steps"), F.col("b.k").alias("path_id")).orderBy("steps", "path_id", "l_partkey").limit(50)


@query("lim08_selection_size", "SELECT event_type, least(count(*), greatest(5, ceil(count(*) * 0.1)), 100)::BIGINT AS n FROM events GROUP BY event_type")
def lim08(spark, sf):
    from veridact.operators.ranking import effective_cap

    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("c"))
    return counts.select("event_type", F.least("c", effective_cap(F.col("c"), "0.1", 5, 100)).cast("long").alias("n"))


@query("lim10_complete_or_fail", "SELECT n_nationkey, n_name FROM nation")
def lim10(spark, sf):
    return E.refuse(table(spark, sf, "nation"), F.col("n_nationkey") > 1000, "too many nations").select("n_nationkey", "n_name")


@query("fts01_all_terms", r"""
SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['the', 'of', 'and'])""")
def fts01(spark, sf):
    return S.search(table(spark, sf, "documents"), "doc_id", F.col("text"), ["the", "of", "AND"])


@query("fts02_inverted_index", r"""
WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token,
                  generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), 1) - 1 AS pos FROM benchmark)
SELECT token, item_id, count(*) AS tf, min(pos) AS first_pos FROM t GROUP BY token, item_id""")
def fts02(spark, sf):
    return S.inverted_index(table(spark, sf, "benchmark"), "item_id", F.col("text")).withColumn("first_pos", F.col("first_pos").cast("long"))


@query("fts03_phrase", r"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ', ' of the ')")
def fts03(spark, sf):
    return S.phrase(table(spark, sf, "documents"), "doc_id", F.col("text"), ["of", "the"])


@query("fts04_join_back", r"""
SELECT c.conv_id, c.turn, c.role FROM conversations c WHERE list_has_all(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['the', 'in'])""")
def fts04(spark, sf):
    conv = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn", "role"))
    return S.search(conv, "key", F.col("text"), ["the", "in"]).select("key.*")


@query("fts05_probe_terms", r"""
WITH t AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos
           FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)),
f AS (SELECT token, min(struct_pack(d := doc_id, p := pos)) AS place FROM t GROUP BY token), g AS (SELECT * FROM f ORDER BY place LIMIT 5)
SELECT row_number() OVER (ORDER BY place) AS ordinal, token FROM g""")
def fts05(spark, sf):
    return S.probe_terms(table(spark, sf, "documents"), "doc_id", F.col("text")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("set01_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set01(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set02_fanout_first_wins", """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def set02(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return E.first_wins(rows, "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")


@query("set03_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set03(spark, sf):
    used = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("set04_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set04(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.filter("l_returnflag = 'R'").select("l_partkey").intersect(line.filter("l_returnflag = 'A'").select("l_partkey"))


@query("set05_classified_diff", """
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def set05(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias(n)) for s, n in (("F", "a"), ("O", "b")))
    state = F.when(F.col("a").isNull(), F.lit("added")).when(F.col("b").isNull(), F.lit("removed")).when(F.col("a") == F.col("b"), F.lit("same")).otherwise(F.lit("changed"))
    return a.join(b, "o_custkey", "full_outer").select("o_custkey", state.alias("state"))


@query("set06_probe_equality", """
(SELECT o_custkey AS key, 'left' AS side FROM orders EXCEPT SELECT c_custkey, 'left' FROM customer) UNION ALL
(SELECT c_custkey, 'right' FROM customer EXCEPT SELECT o_custkey, 'right' FROM orders)""")
def set06(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return E.probe_differences(a, table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).distinct())


@query("snk01_dedupe_identity", "SELECT count(*) AS n, count(DISTINCT md5(text)) AS n_texts FROM documents")
def snk01(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("identity"))
    first = E.first_wins(docs, "identity", [F.col("doc_id")])
    return first.agg(F.lit(docs.count()).cast("long").alias("n"), F.count("*").alias("n_texts"))


@query("snk10_verify_counts", "SELECT 'R' AS kind, count(*) AS actual, 7::BIGINT AS declared FROM lineitem WHERE l_returnflag = 'R' HAVING count(*) <> 7")
def snk10(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_returnflag").alias("kind"))
    return E.verify_counts(rows, spark.createDataFrame([("R", 7)], "kind string, n long"), "kind")
