"""Classification, projection and planning over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridact.operators import graph as G
from veridact.operators import lifecycle as L
from veridact.operators.search import top_per_group
from veridact.plans.registry import packed_sql, query, table


@query("dom01_observation_class", "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.class'), ''), CASE event_type WHEN 'error' THEN 'fault' WHEN 'view' THEN 'usage' END, 'other') AS class FROM events")
def dom01(spark, sf):
    kinds = F.create_map(F.lit("error"), F.lit("fault"), F.lit("view"), F.lit("usage"))
    found = F.coalesce(F.nullif(F.get_json_object("props", "$.class"), F.lit("")), kinds[F.col("event_type")], F.lit("other"))
    return table(spark, sf, "events").select("event_id", found.alias("class"))


@query("dom05_token_classes", r"""
WITH t AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark)
SELECT item_id, pos::INT AS pos, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'capital' WHEN regexp_matches(w, '[.,]$') THEN 'ending' ELSE 'word' END AS class FROM t""")
def dom05(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    return words.select("item_id", "pos", L.first_true([(F.col("w").rlike("^[A-Z]"), "capital"), (F.col("w").rlike("[.,]$"), "ending")], "word").alias("class"))


@query("dom10_context_by_file", "SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1")
def dom10(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("s"))
    return g.select("l_partkey", F.array_join("s", ",").alias("suppliers"))


@query("dom12_wildcard_rules", """
SELECT e.event_id, r.verdict FROM events e JOIN (VALUES ('error', 1, 'exact', 0), ('error', NULL, 'family', 1), (NULL, 1, 'producer', 2)) r(t, p, verdict, rank) ON (r.t IS NULL OR r.t = e.event_type) AND (r.p IS NULL OR r.p = e.user_id % 3)
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY r.rank) = 1""")
def dom12(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("t"), (F.col("user_id") % 3).alias("p"))
    exact = spark.createDataFrame([("error", 1, 0, "exact")], "t string, p long, position int, rule string")
    family = spark.createDataFrame([("error", 0, "family")], "t string, position int, rule string")
    producer = spark.createDataFrame([(1, 0, "producer")], "p long, position int, rule string")
    found = G.first_rule(events, ["event_id"], [(exact, ["t", "p"]), (family, ["t"]), (producer, ["p"])])
    return found.filter("rule IS NOT NULL").select("event_id", F.col("rule").alias("verdict"))


@query("dom17_reviewed_units", "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS reviewed, count(*) AS units FROM orders GROUP BY 1")
def dom17(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("reviewed"), F.count("*").alias("units"))


@query("dom18_removal_stage", "SELECT event_id, CASE WHEN value < 5 THEN 'filter' WHEN event_type = 'view' THEN 'triage' WHEN user_id % 2 = 0 THEN 'review' ELSE 'kept' END AS stage FROM events")
def dom18(spark, sf):
    rows = [(F.col("value") < 5, "filter"), (F.col("event_type") == "view", "triage"), (F.col("user_id") % 2 == 0, "review")]
    return table(spark, sf, "events").select("event_id", L.first_true(rows, "kept").alias("stage"))


@query("dom19_entry_coverage", "SELECT n_name, count(c_custkey) FILTER (c_acctbal > 0) AS covered, count(c_custkey) AS total FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def dom19(spark, sf):
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("c_acctbal") > 0).alias("c"), F.count("*").alias("t"))
    return table(spark, sf, "nation").join(per, "n_nationkey", "left").select("n_name", F.coalesce("c", F.lit(0)).alias("covered"), F.coalesce("t", F.lit(0)).alias("total"))


@query("dom24_partial_coverage", "SELECT source, CASE WHEN count(l.doc_id) < count(*) THEN NULL ELSE sum(toxic) END::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def dom24(spark, sf):
    from veridact.operators.aggregates import strict_sum

    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(strict_sum(F.col("toxic")).alias("toxic"))


@query("dom30_promotion", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'promote' WHEN l_returnflag = 'R' THEN 'watch' ELSE 'drop' END AS class FROM lineitem")
def dom30(spark, sf):
    r = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", L.first_true([(r & (F.col("l_discount") > 0.05), "promote"), (r, "watch")], "drop").alias("class"))


@query("dom34_request_batches", packed_sql("SELECT conv_id, turn, length(text)::BIGINT AS size FROM conversations", "conv_id, turn, size", "conv_id", "turn", "size", 1000, 4000))
def dom34(spark, sf):
    """Conversation turns in requests of at most 4,000 characters."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return G.packed(turns, "conv_id", ["turn"], "size", 1000, 4000)


@query("dom37_resume_plan", """
SELECT a.user_id, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h = b.h THEN 'reuse' ELSE 'rerun' END AS plan FROM (SELECT user_id, md5(string_agg(DISTINCT event_type, ',' ORDER BY event_type)) AS h FROM events GROUP BY 1) a
LEFT JOIN (SELECT user_id, md5(string_agg(DISTINCT event_type, ',' ORDER BY event_type)) AS h FROM events WHERE ts < TIMESTAMP '2024-01-05' GROUP BY 1) b USING (user_id)""")
def dom37(spark, sf):
    events = table(spark, sf, "events")

    def digests(df, name):
        return df.groupBy("user_id").agg(F.md5(F.array_join(F.array_sort(F.collect_set("event_type")), ",").cast("binary")).alias(name))

    both = digests(events, "now").join(digests(events.filter("ts < TIMESTAMP_NTZ '2024-01-05'"), "before"), "user_id", "left")
    return both.select("user_id", L.first_true([(F.col("before").isNull(), "new"), (F.col("before") == F.col("now"), "reuse")], "rerun").alias("plan"))


@query("dom39_reconcile", "SELECT coalesce(c.k, s.k) AS nation, CASE WHEN s.k IS NULL THEN 'unproduced' WHEN c.k IS NULL THEN 'unregistered' ELSE 'ok' END AS state FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 20) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON c.k = s.k")
def dom39(spark, sf):
    c = table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_nationkey").alias("nation"), F.lit(True).alias("c")).distinct()
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(True).alias("s")).distinct()
    return c.join(s, "nation", "full_outer").select("nation", L.first_true([(F.col("s").isNull(), "unproduced"), (F.col("c").isNull(), "unregistered")], "ok").alias("state"))


@query("dom41_posture", "SELECT c_mktsegment, CASE WHEN avg(c_acctbal) > 4500 THEN 'strong' WHEN avg(c_acctbal) > 4000 THEN 'fair' ELSE 'weak' END AS posture, count(*) AS n FROM customer GROUP BY 1")
def dom41(spark, sf):
    g = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("a"), F.count("*").alias("n"))
    return g.select("c_mktsegment", L.first_true([(F.col("a") > 4500, "strong"), (F.col("a") > 4000, "fair")], "weak").alias("posture"), "n")


@query("dom43_differential", "SELECT event_type, count(*) FILTER (value > 50 AND user_id % 3 = 0) AS both_hit, count(*) FILTER (value > 50 AND user_id % 3 <> 0) AS first_only, count(*) FILTER (value <= 50 AND user_id % 3 = 0) AS second_only FROM events GROUP BY 1")
def dom43(spark, sf):
    a, b = F.col("value") > 50, F.col("user_id") % 3 == 0
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(a & b).alias("both_hit"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"))


@query("dom48_summaries", "SELECT event_id, CASE event_type WHEN 'error' THEN 'user ' || user_id || ' failed' ELSE event_type || ' by ' || user_id END AS summary FROM events")
def dom48(spark, sf):
    failed = F.format_string("user %d failed", "user_id")
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", failed).otherwise(F.format_string("%s by %d", "event_type", "user_id")).alias("summary"))


@query("dom49_related", "SELECT o_orderkey, unnest(['customer:' || o_custkey, 'status:' || o_orderstatus]) AS related FROM orders")
def dom49(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.concat(F.lit("customer:"), "o_custkey"), F.concat(F.lit("status:"), "o_orderstatus"))).alias("related"))


@query("gr08_backward_closure", """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey + p_size AS dst FROM part), w(node) AS (SELECT 150::BIGINT UNION SELECT src FROM w JOIN e ON node = dst) SELECT node FROM w""")
def gr08(spark, sf):
    back = table(spark, sf, "part").select((F.col("p_partkey") + F.col("p_size")).alias("src"), F.col("p_partkey").alias("dst"))
    return G.neighbourhood(back, spark.createDataFrame([(150,)], "node long"), 64).select("node")


@query("chg07_departed_owner", """
WITH s AS (SELECT user_id % 20 AS unit, user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1, 2)
SELECT unit, user_id AS owner, last < TIMESTAMP '2024-01-29' AS departed FROM s QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, user_id) = 1""")
def chg07(spark, sf):
    s = table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("unit"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    top = top_per_group(s, ["unit"], [F.col("n").desc(), F.col("user_id")], 1)
    return top.select("unit", F.col("user_id").alias("owner"), (F.col("last") < F.expr("TIMESTAMP_NTZ '2024-01-29'")).alias("departed"))


@query("lif07_fix_on_fix", """
WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d FROM orders)
SELECT a.o_orderkey AS earlier, b.o_orderkey AS later FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.d - a.d BETWEEN 0 AND 14 AND (b.d > a.d OR b.o_orderkey > a.o_orderkey)""")
def lif07(spark, sf):
    from veridact.operators.joins import overlap_join

    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("d"))
    a = o.select("o_custkey", F.col("o_orderkey").alias("earlier"), F.col("d").alias("s"), (F.col("d") + 14).alias("e"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("later"), F.col("d").alias("u"), F.col("d").alias("v"))
    met = overlap_join(a, b, ["o_custkey"], ("s", "e"), ("u", "v"), width=32)
    return met.filter("u > s OR later > earlier").select("earlier", "later")


@query("win18_personas", "SELECT p_brand, p_type FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) <= 2")
def win18(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["p_brand"], [F.col("n").desc(), F.col("p_type")], 2).select("p_brand", "p_type")


@query("str02_contiguity", "WITH s AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS missing FROM events) SELECT user_id, count(*) FILTER (missing > 0) AS gaps FROM s GROUP BY 1")
def str02(spark, sf):
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf, "events").select("user_id", gap.alias("missing")).groupBy("user_id").agg(F.count_if(F.col("missing") > 0).alias("gaps"))
