"""Aggregations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import aggregates as A
from veridact.operators import joins as J
from veridact.plans.registry import query, table

TYPES = ["click", "error", "purchase", "signup", "view", "retired"]


@query("agg01_history", """
SELECT o_custkey, count(*) AS changes, count(DISTINCT o_orderpriority) AS authors, round(sum(o_totalprice * pow(0.5, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') / 365.0)), 2) AS decayed,
  count(*) FILTER (o_orderstatus = 'F') AS fixes FROM orders GROUP BY o_custkey""")
def agg01(spark, sf):
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("changes"), F.count_distinct("o_orderpriority").alias("authors"),
        F.round(A.decayed(F.col("o_totalprice"), age, 365.0), 2).alias("decayed"), F.count_if(F.col("o_orderstatus") == "F").alias("fixes"))


@query("agg02_distinct_changes", """
SELECT l_suppkey, count(DISTINCT l_orderkey) AS changes, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS reverted FROM lineitem GROUP BY 1""")
def agg02(spark, sf):
    # one pair per change first, so that a distinct count needs no expansion of rows
    pairs = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("changes"), F.count_if("r").alias("reverted"))


@query("agg03_author_shares", """
WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, round(max(n) / sum(n), 6) AS top_share, count(*) FILTER (n = 1) AS minor FROM c GROUP BY 1""")
def agg03(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return c.groupBy("l_partkey").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), F.count_if(F.col("n") == 1).alias("minor"))


@query("agg04_entropy", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(abs(sum(-p * log2(p))), 6) AS entropy FROM p GROUP BY 1""")
def agg04(spark, sf):
    return A.entropy(table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "n")


@query("agg05_normalised_entropy", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
e AS (SELECT user_id, round(abs(sum(-p * log2(p))), 6) AS b, count(*) AS k FROM p GROUP BY 1)
SELECT user_id, round(CASE WHEN k <= 1 THEN 0 ELSE b / log2(k) END, 5) AS normalised FROM e""")
def agg05(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    bits = A.entropy(counts, ["user_id"], "n").join(counts.groupBy("user_id").agg(F.count("*").alias("k")), "user_id")
    return bits.select("user_id", F.round(A.normalised_entropy(F.col("entropy"), F.col("k")), 5).alias("normalised"))


@query("agg06_median_interval", """
WITH d AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, median(gap)::DOUBLE AS median_gap FROM d GROUP BY 1""")
def agg06(spark, sf):
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = table(spark, sf, "events").select("user_id", (at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap"))
    return gaps.groupBy("user_id").agg(F.median("gap").alias("median_gap"))


@query("agg08_closed_counts", """
SELECT v AS value, count(e.event_type) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('retired'), ('null')) t(v) LEFT JOIN events e ON e.event_type = t.v GROUP BY 1""")
def agg08(spark, sf):
    return A.closed_counts(table(spark, sf, "events"), "event_type", TYPES)


@query("agg09_ratio_status", """
SELECT lang, CASE WHEN count(quality) = 0 THEN 'empty_denominator' ELSE 'measured' END AS status, round(sum(quality) / nullif(count(quality), 0), 6) AS value
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def agg09(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    r = labelled.groupBy("lang").agg(F.coalesce(F.sum("quality"), F.lit(0)).alias("k"), F.count("quality").alias("n")).withColumn("r", A.ratio(F.col("k"), F.col("n")))
    return r.select("lang", "r.status", F.round("r.value", 6).alias("value"))


@query("agg10_wilson", """
WITH c AS (SELECT source, sum(toxic) AS k, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, round(greatest(0, ((k / n + z * z / (2 * n)) / (1 + z * z / n)) - z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 8) AS low,
  round(least(1, ((k / n + z * z / (2 * n)) / (1 + z * z / n)) + z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 8) AS high FROM c""")
def agg10(spark, sf):
    c = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    return c.withColumn("w", A.wilson(F.col("k"), F.col("n"))).select("source", F.round("w.low", 8).alias("low"), F.round("w.high", 8).alias("high"))


@query("agg11_histogram", """
SELECT le, n FROM (SELECT count(*) FILTER (value <= 10) AS a, count(*) FILTER (value <= 50) AS b, count(value) AS c, count(*) FILTER (value IS NULL) AS d FROM events),
LATERAL (VALUES ('10', a), ('50', b), ('+Inf', c), ('unmeasured', d)) t(le, n)""")
def agg11(spark, sf):
    return A.cumulative_histogram(table(spark, sf, "events"), F.col("value"), [10, 50])


@query("agg12_strict_rollup", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CASE WHEN count(p) < count(*) THEN NULL ELSE round(sum(p), 2) END AS total
FROM (SELECT *, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderstatus, o_orderpriority))""")
def agg12(spark, sf):
    price = F.when(~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 97 == 0)), F.col("o_totalprice"))
    rows = table(spark, sf, "orders").withColumn("p", price)
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return rows.groupingSets([[], [status], [status, priority]], status, priority).agg(F.count("*").alias("n"), F.round(A.strict_sum(F.col("p")), 2).alias("total"))


@query("agg13_equal_shares", """
WITH f AS (SELECT o_orderkey, o_totalprice, list(DISTINCT l_suppkey) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT member, round(sum(share), 2) AS share FROM (SELECT unnest(s) AS member, o_totalprice / len(s) AS share FROM f) GROUP BY 1""")
def agg13(spark, sf):
    members = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("s"))
    shares = A.equal_shares(table(spark, sf, "orders").join(members, "o_orderkey"), "o_totalprice", "s")
    return shares.select("member", F.round("share", 2).alias("share"))


@query("agg15_miss_rate", """
SELECT lang, count(*) AS audited, count(*) FILTER (toxic = 1) AS missed, round(count(*) FILTER (toxic = 1) / count(*), 6) AS miss_rate FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1""")
def agg15(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").filter("quality = 1")
    return rows.groupBy("lang").agg(F.count("*").alias("audited"), F.count_if(F.col("toxic") == 1).alias("missed")).withColumn("miss_rate", F.round(F.col("missed") / F.col("audited"), 6))


@query("agg16_precision_at_budget", """
WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents JOIN labels USING (doc_id))
SELECT source, round(avg(quality), 6) AS precision, round(avg(quality) FILTER (place <= 10), 6) AS at_10 FROM r GROUP BY 1""")
def agg16(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id").withColumn("place", place)
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("precision"), F.round(F.avg(F.when(F.col("place") <= 10, F.col("quality"))), 6).alias("at_10"))


@query("agg18_slices", """
SELECT v AS slice, count(doc_id) AS n, round(avg(n_chars), 4) AS mean_chars FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) t(v) LEFT JOIN documents d ON d.lang = t.v GROUP BY 1""")
def agg18(spark, sf):
    slices = spark.createDataFrame([(v,) for v in ("en", "fr", "de", "es", "it")], "slice string")
    per = table(spark, sf, "documents").groupBy(F.col("lang").alias("slice")).agg(F.count("*").alias("c"), F.avg("n_chars").alias("m"))
    return slices.join(per, "slice", "left").select("slice", F.coalesce("c", F.lit(0)).alias("n"), F.round("m", 4).alias("mean_chars"))


@query("agg20_bucket_merge", """
SELECT user_id, event_type, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, min_by(event_id, struct_pack(h := md5(event_id::VARCHAR))) AS first_report FROM events GROUP BY 1, 2""")
def agg20(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("event_id", F.md5(F.col("event_id").cast("string").cast("binary"))).alias("first_report"))


@query("agg22_casefold_dedupe", "SELECT lower(n_name) AS key, min(n_nationkey) AS first_key, count(*) AS n FROM nation GROUP BY 1 ORDER BY 1 LIMIT 10")
def agg22(spark, sf):
    return table(spark, sf, "nation").groupBy(F.lower("n_name").alias("key")).agg(F.min("n_nationkey").alias("first_key"), F.count("*").alias("n")).orderBy("key").limit(10)


@query("agg26_menu", """
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY lang) AS total FROM documents)
SELECT lang, (n - 1) // 100 AS part, string_agg(doc_id::VARCHAR, ',' ORDER BY n) AS members, CASE WHEN (n - 1) // 100 < (max(total) - 1) // 100 THEN (n - 1) // 100 + 1 END AS next_part FROM r GROUP BY lang, (n - 1) // 100""")
def agg26(spark, sf):
    menus = A.chunked(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], "doc_id", 100)
    return menus.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("agg27_worst_state", """
SELECT user_id, (['view', 'click', 'error'])[max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 0 END)] AS state FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1""")
def agg27(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type").isin("view", "click", "error")).groupBy("user_id").agg(A.worst_state(F.col("event_type"), ["view", "click", "error"]).alias("state"))


@query("agg28_state_by_rank", "SELECT o_custkey, min_by(o_orderstatus, struct_pack(r := CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)) AS state FROM orders GROUP BY 1")
def agg28(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", rank).alias("state"))


@query("agg31_matrix", """
SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY 1""")
def agg31(spark, sf):
    rows = table(spark, sf, "documents").filter(F.col("lang").isin("en", "fr", "de"))
    return rows.groupBy("source").pivot("lang", ["en", "fr", "de"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg32_rule_counts", "SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_returnflag = 'R' GROUP BY 1")
def agg32(spark, sf):
    hits = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("c"))
    return table(spark, sf, "part").select("p_partkey").join(hits, "p_partkey", "left").select("p_partkey", F.coalesce("c", F.lit(0)).alias("n"))


@query("agg34_ages", """
WITH a AS (SELECT user_id, count(DISTINCT ts::DATE) AS age, CASE WHEN user_id % 11 = 0 THEN NULL ELSE count(DISTINCT ts::DATE) END AS known FROM events GROUP BY 1)
SELECT user_id % 10 AS bucket, CASE WHEN count(known) < count(*) THEN NULL ELSE median(known) END::DOUBLE AS median_age FROM a GROUP BY 1""")
def agg34(spark, sf):
    days = table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct(F.col("ts").cast("date")).alias("age"))
    known = days.withColumn("known", F.when(F.col("user_id") % 11 != 0, F.col("age")))
    return known.groupBy((F.col("user_id") % 10).alias("bucket")).agg(A.strict_median(F.col("known")).alias("median_age"))


@query("agg35_profile_rows", "SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2, 3")
def agg35(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("count"))


@query("agg37_exact_accounting", """
WITH b AS (SELECT c_custkey, (c_acctbal < 0)::INT + (c_acctbal BETWEEN 0 AND 5000)::INT + (c_acctbal >= 5000)::INT + (c_custkey % 500 = 0)::INT AS n FROM customer) SELECT c_custkey, n::BIGINT AS buckets FROM b WHERE n <> 1""")
def agg37(spark, sf):
    from veridact.operators.lifecycle import exactly_one

    bal = F.col("c_acctbal")
    found = exactly_one(table(spark, sf, "customer"), "c_custkey", [("debt", bal < 0), ("middle", bal.between(0, 5000)), ("rich", bal >= 5000), ("audit", F.col("c_custkey") % 500 == 0)])
    return found.select("c_custkey", F.size("buckets").cast("long").alias("buckets"))


@query("agg38_first_wins", "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def agg38(spark, sf):
    from veridact.operators.evidence import first_wins

    return first_wins(table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), "source", [-F.col("n_chars"), F.col("doc_id")]).drop("n_chars")


@query("agg39_conflicting_keys", """
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, count(*) AS rows FROM lineitem GROUP BY 1""")
def agg39(spark, sf):
    return A.agreeing(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("q1_pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def q1(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"))
