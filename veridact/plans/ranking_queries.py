"""Percentiles, indices, tiers, selection and rolling windows over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridact.operators import aggregates as A
from veridact.operators import ranking as R
from veridact.plans.registry import query, table
from veridact.session import cut

WEIGHTS = {"relative_churn": 0.4, "revision_frequency": 0.25, "author_entropy": 0.2, "complexity": 0.15}

UNITS_SQL = """
u AS (SELECT o_custkey AS key, count(DISTINCT o_orderkey) AS change_count, sum(l_quantity)::BIGINT AS churn_lines, sum(l_quantity) / count(DISTINCT l_partkey) AS relative_churn, count(DISTINCT o_orderkey) / 30.0::DOUBLE AS revision_frequency
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
c AS (SELECT o_custkey AS key, l_suppkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
p AS (SELECT key, n / sum(n) OVER (PARTITION BY key) AS p FROM c), e AS (SELECT key, round(abs(sum(-p * log2(p))), 6) AS author_entropy FROM p GROUP BY 1)"""
INSTABILITY_SQL = f"""
WITH {UNITS_SQL}, m AS (SELECT u.*, author_entropy, ln(1 + relative_churn) AS a, ln(1 + revision_frequency) AS b FROM u JOIN e USING (key)),
s AS (SELECT *, CASE WHEN max(a) OVER () = min(a) OVER () THEN 0 ELSE (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) END AS na,
  CASE WHEN max(b) OVER () = min(b) OVER () THEN 0 ELSE (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) END AS nb,
  CASE WHEN max(author_entropy) OVER () = min(author_entropy) OVER () THEN 0 ELSE (author_entropy - min(author_entropy) OVER ()) / (max(author_entropy) OVER () - min(author_entropy) OVER ()) END AS nc FROM m),
r AS (SELECT *, round(100 * (0.4 * na + 0.25 * nb + 0.2 * nc) / 0.85, 4) AS score FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, churn_lines DESC, change_count DESC, key) AS rank, count(*) OVER () AS n FROM r)
SELECT key, change_count, churn_lines, score, 0.85::DOUBLE AS weight_coverage, 'complexity' AS missing_inputs, rank,
  CASE WHEN rank <= ceil(n * 0.05::DECIMAL(3,2)) THEN 'high' WHEN rank <= ceil(n * 0.20::DECIMAL(3,2)) THEN 'medium' ELSE 'low' END AS tier FROM k"""


def units(spark, sf):
    """Customers as units of change: orders are changes, parts files, suppliers authors; complexity isn't known."""
    lines = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key")).join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_quantity"), "o_orderkey")
    base = lines.groupBy("key").agg(F.count_distinct("o_orderkey").alias("change_count"), F.sum("l_quantity").cast("long").alias("churn_lines"), (F.sum("l_quantity") / F.count_distinct("l_partkey")).alias("relative_churn"))
    authors = A.entropy(lines.groupBy("key", "l_suppkey").agg(F.count("*").alias("n")), ["key"], "n", "author_entropy")
    return base.join(authors, "key").withColumns({"revision_frequency": F.col("change_count") / F.lit(30.0), "complexity": F.lit(None).cast("double")})


@query("win04_instability", INSTABILITY_SQL)
def win04(spark, sf):
    # the bounds, the ranges of the order and the result all read the units
    scored = R.instability(cut(units(spark, sf), "units"), WEIGHTS, ["relative_churn", "revision_frequency"])
    order = [F.col("score").desc(), F.col("churn_lines").desc(), F.col("change_count").desc(), F.col("key")]
    out = R.tiers(scored, order, [("high", "0.05"), ("medium", "0.15")], "low")
    return out.select("key", "change_count", "churn_lines", "score", "weight_coverage", F.array_join("missing_inputs", ",").alias("missing_inputs"), F.col("rank").cast("long").alias("rank"), "tier")


@query("win01_midrank", """
SELECT p_partkey, round(CASE WHEN p_size <= 0 THEN 0 ELSE ((rank() OVER (ORDER BY p_size) - 1) + 0.5 * count(*) OVER (PARTITION BY p_size)) / count(*) OVER () END, 6)::DOUBLE AS pct FROM part""")
def win01(spark, sf):
    return R.midrank(table(spark, sf, "part"), "p_size", "pct").select("p_partkey", F.col("pct").cast("double").alias("pct"))


@query("win02_weighted_percentiles", """
WITH p AS (SELECT p_partkey, p_brand, round(((rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1) + 0.5 * count(*) OVER (PARTITION BY p_brand, p_size)) / count(*) OVER (PARTITION BY p_brand), 6)::DOUBLE AS a,
  round(((rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1) + 0.5 * count(*) OVER (PARTITION BY p_brand, p_retailprice)) / count(*) OVER (PARTITION BY p_brand), 6)::DOUBLE AS b FROM part)
SELECT p_partkey, round((0.7 * a + CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 0.3 * b END) / CASE WHEN p_partkey % 4 = 0 THEN 0.7 ELSE 1.0 END, 7)::DOUBLE AS score, CASE WHEN p_partkey % 4 = 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS coverage FROM p""")
def win02(spark, sf):
    ranked = R.midrank(R.midrank(table(spark, sf, "part"), "p_size", "a", ["p_brand"]), "p_retailprice", "b0", ["p_brand"])
    mean, coverage, _ = R.weighted_available({"a": 0.7, "b": 0.3})
    return ranked.withColumn("b", F.when(F.col("p_partkey") % 4 != 0, F.col("b0"))).select("p_partkey", F.round(mean, 7).alias("score"), coverage.alias("coverage"))


@query("win03_position_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate, o_custkey, o_orderkey) AS rank FROM orders")
def win03(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderdate", "o_custkey", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rank"))


@query("win05_tiers", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER () AS n FROM customer)
SELECT c_custkey, rank, CASE WHEN rank <= ceil(n * 0.1::DECIMAL(2,1)) THEN 'top' WHEN rank <= ceil(n * 0.4::DECIMAL(2,1)) THEN 'mid' ELSE 'rest' END AS tier FROM r""")
def win05(spark, sf):
    out = R.tiers(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], [("top", "0.1"), ("mid", "0.3")], "rest")
    return out.select("c_custkey", F.col("rank").cast("long").alias("rank"), "tier")


@query("win06_proportional", """
WITH m AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
t AS (SELECT *, CASE WHEN k <= 2 THEN 1 WHEN k <= ceil(n * 0.05::DECIMAL(3,2)) THEN 2 ELSE 3 END AS turn FROM m)
SELECT c_custkey, turn FROM t ORDER BY turn, c_acctbal DESC, c_custkey LIMIT 120""")
def win06(spark, sf):
    out = R.proportional(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", [F.col("c_acctbal").desc(), F.col("c_custkey")], 2, "0.05", 120)
    return out.select("c_custkey", "turn")


@query("win07_effective_cap", "SELECT event_type, least(greatest(20, ceil(0.02::DECIMAL(3,2) * count(*))), 300)::BIGINT AS cap FROM events GROUP BY 1")
def win07(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", R.effective_cap(F.col("n"), "0.02", 20, 300).cast("long").alias("cap"))


@query("win08_max_normalised", """
WITH s AS (SELECT user_id, count(*)::DOUBLE AS a, max(value) AS b, CASE WHEN user_id % 5 = 0 THEN NULL ELSE sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::DOUBLE END AS c FROM events GROUP BY 1),
m AS (SELECT user_id, a / max(a) OVER () AS a, b / max(b) OVER () AS b, c / max(c) OVER () AS c FROM s)
SELECT user_id, round((0.5 * a + 0.3 * b + coalesce(0.2 * c, 0)) / (0.8 + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 6)::DOUBLE AS score, (0.8 + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END)::DOUBLE AS coverage FROM m""")
def win08(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("a"), F.max("value").alias("b"), F.count_if(F.col("event_type") == "error").cast("double").alias("c0"))
    out = R.max_normalised(s.withColumn("c", F.when(F.col("user_id") % 5 != 0, F.col("c0"))), {"a": 0.5, "b": 0.3, "c": 0.2})
    return out.select("user_id", "score", "coverage")


@query("win09_rolling_peak", """
WITH w AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL '604799999999 microseconds' FOLLOWING) AS n FROM events WHERE event_type = 'error')
SELECT user_id, max(n) AS peak, min(ts) FILTER (n = m) AS peak_start FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM w) GROUP BY 1""")
def win09(spark, sf):
    return R.rolling_peak(table(spark, sf, "events").filter("event_type = 'error'"), "user_id", "ts", 7)


@query("win10_repeats", """
WITH d AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE event_type = 'error') SELECT user_id, count(*) FILTER (ts <= before + INTERVAL 2 DAYS) AS repeats FROM d GROUP BY 1""")
def win10(spark, sf):
    return R.repeats_within(table(spark, sf, "events").filter("event_type = 'error'"), ["user_id"], "ts", 2)


@query("win11_running_clamp", """
SELECT event_id, min(ts) OVER w AS effective, ts > min(ts) OVER w AS clamped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)""")
def win11(spark, sf):
    rows = table(spark, sf, "events").withColumn("position", -F.col("event_id"))
    return R.running_clamp(rows, ["user_id"], "position", "ts").select("event_id", "effective", "clamped")


@query("win12_first_ordinal", "SELECT user_id, row_number() OVER (ORDER BY min(event_id), user_id) AS ordinal FROM events GROUP BY 1")
def win12(spark, sf):
    return R.first_ordinal(table(spark, sf, "events"), "user_id", "event_id").withColumn("ordinal", F.col("ordinal").cast("long"))


@query("win14_recent", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3")
def win14(spark, sf):
    from veridact.operators.search import top_per_group

    return top_per_group(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id")], 3).select("user_id", "event_id")


@query("win15_bus_factor", """
WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_partkey, q / sum(q) OVER (PARTITION BY l_partkey) AS own, sum(q) OVER o / sum(q) OVER (PARTITION BY l_partkey) AS reached, row_number() OVER o AS place FROM s
  WINDOW o AS (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey ROWS UNBOUNDED PRECEDING))
SELECT l_partkey, round(max(own), 6) AS top_share, min(place) FILTER (reached >= 0.5) AS bus_factor FROM r GROUP BY 1""")
def win15(spark, sf):
    shares = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return R.bus_factor(shares, ["l_partkey"], "l_suppkey", "q", 0.5).withColumn("bus_factor", F.col("bus_factor").cast("long"))
