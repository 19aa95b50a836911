"""Further walks, budgets, versions, signals and exports over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import graph as G
from veridact.operators import lifecycle as L
from veridact.operators import ranking as R
from veridact.operators import replay
from veridact.operators import versions as V
from veridact.operators.search import folded_tokens, tokens
from veridact.plans.registry import packed_sql, query, table, walk_sql
from veridact.sources import documents

CALLS_SQL = "e AS (SELECT DISTINCT o_custkey AS src, l_suppkey + 1000000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT l_suppkey + 1000000000, l_partkey + 2000000000 FROM lineitem WHERE l_returnflag = 'R')"


def _calls(spark, sf):
    """Customers to their suppliers, suppliers to the parts that came back from them."""
    line = table(spark, sf, "lineitem")
    supplier = F.col("l_suppkey") + 1_000_000_000
    bought = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(line, "l_orderkey").select(F.col("o_custkey").alias("src"), supplier.alias("dst"))
    return bought.union(line.filter("l_returnflag = 'R'").select(supplier, F.col("l_partkey") + 2_000_000_000)).distinct()


@query("src25_clang_cfg", "SELECT 'f' || n_nationkey AS function, '2' AS src, '1' AS dst FROM nation UNION ALL SELECT 'f' || n_nationkey, '1', '0' FROM nation")
def src25(spark, sf):
    text = F.concat(F.lit("int f"), "n_nationkey", F.lit("(int x)\n [B2 (ENTRY)]\n   Succs (1): B1\n [B1]\n   1: x\n   Succs (2): B0 B3(Unreachable)\n [B0 (EXIT)]\n   Preds (1): B1\n"))
    return documents.clang_cfg(table(spark, sf, "nation").select(text.alias("value")))


@query("src26_clangd_symbols", "SELECT 's' || n_nationkey AS id, n_name AS name, 'Function' AS kind, n_regionkey::INT AS line FROM nation")
def src26(spark, sf):
    text = F.concat(F.lit("--- !Symbol\nID: s"), "n_nationkey", F.lit("\nName: '"), "n_name", F.lit("'\nKind: Function\nLine: "), "n_regionkey", F.lit("\n--- !Refs\nID: x\n"))
    return documents.clangd_symbols(table(spark, sf, "nation").select(text.alias("value"))).select("id", "name", "kind", "line")


@query("src28_dwarf_functions", "SELECT n_name AS name, (4096 + n_nationkey * 16)::BIGINT AS low, (4096 + n_nationkey * 16 + 8)::BIGINT AS high FROM nation")
def src28(spark, sf):
    low = F.lower(F.hex(F.col("n_nationkey").cast("long") * 16 + 4096))
    text = F.concat(F.lit('0x0000000b: DW_TAG_subprogram\n  DW_AT_name ("'), "n_name", F.lit('")\n  DW_AT_low_pc (0x'), low, F.lit(")\n  DW_AT_high_pc (0x8)\n0x0000000c: DW_TAG_variable\n"))
    found = documents.dwarf_functions(table(spark, sf, "nation").select(text.alias("value")))
    return found.select("name", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@query("src33_query_export", "SELECT 'q' || n_regionkey AS query_id, n_name AS cell FROM nation")
def src33(spark, sf):
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.array("n_name")).alias("rows"))
    doc = F.to_json(F.struct(F.concat(F.lit("q"), "n_regionkey").alias("query_id"), "rows", F.size("rows").alias("row_count"), F.lit(False).alias("truncated")))
    return documents.exported_rows(rows.select(doc.alias("value"))).select("query_id", F.get("row", 0).alias("cell"))


@query("snk02_search_documents", "SELECT item_id AS identity, strlen(text)::BIGINT AS bytes FROM benchmark ORDER BY item_id")
def snk02(spark, sf):
    from veridact.operators.evidence import refuse

    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("identity"), F.octet_length("text").cast("long").alias("bytes"))
    return refuse(rows, F.col("bytes") > 1_000_000, "document too large").orderBy("identity")


@query("snk04_probe_validation", "SELECT 0::BIGINT AS differences")
def snk04(spark, sf):
    from veridact.operators import evidence as E
    from veridact.operators import search as S

    docs = table(spark, sf, "documents")
    by_row = S.search(docs, "doc_id", F.col("text"), ["the", "of"])
    index = S.inverted_index(docs, "doc_id", F.col("text")).filter(F.col("token").isin("the", "of")).groupBy("doc_id").agg(F.count_distinct("token").alias("n"))
    return E.probe_differences(by_row, index.filter("n = 2").select("doc_id")).agg(F.count("*").alias("differences"))


@query("snk08_json_cells", "SELECT n_nationkey, '\"' || n_name || '\"' AS cell FROM nation")
def snk08(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.regexp_extract(F.to_json(F.struct(F.col("n_name").alias("v"))), r'^\{"v":(.*)\}$', 1).alias("cell"))


@query("snk09_shard_batches", packed_sql("SELECT o_orderstatus, o_orderkey, n AS rows FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", "o_orderkey, o_orderstatus, rows", "o_orderstatus", "o_orderkey", "rows", 500, 3000))
def snk09(spark, sf):
    """Orders of each status in shards of at most 500 orders and 3,000 lines."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("rows"))
    return G.packed(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey").join(lines, "o_orderkey"), "o_orderstatus", ["o_orderkey"], "rows", 500, 3000)


@query("flt10_domain_facets", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size BETWEEN 5 AND 15 OR p_brand = 'Brand#11' AND p_size > 45")
def flt10(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").filter(((F.col("p_type") == "PROMO") & size.between(5, 15)) | ((F.col("p_brand") == "Brand#11") & (size > 45))).select("p_partkey")


@query("flt15_wildcards", "SELECT p_partkey FROM part WHERE p_name LIKE 'r%b_lt'")
def flt15(spark, sf):
    from veridact.functions.paths import glob_regex

    return table(spark, sf, "part").filter(F.col("p_name").rlike(glob_regex("r*b?lt"))).select("p_partkey")


@query("fts02b_folded_tokens", r"""
WITH t AS (SELECT lang, unnest(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '\p{M}+', '', 'g')), '[^\p{L}\p{N}]+')) AS token FROM documents)
SELECT lang, count(*) AS n, count(DISTINCT token) AS n_distinct FROM t WHERE token <> '' GROUP BY 1""")
def fts02b(spark, sf):
    """Tokens of any script, by language."""
    t = table(spark, sf, "documents").select("lang", F.explode(folded_tokens(F.col("text"))).alias("token"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_distinct"))


@query("jn16_version_in_range", "SELECT p.p_partkey, n.n_nationkey AS advisory FROM part p JOIN nation n ON p.p_partkey % 25 = n.n_nationkey AND p.p_size >= n.n_nationkey AND p.p_size < n.n_nationkey + 10")
def jn16(spark, sf):
    packages = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 25).alias("name"), F.concat("p_size", F.lit(".0.0")).alias("version"))
    bound = lambda k, c: F.struct(F.lit(k).alias("kind"), F.concat(c, F.lit(".0.0")).alias("version"))
    key = F.col("n_nationkey").cast("long")
    advisories = table(spark, sf, "nation").select(key.alias("name"), F.col("n_nationkey").alias("advisory"), F.array(bound("introduced", key), bound("fixed", key + 10)).alias("events"))
    return packages.join(advisories, "name").filter(V.in_range(F.col("version"), F.col("events"))).select("p_partkey", "advisory")


@query("ver03_entry_evaluation", "SELECT p_partkey, p_size IN (3, 9) OR p_size >= 45 AS affected FROM part")
def ver03(spark, sf):
    events = F.array(F.struct(F.lit("introduced").alias("kind"), F.lit("45.0.0").alias("version")))
    listed = F.concat("p_size", F.lit(".0.0")).isin("3.0.0", "9.0.0")
    return table(spark, sf, "part").select("p_partkey", (listed | V.in_range(F.concat("p_size", F.lit(".0.0")), events)).alias("affected"))


@query("agg33_distances", f"""
WITH RECURSIVE {CALLS_SQL}, w(node, d) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, d + 1 FROM w JOIN e ON node = src WHERE d < 3), m AS (SELECT node, min(d) AS d FROM w GROUP BY 1) SELECT d::INT AS distance, count(*) AS n FROM m GROUP BY 1""")
def agg33(spark, sf):
    return G.neighbourhood(_calls(spark, sf), spark.createDataFrame([(1,)], "node long"), 3).groupBy("distance").agg(F.count("*").alias("n"))


@query("gr04_near", f"WITH RECURSIVE {CALLS_SQL}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, d) AS (SELECT 1000000007::BIGINT, 0 UNION SELECT dst, d + 1 FROM w JOIN b ON node = src WHERE d < 2) SELECT node, min(d)::INT AS distance FROM w GROUP BY 1")
def gr04(spark, sf):
    return G.neighbourhood(G.both_ways(_calls(spark, sf)), spark.createDataFrame([(1_000_000_007,)], "node long"), 2).select("node", "distance")


@query("gr06_post_dominators", "SELECT n_name AS graph, t.node, t.idom FROM nation, (VALUES ('d', NULL), ('b', 'd'), ('c', 'd'), ('a', 'd')) t(node, idom)")
def gr06(spark, sf):
    """Immediate post-dominators of a diamond for each nation."""
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))])
    edges = table(spark, sf, "nation").select(F.col("n_name").alias("graph"), F.lit("a").alias("entry"), F.inline(pairs))
    return G.dominators(edges, "graph", "entry", post=True)


@query("gr07_guard_chain", "SELECT n_name AS graph, 'e' AS node, d AS dominator, s::INT AS steps FROM nation, (VALUES ('d', 1), ('a', 2)) t(d, s)")
def gr07(spark, sf):
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"))])
    edges = table(spark, sf, "nation").select(F.col("n_name").alias("graph"), F.lit("a").alias("entry"), F.inline(pairs))
    seeds = edges.select("graph", F.lit("e").alias("node")).distinct()
    return G.dominator_chain(G.dominators(edges, "graph", "entry"), seeds, 8)


@query("gr09_bounded_slice", walk_sql(CALLS_SQL, "(3, 0), (1000000009, 0)", 5, 25))
def gr09(spark, sf):
    """A slice of at most 25 nodes in both directions."""
    return G.neighbourhood(G.both_ways(_calls(spark, sf)), spark.createDataFrame([(3,), (1_000_000_009,)], "node long"), 5, limit=25)


@query("gr11_chains", """
WITH RECURSIVE e AS (SELECT p_brand AS src, p_type AS dst FROM part UNION SELECT p_type, 's' || p_size FROM part), s AS (SELECT src AS step, length(src) / 10.0 AS sev FROM e UNION SELECT dst, length(dst) / 10.0 FROM e),
w(chain, worst) AS (SELECT [step], sev FROM s UNION ALL SELECT list_append(chain, dst), greatest(worst, sev) FROM w JOIN e ON chain[len(chain)] = src JOIN s ON s.step = dst WHERE len(chain) < 4 AND NOT list_contains(chain, dst))
SELECT array_to_string(chain, '>') AS chain, round(worst + (len(chain) - 1) * 0.1, 4)::DOUBLE AS score FROM w WHERE len(chain) > 1""")
def gr11(spark, sf):
    part = table(spark, sf, "part")
    links = part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).union(part.select("p_type", F.concat(F.lit("s"), "p_size"))).distinct()
    steps = links.select(F.col("src").alias("step")).union(links.select("dst")).distinct().withColumn("severity", F.length("step") / 10.0)
    found = replay.chains(steps, links, 4)
    return found.select(F.array_join("chain", ">").alias("chain"), F.round("score", 4).alias("score"))


@query("win20_subsumption", """
WITH RECURSIVE e AS (SELECT c_mktsegment AS src, n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
w(chain) AS (SELECT [src, dst] FROM e UNION ALL SELECT list_append(chain, dst) FROM w JOIN e ON chain[len(chain)] = src WHERE len(chain) < 5), t AS (SELECT array_to_string(chain, '>') AS c FROM w)
SELECT c AS chain FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.c <> t.c AND contains('>' || u.c || '>', '>' || t.c || '>'))""")
def win20(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    segments = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("src"), F.col("n_name").alias("dst"))
    links = segments.union(nation.select("n_name", "r_name")).distinct()
    walks = G.paths(links, links.select(F.col("src").alias("node")).distinct(), 4)
    keyed = walks.select(F.col("path").alias("chain"), F.array_join("path", ">").alias("key")).distinct()
    return R.drop_contained(keyed, "chain", "key").select(F.col("key").alias("chain"))


@query("gr21_alias_cross_check", """
WITH p AS (SELECT l_partkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, CASE WHEN list_contains(p.s, (l_suppkey + 1)) THEN 'confirmed' ELSE 'refuted' END AS verdict FROM lineitem l JOIN p USING (l_partkey)""")
def gr21(spark, sf):
    line = table(spark, sf, "lineitem")
    sets = line.groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("s"))
    return line.join(sets, "l_partkey").select("l_orderkey", "l_linenumber", F.when(F.array_contains("s", F.col("l_suppkey") + 1), F.lit("confirmed")).otherwise(F.lit("refuted")).alias("verdict"))


@query("gr22_producer_attach", "SELECT p_partkey, count(DISTINCT l_suppkey) AS flows, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS diagnostics FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def gr22(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_orderkey", "l_returnflag")
    flows = line.groupBy("p_partkey", "l_suppkey").agg(F.lit(1).alias("x")).groupBy("p_partkey").agg(F.count("*").alias("f"))
    diag = line.filter("l_returnflag = 'R'").select("p_partkey", "l_orderkey").distinct().groupBy("p_partkey").agg(F.count("*").alias("d"))
    return table(spark, sf, "part").select("p_partkey").join(flows, "p_partkey", "left").join(diag, "p_partkey", "left").select("p_partkey", F.coalesce("f", F.lit(0)).alias("flows"), F.coalesce("d", F.lit(0)).alias("diagnostics"))


@query("win13_current_paths", """
WITH RECURSIVE c AS (SELECT p_brand, -p_partkey AS position, 'f' || (p_size % 12) AS path, CASE WHEN p_partkey % 9 = 0 THEN 'f' || ((p_size + 1) % 12) END AS renamed_from, row_number() OVER (PARTITION BY p_brand ORDER BY -p_partkey) AS k FROM part),
w AS (SELECT c.*, path AS current_path, CASE WHEN renamed_from IS NULL THEN MAP {} ELSE MAP {renamed_from: path} END AS alias FROM c WHERE k = 1 UNION ALL
  SELECT c.*, coalesce(list_extract(map_extract(alias, c.path), 1), c.path), CASE WHEN c.renamed_from IS NULL THEN alias ELSE map_concat(alias, MAP {c.renamed_from: coalesce(list_extract(map_extract(alias, c.path), 1), c.path)}) END FROM w JOIN c ON c.p_brand = w.p_brand AND c.k = w.k + 1)
SELECT p_brand, position, path, renamed_from, current_path FROM w""")
def win13(spark, sf):
    """Where the files of each brand's changes are now: larger part keys are newer; some changes rename their file."""
    part = table(spark, sf, "part")
    return replay.current_paths(
        part.select("p_brand", (-F.col("p_partkey")).alias("position"), F.concat(F.lit("f"), F.col("p_size") % 12).alias("path"), F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("f"), (F.col("p_size") + 1) % 12)).alias("renamed_from")),
        "p_brand", "position", "path", "renamed_from",
    )


@query("lim09_budgeted_trim", """
WITH k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) SELECT user_id, event_id FROM k WHERE n <= 3 ORDER BY value DESC, event_id LIMIT 200""")
def lim09(spark, sf):
    return replay.trimmed(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 3, 200).select("user_id", "event_id")


@query("lif02_rechecks", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND l.n > 0 THEN 'fixed' WHEN o_orderstatus = 'F' THEN 'fix_candidate' ELSE 'persisting' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON o_orderkey = l_orderkey")
def lif02(spark, sf):
    checks = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    open_ = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").join(checks, "o_orderkey", "left").select("o_orderkey", L.first_true([(open_ & (F.col("n") > 0), "fixed"), (open_, "fix_candidate")], "persisting").alias("state"))


@query("agg30_completion", "SELECT event_type, min(value) AS low, max(value) AS high, count(*) FILTER (value IS NULL) AS unknown FROM events GROUP BY 1")
def agg30(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value").isNull()).alias("unknown"))


@query("chg08_priority", """
WITH s AS (SELECT l_suppkey, count(*)::DOUBLE AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1), m AS (SELECT l_suppkey, 0.6 * a / max(a) OVER () + 0.4 * b / max(b) OVER () AS v FROM s) SELECT l_suppkey, round(v, 6)::DOUBLE AS score FROM m""")
def chg08(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("a"), F.sum("l_quantity").alias("b"))
    return R.max_normalised(s, {"a": 0.6, "b": 0.4}).select("l_suppkey", "score")


@query("chg09_blame_owner", "SELECT l_orderkey, arg_max(l_suppkey, struct_pack(q := n, s := -l_suppkey)) AS owner FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def chg09(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    return c.groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("owner"))


@query("dom44_role_scores", "SELECT source, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1), 0), 6) AS precision, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (toxic = 0), 0), 6) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def dom44(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    q, c = F.col("quality") == 1, F.col("toxic") == 0
    g = rows.groupBy("source").agg(F.count_if(q & c).alias("tp"), F.count_if(q).alias("p"), F.count_if(c).alias("t"))
    return g.select("source", F.round(F.try_divide("tp", "p"), 6).alias("precision"), F.round(F.try_divide("tp", "t"), 6).alias("recall"))
