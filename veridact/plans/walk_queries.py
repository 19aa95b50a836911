"""Calls, includes, links, evidence and kept objects, drawn from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import walks as W
from veridact.plans.registry import query, select

CALLS = """
SELECT DISTINCT 'f' || CAST(p_partkey % 60 AS VARCHAR(9)) AS caller, 'f' || CAST((p_partkey * 7 + p_size) % 60 AS VARCHAR(9)) AS callee, CASE p_size % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'virtual' ELSE 'indirect' END AS family,
       CASE p_size % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'command' ELSE 'none' END AS sink_class FROM part"""


def _call_sql(near: str, far: str, depth: int, where: str) -> str:
    return f"""
WITH RECURSIVE c AS ({CALLS}), w(subject, node, d) AS (SELECT x, x, 0 FROM (VALUES ('f3'), ('f7')) t(x) UNION SELECT subject, {far}, d + 1 FROM w JOIN c ON node = {near} WHERE d < {depth - 1}),
m AS (SELECT subject, node, min(d) AS d FROM w GROUP BY 1, 2)
SELECT subject, caller, callee, family, sink_class, min(d + 1)::INT AS distance FROM m JOIN c ON node = {near} WHERE {where} GROUP BY ALL"""


@query("gr03_callers", _call_sql("callee", "caller", 3, "family IN ('direct', 'virtual')"))
def gr03(spark, sf):
    subjects = spark.createDataFrame([("f3",), ("f7",)], "subject string")
    return W.call_sites(select(spark, sf, CALLS), subjects, "callers", 3, families=("direct", "virtual"))


@query("gr03_callees", _call_sql("caller", "callee", 4, "sink_class IN ('memory', 'command')"))
def gr03b(spark, sf):
    subjects = spark.createDataFrame([("f3",), ("f7",)], "subject string")
    return W.call_sites(select(spark, sf, CALLS), subjects, "callees", 4, sink_classes=("memory", "command"))


UNITS = "SELECT s_suppkey AS unit, 'src/m' || CAST(s_suppkey AS VARCHAR(9)) || '.c' AS main FROM supplier"
FILES = "SELECT 'src/m' || CAST(s_suppkey AS VARCHAR(9)) || '.c' AS path FROM supplier UNION SELECT CASE p_partkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'inc/' ELSE 'sys/' END || 'h' || CAST(p_partkey % 45 AS VARCHAR(9)) || '.h' FROM part"
INCLUDES = """
SELECT DISTINCT 'src/m' || CAST(s_suppkey AS VARCHAR(9)) || '.c' AS path, s_suppkey % 2 = 0 AS quoted, 'h' || CAST(s_suppkey % 45 AS VARCHAR(9)) || '.h' AS name FROM supplier
UNION SELECT CASE p_partkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'inc/' ELSE 'sys/' END || 'h' || CAST(p_partkey % 45 AS VARCHAR(9)) || '.h', p_size % 2 = 0, CASE p_size % 5 WHEN 0 THEN '../inc/' WHEN 1 THEN './' ELSE '' END || 'h' || CAST((p_partkey + p_size) % 45 AS VARCHAR(9)) || '.h' FROM part"""
DIRECTORIES = "SELECT s_suppkey AS unit, false AS quoted, 1 AS place, 'inc' AS directory FROM supplier UNION ALL SELECT s_suppkey, false, 2, 'sys' FROM supplier UNION ALL SELECT s_suppkey, true, 0, 'src' FROM supplier WHERE s_suppkey % 3 = 0"
#: Every include line of every unit with the file it means: names hold at most one folder step, which plain replacing settles.
RESOLVED = f"""
u AS ({UNITS}), f AS ({FILES}), i AS ({INCLUDES}), d AS ({DIRECTORIES}),
t AS (SELECT u.unit, i.path, i.quoted, i.name, -1 AS place, regexp_replace(i.path, '/[^/]*$', '') AS directory FROM u, i WHERE i.quoted UNION ALL SELECT d.unit, i.path, i.quoted, i.name, d.place, d.directory FROM i, d WHERE i.quoted OR NOT d.quoted),
h AS (SELECT *, CASE WHEN name LIKE '../%' THEN substr(name, 4) WHEN name LIKE './%' THEN directory || '/' || substr(name, 3) ELSE directory || '/' || name END AS header FROM t),
r AS (SELECT DISTINCT unit, path, header FROM (SELECT unit, path, quoted, name, min_by(header, place) AS header FROM h WHERE header IN (SELECT path FROM f) GROUP BY ALL))"""


def _closure(spark, sf):
    return W.include_closure(*[select(spark, sf, s) for s in (UNITS, INCLUDES, FILES, DIRECTORIES)])


@query("gr14_include_closure", f"""
WITH RECURSIVE {RESOLVED}, c(unit, path) AS (SELECT unit, main FROM u UNION SELECT c.unit, r.header FROM c JOIN r ON r.unit = c.unit AND r.path = c.path)
SELECT unit, path FROM c""")
def gr14(spark, sf):
    return _closure(spark, sf)


SEEDS = "SELECT 'seed' || CAST(p_partkey AS VARCHAR(9)) AS seed, p_size % 3 AS rank, CASE WHEN p_partkey % 4 = 0 THEN 'src/m' || CAST(p_partkey % 10 AS VARCHAR(9)) || '.c' ELSE 'inc/h' || CAST(p_partkey % 45 AS VARCHAR(9)) || '.h' END AS path FROM part WHERE p_partkey < 40"


@query("jn27_units_of_seeds", f"""
WITH RECURSIVE {RESOLVED}, c(unit, path) AS (SELECT unit, main FROM u UNION SELECT c.unit, r.header FROM c JOIN r ON r.unit = c.unit AND r.path = c.path), s AS ({SEEDS}),
m AS (SELECT s.seed, s.rank, u.unit, u.main FROM s JOIN u ON s.path = u.main UNION ALL SELECT s.seed, s.rank, u.unit, u.main FROM s JOIN c ON c.path = s.path JOIN u ON u.unit = c.unit WHERE s.path NOT IN (SELECT main FROM u)),
a AS (SELECT unit, row_number() OVER (ORDER BY min(row(rank, seed, main, unit))) <= 6 AS kept FROM m GROUP BY 1)
SELECT seed, unit, kept FROM m JOIN a USING (unit)""")
def jn27(spark, sf):
    return W.units_of_seeds(select(spark, sf, UNITS), _closure(spark, sf), select(spark, sf, SEEDS), 6)[0]


LINKS = "SELECT DISTINCT 'l' || CAST(p_partkey % 70 AS VARCHAR(9)) AS input, CASE WHEN p_size % 4 = 0 THEN 'p' || CAST(p_partkey % 9 AS VARCHAR(9)) WHEN p_size % 4 = 1 THEN 'x' ELSE 'l' || CAST((p_partkey * 3 + p_size) % 70 AS VARCHAR(9)) END AS output FROM part"
LIBRARIES = "SELECT DISTINCT 'l' || CAST(p_partkey % 70 AS VARCHAR(9)) AS library FROM part"
PROCESSES = "SELECT DISTINCT 'p' || CAST(p_partkey % 8 AS VARCHAR(9)) AS process FROM part"
FOLDED = f"""
k AS ({LINKS}), l AS ({LIBRARIES}), p AS ({PROCESSES}), w(library, node) AS (SELECT input, output FROM k JOIN l ON input = library UNION SELECT w.library, k.output FROM w JOIN k ON w.node = k.input JOIN l ON l.library = w.node),
o AS (SELECT library, node AS process FROM w WHERE node IN (SELECT process FROM p))"""


def _folded(spark, sf):
    return W.folded(*[select(spark, sf, s) for s in (LINKS, LIBRARIES, PROCESSES)])


@query("gr15_folded_libraries", f"WITH RECURSIVE {FOLDED} SELECT DISTINCT library, process FROM o")
def gr15(spark, sf):
    return _folded(spark, sf)


THINGS = "SELECT 'l' || CAST(p_partkey AS VARCHAR(9)) AS thing, 'u' || CAST(p_partkey % 25 AS VARCHAR(9)) AS unit, 'd' || CAST(p_partkey % 6 AS VARCHAR(9)) || '/f' || CAST(p_partkey % 30 AS VARCHAR(9)) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'd' || CAST(p_partkey % 4 AS VARCHAR(9)) || '/' WHEN p_partkey = 33 THEN '' END AS root FROM part WHERE p_partkey < 70"
SITES = "SELECT event_id AS site, CASE WHEN user_id % 2 = 0 THEN 'u' || CAST(user_id % 30 AS VARCHAR(9)) END AS unit, CASE WHEN event_id % 9 > 0 THEN 'd' || CAST(event_id % 6 AS VARCHAR(9)) || '/f' || CAST(event_id % 36 AS VARCHAR(9)) END AS path FROM events"


@query("gr15_site_owners", f"""
WITH RECURSIVE {FOLDED}, t AS ({THINGS}), s AS ({SITES}),
bu AS (SELECT site, thing FROM s JOIN t USING (unit)), bp AS (SELECT site, thing FROM s JOIN t USING (path)), nb AS (SELECT * FROM bu INTERSECT SELECT * FROM bp),
st AS (SELECT site, thing, 'source_path' AS rule FROM nb UNION SELECT site, thing, 'build_unit' FROM bu WHERE site NOT IN (SELECT site FROM nb) UNION SELECT site, thing, 'source_path' FROM bp WHERE site NOT IN (SELECT site FROM bu)),
rt AS (SELECT site, thing, 'source_root' AS rule FROM s JOIN t ON starts_with(s.path, t.root) WHERE site NOT IN (SELECT site FROM st) QUALIFY length(t.root) = max(length(t.root)) OVER (PARTITION BY site)),
fd AS (SELECT * FROM st UNION SELECT * FROM rt), ow AS (SELECT DISTINCT site, process, rule FROM fd JOIN o ON o.library = fd.thing)
SELECT s.site, ow.process, coalesce(r.rule, 'source_root') AS rule FROM s LEFT JOIN (SELECT DISTINCT site, rule FROM fd) r USING (site) LEFT JOIN ow ON ow.site = s.site AND ow.rule = r.rule""")
def gr15b(spark, sf):
    known = lambda c: F.array_compact(F.array(c))
    things = select(spark, sf, THINGS).select("thing", known("unit").alias("units"), known("path").alias("paths"), known("root").alias("roots"))
    return W.owners(select(spark, sf, SITES), things, _folded(spark, sf).withColumnRenamed("library", "thing"))


RELATIONS = "SELECT DISTINCT 'n' || CAST(p_partkey AS VARCHAR(9)) AS source, CASE p_size % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'DERIVED_FROM' ELSE 'MENTIONS' END AS kind, 'n' || CAST((p_partkey * 5 + 1) % 200 AS VARCHAR(9)) AS target FROM part"


@query("gr23_supporting", f"""
WITH r AS ({RELATIONS}), e AS (SELECT CASE kind WHEN 'SUPPORTS' THEN target ELSE source END AS a, CASE kind WHEN 'SUPPORTS' THEN source ELSE target END AS b FROM r WHERE kind <> 'MENTIONS'),
h AS (SELECT a AS identity, b AS evidence, 1 AS hops FROM e UNION ALL SELECT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a)
SELECT identity, evidence, min(hops)::INT AS hops FROM h WHERE identity <> evidence GROUP BY 1, 2""")
def gr23(spark, sf):
    relations = select(spark, sf, RELATIONS)
    starts = relations.select(F.col("source").alias("identity")).union(relations.select("target")).distinct()
    return W.supporting(relations, starts)


PARENTS = "SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1 UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 2 UNION SELECT c_custkey, c_custkey // 4 FROM customer WHERE c_custkey > 3".replace("// 2", "/ 2").replace("// 3", "/ 3").replace("// 4", "/ 4")
PARENTS = PARENTS.replace("c_custkey / 2", "(c_custkey - c_custkey % 2) / 2").replace("c_custkey / 3", "(c_custkey - c_custkey % 3) / 3").replace("c_custkey / 4", "(c_custkey - c_custkey % 4) / 4")
PARENTS = f"SELECT CAST(child AS BIGINT) AS child, CAST(parent AS BIGINT) AS parent FROM ({PARENTS}) AS q"


@query("set07_parent_reduction", f"""
WITH RECURSIVE e AS ({PARENTS}), w(a, b) AS (SELECT child, parent FROM e UNION SELECT w.a, e.parent FROM w JOIN e ON w.b = e.child)
SELECT child, parent FROM e WHERE NOT EXISTS (SELECT 1 FROM e o JOIN w ON w.a = o.parent WHERE o.child = e.child AND w.b = e.parent)""")
def set07(spark, sf):
    return W.reduced_parents(select(spark, sf, PARENTS))


@query("gr12_levels", f"""
WITH RECURSIVE e AS (SELECT parent AS src, child AS dst FROM ({PARENTS}) UNION ALL SELECT * FROM (VALUES (-1, -2), (-2, -3), (-3, -2), (-3, -4)) v(a, b)),
w(node, level) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) AND src >= 0 UNION SELECT e.dst, level + 1 FROM w JOIN e ON w.node = e.src)
SELECT node, max(level)::INT AS level FROM w GROUP BY 1 UNION ALL SELECT -1, 0 UNION ALL SELECT x, NULL FROM (VALUES (-2), (-3), (-4)) v(x)""")
def gr12(spark, sf):
    """Levels of a graph with a cycle beside it; what is on the cycle or behind it has none."""
    edges = select(spark, sf, PARENTS).select(F.col("parent").alias("src"), F.col("child").alias("dst")).union(spark.createDataFrame([(-1, -2), (-2, -3), (-3, -2), (-3, -4)], "src long, dst long"))
    done, rest = W.levelled(edges)
    return done.unionByName(rest.withColumn("level", F.lit(None).cast("int")))


CHAIN = "SELECT c_custkey AS object, c_custkey % 50 = 7 AS held FROM customer"


@query("dom40_retention", f"""
WITH RECURSIVE x AS ({CHAIN}), k(o) AS (SELECT object FROM x WHERE held UNION SELECT o + 1 FROM k WHERE (o + 1) % 50 <> 0 AND o + 1 < (SELECT count(*) FROM x))
SELECT object, object IN (SELECT o FROM k) AS kept FROM x""")
def dom40(spark, sf):
    """Chains of references from a held object to the end of its fifty; nothing that is referred to goes."""
    objects = select(spark, sf, CHAIN)
    references = objects.select(F.col("object").alias("src"), (F.col("object") + 1).alias("dst")).filter("dst % 50 <> 0").join(objects.select(F.col("object").alias("dst")), "dst", "left_semi")
    return W.retained(objects, references, F.col("held")).select("object", "kept")


CHANGES = "SELECT l_orderkey AS change_id, l_suppkey AS path FROM lineitem UNION ALL SELECT -1, c_custkey FROM customer"
BULK = 60


@query("gr17_components", f"""
WITH RECURSIVE d AS (SELECT DISTINCT change_id, path FROM ({CHANGES})), s AS (SELECT * FROM d WHERE change_id NOT IN (SELECT change_id FROM d GROUP BY 1 HAVING count(*) > {BULK})),
p AS (SELECT a.path AS a, b.path AS b FROM s a JOIN s b ON a.change_id = b.change_id AND a.path <> b.path GROUP BY 1, 2 HAVING count(*) >= 3), w(node, seen) AS (SELECT a, a FROM p UNION SELECT w.node, p.b FROM w JOIN p ON w.seen = p.a)
SELECT node, min(seen) AS component, (SELECT count(*) FROM (SELECT change_id FROM d GROUP BY 1 HAVING count(*) > {BULK})) AS bulk_changes FROM w GROUP BY 1""")
def gr17(spark, sf):
    """Groups of paths that change together three times or more; bulk changes are left out and counted."""
    from veridact.operators import graph as G

    pairs, bulk = W.co_changed(select(spark, sf, CHANGES), "change_id", "path", 3, BULK)
    return G.components(pairs.select(F.col("left").alias("src"), F.col("right").alias("dst"))).withColumn("bulk_changes", F.lit(bulk.count()))


@query("agg07_co_change", f"""
WITH d AS (SELECT DISTINCT change_id, path FROM ({CHANGES})), s AS (SELECT * FROM d WHERE change_id NOT IN (SELECT change_id FROM d GROUP BY 1 HAVING count(*) > {BULK})), t AS (SELECT path, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.path AS "left", b.path AS "right", count(*) AS support FROM s a JOIN s b ON a.change_id = b.change_id AND a.path <> b.path GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT "left", "right", support, round(support / n, 6) AS confidence, 1::BIGINT AS bulk_changes FROM p JOIN t ON p."left" = t.path QUALIFY row_number() OVER (PARTITION BY "left" ORDER BY support DESC, "right") <= 3""")
def agg07(spark, sf):
    """The three partners that each path changes with most; bulk changes count neither as support nor in the totals, and are counted."""
    changes = select(spark, sf, CHANGES)
    pairs, bulk = W.co_changed(changes, "change_id", "path", 3, BULK)
    totals = changes.distinct().join(bulk.select("change_id"), "change_id", "left_anti").groupBy(F.col("path").alias("left")).agg(F.count("*").alias("n"))
    both = pairs.union(pairs.select(F.col("right"), F.col("left"), "support"))
    rated = both.join(totals, "left").select("left", "right", "support", F.round(F.col("support") / F.col("n"), 6).alias("confidence"))
    top = W.first_of(rated, ["left"], [F.col("support").desc(), F.col("right")], 3)
    return top.drop("place", "omitted").withColumn("bulk_changes", F.lit(bulk.count()))


@query("jn19_pairs", f"""
WITH d AS (SELECT DISTINCT change_id, path FROM ({CHANGES})), s AS (SELECT * FROM d WHERE change_id NOT IN (SELECT change_id FROM d GROUP BY 1 HAVING count(*) > {BULK}))
SELECT a.path AS "left", b.path AS "right", count(*) AS support FROM s a JOIN s b ON a.change_id = b.change_id AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 2""")
def jn19(spark, sf):
    return W.co_changed(select(spark, sf, CHANGES), "change_id", "path", 2, BULK)[0]
