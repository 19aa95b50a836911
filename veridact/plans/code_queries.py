"""Syntax trees, slices and calls, written from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import syntax as S
from veridact.plans.registry import query, select

FUNCTIONS = "SELECT l_orderkey AS file, l_linenumber AS i, min(l_partkey) AS k FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY l_orderkey, l_linenumber"
#: A function's nodes: way below the function, type, field, named, text, and the variant that alone has them.
TEMPLATE = [
    ("", "function_definition", None, True, "def", None), ("0", "identifier", "name", True, "?", None), ("1", "block", "body", True, "{}", None), ("1.0", "if_statement", None, True, "if", None),
    ("1.0.0", "binary_expression", "condition", True, "a && b", 0), ("1.0.0.1", "&&", "operator", False, "&&", 0), ("1.0.1", "block", "consequence", True, "{}", None), ("1.0.1.0", "for_statement", None, True, "for", None),
    ("1.0.1.0.0", "call", None, True, "g(x)", None), ("1.0.1.0.0.0", "identifier", "function", True, "g", None), ("1.1", "import_statement", None, True, "import os", None), ("1.1.0", "identifier", "name", True, "os", None),
]


def _nodes(spark, sf):
    """Variant 0 has a condition of two parts, variant 2 an error in its loop."""
    parts = F.array(*[F.struct(F.lit(w).alias("way"), F.lit(t).alias("type"), F.lit(f).cast("string").alias("field"), F.lit(n).alias("named"), F.lit(x).alias("written"), F.lit(v).cast("int").alias("only")) for w, t, f, n, x, v in TEMPLATE])
    rows = select(spark, sf, FUNCTIONS).withColumn("v", F.col("k") % 3).select("file", "i", "k", "v", F.explode(parts).alias("t")).select("file", "i", "k", "v", "t.*").filter("only IS NULL OR only = v")
    below = F.filter(F.split("way", r"\."), lambda x: x != "")
    ordinal = F.concat(F.array("i"), F.transform(below, lambda x: x.cast("int")))
    text = F.when(F.col("written") == "?", F.concat(F.lit("f"), F.col("k") % 10)).otherwise(F.col("written"))
    line = F.col("i") * 10
    return rows.select("file", ordinal.alias("ordinal"), "type", "field", "named", text.alias("text"), line.alias("start_line"), (line + 5).alias("end_line"), ((F.col("type") == "for_statement") & (F.col("v") == 2)).alias("error"))


@query("dom27_functions", f"""
SELECT file, i::VARCHAR AS key, 'f' || (k % 10) AS qualified_name, i * 10 AS start_line, i * 10 + 5 AS end_line, CASE k % 3 WHEN 0 THEN 4 ELSE 3 END AS cyclomatic, CASE k % 3 WHEN 0 THEN 4 ELSE 3 END AS cognitive, 2 AS max_nesting,
  NULL::VARCHAR AS parent, CASE k % 3 WHEN 2 THEN 'parse_errors_in_span' ELSE '' END AS gaps FROM ({FUNCTIONS})""")
def dom27(spark, sf):
    found = S.functions(_nodes(spark, sf), ["function_definition"], ["if_statement", "for_statement"], ["if_statement", "for_statement"], [], ["&&", "||"], ["class_definition"], ["identifier"])
    return found.withColumn("gaps", F.array_join("gaps", ","))


@query("agg24_file_complexity", f"""
WITH c AS (SELECT file, CASE k % 3 WHEN 0 THEN 4 ELSE 3 END AS n FROM ({FUNCTIONS}))
SELECT file, count(*) AS functions, sum(n)::BIGINT AS total, max(n) AS highest, round(avg(n), 6) AS average, round(avg((n > 3)::INT), 6) AS share_above FROM c GROUP BY 1""")
def agg24(spark, sf):
    found = S.functions(_nodes(spark, sf), ["function_definition"], ["if_statement", "for_statement"], ["if_statement", "for_statement"], [], ["&&", "||"], [], ["identifier"])
    return S.file_summary(found, 3).withColumns({c: F.round(c, 6) for c in ("average", "share_above")})


@query("dom26_projection", f"""
WITH f AS ({FUNCTIONS}), n AS (SELECT file, i::VARCHAR AS k0, 'f' || (k % 10) AS name FROM f)
SELECT file, k0 AS key, 'definition' AS category, name AS written_name, NULL AS enclosing, '' AS qualifiers, NULL AS import_form FROM n UNION ALL SELECT file, k0 || '.0', 'reference', name, k0, name, NULL FROM n
UNION ALL SELECT file, k0 || '.1.0.1.0.0', 'call_expression', 'g', k0, name, NULL FROM n UNION ALL SELECT file, k0 || '.1.0.1.0.0.0', 'reference', 'g', k0, name, NULL FROM n
UNION ALL SELECT file, k0 || '.1.1', 'import', 'os', k0, name, 'syntax_declaration' FROM n UNION ALL SELECT file, k0 || '.1.1.0', 'reference', 'os', k0, name, NULL FROM n""")
def dom26(spark, sf):
    found = S.project(_nodes(spark, sf), ["function_definition"], ["call"], ["import_statement"], ["identifier"], ["require"])
    return found.withColumn("qualifiers", F.array_join("qualifiers", ","))


LINES = """
SELECT l_orderkey AS function, l_linenumber AS line, min(l_partkey) AS k, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber"""
TEXT = "'v' || CAST(k % 6 AS VARCHAR(9)) || ' = v' || CAST(s % 6 AS VARCHAR(9)) || ' + call(v' || CAST((k + s) % 6 AS VARCHAR(9)) || ', \"v9\"); // v8'"


def _slice_inputs(spark, sf):
    rows = select(spark, sf, f"SELECT function, line, {TEXT} AS text FROM ({LINES}) AS q")
    anchors = rows.groupBy("function").agg(F.max("line").alias("line"))
    headers = rows.groupBy("function").agg(F.min("line").alias("line")).withColumn("params", F.array(F.lit("v0")))
    return S.tokenised(rows, "//", ["if", "for", "return"]), anchors, headers


SLICE = f"""
l AS ({LINES}), t AS (SELECT function, line, 'v' || (k % 6) AS d, 'v' || (s % 6) AS r1, 'v' || ((k + s) % 6) AS r2 FROM l),
a AS (SELECT function, max(line) AS line, min(line) AS head FROM t GROUP BY 1), n AS (SELECT t.function, t.line, u.x AS name FROM t, unnest([d, r1, r2]) u(x)),
b AS (SELECT t.function, t.line, t.d AS name FROM t UNION SELECT function, head, 'v0' FROM a),
w(function, line, name) AS (SELECT n.function, n.line, n.name FROM n JOIN a USING (function, line)
  UNION SELECT t.function, t.line, u.x FROM w JOIN b ON b.function = w.function AND b.name = w.name AND b.line < w.line JOIN t ON t.function = b.function AND t.line = b.line JOIN a ON a.function = t.function AND a.head <> t.line, unnest([r1, r2]) u(x)),
m AS (SELECT function, head AS line, 'function_header' AS reason FROM a UNION SELECT n.function, n.line, 'interacter' FROM n JOIN a ON a.function = n.function AND a.line <> n.line JOIN n q ON q.function = a.function AND q.line = a.line AND q.name = n.name
  UNION SELECT b.function, b.line, 'backward_def' FROM w JOIN b ON b.function = w.function AND b.name = w.name AND b.line < w.line)"""


@query("dom46_lexical_slice", f"WITH RECURSIVE {SLICE} SELECT function, line, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM m GROUP BY 1, 2")
def dom46(spark, sf):
    found, _ = S.lexical_slice(*_slice_inputs(spark, sf))
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query("dom45_composed_slices", f"""
WITH RECURSIVE {SLICE}, x AS (SELECT function, line, reason, 0 AS p, 'lexical' AS strategy FROM m UNION ALL
  SELECT t.function, t.line, 'may_store', 2, 'points_to' FROM t JOIN a ON a.function = t.function AND a.line <> t.line JOIN t q ON q.function = a.function AND q.line = a.line WHERE t.d IN (q.r1, q.r2))
SELECT function, line, max_by(strategy, p) AS strategy, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, 'strategy_failed: syntax: ValueError' AS gaps FROM x GROUP BY 1, 2""")
def dom45(spark, sf):
    """Lexical and points-to slices together; a third strategy fails, which is a gap and no more."""
    tokens, anchors, headers = _slice_inputs(spark, sf)

    def failing():
        raise ValueError("no tree")

    loads, stores = tokens.select("function", "line", F.col("right").alias("objects")), tokens.select("function", "line", F.col("defines").alias("objects"))
    called = tokens.select("function", "line", F.array_except("names", "defines").alias("objects"))
    found, gaps = S.composed({"lexical": S.lexical_slice(tokens, anchors, headers)[0], "points_to": S.memory_slice(loads.union(called), stores, anchors), "syntax": failing})
    return found.select("function", "line", "strategy", F.array_join("reasons", ",").alias("reasons"), F.lit(",".join(gaps)).alias("gaps"))


CALLED = "SELECT DISTINCT o_custkey AS function, 'c' || CAST(o_orderkey % 7 AS VARCHAR(9)) AS callee FROM orders"
BODY = "SELECT o_custkey AS function, o_orderkey AS line, CASE o_orderkey % 4 WHEN 0 THEN 'c' || CAST(o_orderkey % 5 AS VARCHAR(9)) || ' (x, \"c6(y)\");' WHEN 1 THEN '// c1(z)' WHEN 2 THEN 'xc2(1); c3 = c4;' ELSE 'c2(c1(0));' END AS text FROM orders"


@query("dom28_call_anchors", f"""
WITH c AS ({CALLED}), p AS (SELECT o_custkey AS function, o_orderkey AS line, u.x AS callee FROM orders, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['c' || (o_orderkey % 5)] WHEN 2 THEN ['xc2'] WHEN 3 THEN ['c2', 'c1'] ELSE []::VARCHAR[] END) u(x)),
f AS (SELECT function, callee, min(line) AS line, count(*) AS n FROM p GROUP BY 1, 2)
SELECT c.function, c.callee, f.line, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'anchored' END AS state FROM c LEFT JOIN f USING (function, callee)""")
def dom28(spark, sf):
    return S.anchored_calls(select(spark, sf, CALLED), select(spark, sf, BODY))
