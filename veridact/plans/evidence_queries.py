"""Logs, pages, wanted rows, sorted files and data-flow diagrams, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridact.operators import threats as T
from veridact.operators import walks as W
from veridact.plans.registry import query, select, table
from veridact.plans.walk_queries import FOLDED, LIBRARIES, PROCESSES, SITES, THINGS, _folded
from veridact.session import cut, shared_path
from veridact.sources import logs, pages


def _reply(collection: str, page: int) -> pages.Reply:
    """Five records a page, of which the last two come again on the next; some collections fail on their way."""
    n = int(collection[1:])
    if n % 10 == 5 and page == 2:
        return pages.Reply(500, None)
    body: list = [{"id": page * 3 + j} for j in range(5)]
    if n % 10 == 6 and page == 2:
        body[2] = "odd"
    return pages.Reply(200, body, page + 1 if page <= n % 5 else None)


@query("src18_paginate", """
WITH c AS (SELECT 'c' || s_suppkey AS collection, s_suppkey % 10 AS n, s_suppkey % 5 + 1 AS pages FROM supplier),
p AS (SELECT c.*, page, CASE WHEN n = 5 AND page = 2 THEN 'page_unavailable' WHEN n = 6 AND page = 2 THEN 'page_malformed' END AS bad FROM c, unnest(range(1, 5)) t(page) WHERE page <= pages AND page <= 4),
q AS (SELECT *, min(page) FILTER (bad IS NOT NULL) OVER (PARTITION BY collection) AS stop FROM p),
r AS (SELECT collection, page, j AS place, page * 3 + j AS id FROM q, unnest(range(5)) u(j) WHERE (stop IS NULL OR page < stop OR (page = stop AND bad = 'page_malformed' AND j < 2))),
f AS (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY page, place) AS nth FROM r)
SELECT collection, 'record' AS kind, page::INT AS page, place::INT AS place, id::VARCHAR AS key, NULL AS gap, NULL::INT AS requests, NULL::INT AS duplicates FROM f WHERE nth = 1
UNION ALL SELECT collection, 'end', least(max(page), coalesce(any_value(stop), max(page)))::INT + (any_value(stop) IS NULL AND any_value(pages) > 4)::INT, NULL, NULL, coalesce(max(bad), CASE WHEN any_value(pages) > 4 THEN 'pagination_bound_reached' END), least(max(page), coalesce(any_value(stop), max(page)))::INT,
  (SELECT count(*) FROM f WHERE f.collection = q.collection AND nth > 1)::INT FROM q GROUP BY collection""")
def src18(spark, sf):
    names = select(spark, sf, "SELECT 'c' || CAST(s_suppkey AS VARCHAR(9)) AS collection FROM supplier")
    return pages.collected(names, _reply, lambda r: str(r["id"]), max_pages=4, max_records=100).drop("record")


@query("src05_wanted_paths", "SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS path FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 3)")
def src05(spark, sf):
    """Line items as line files by path, of which only the folders of wanted paths are read."""
    where = shared_path(spark, "wanted")
    rows = select(spark, sf, "SELECT l_orderkey, l_linenumber, 'p' || CAST(l_partkey AS VARCHAR(9)) AS path FROM lineitem")
    pages.write_by_path(rows, where, "path")
    wanted = select(spark, sf, "SELECT 'p' || CAST(p_partkey AS VARCHAR(9)) AS path FROM part WHERE p_size = 3")
    return pages.read_wanted(spark, where, "l_orderkey long, l_linenumber int, path string", "path", wanted)


LOG = "SELECT user_id % 5 AS log, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS sequence, event_id, event_type FROM events"


@query("src32_log_faults", f"""
WITH l AS (SELECT * FROM ({LOG}) WHERE event_id % 97 > 0), b AS (SELECT log, coalesce(lag(sequence) OVER (PARTITION BY log ORDER BY sequence), 0) AS after, sequence AS found FROM l)
SELECT log, after, found, 0::BIGINT AS torn FROM b WHERE found <> after + 1""")
def src32(spark, sf):
    """Logs written as line files and read again: where their numbers skip, and how many lines are torn."""
    where = shared_path(spark, "logs")
    select(spark, sf, LOG).filter("event_id % 97 > 0").select(F.to_json(F.struct("log", "sequence", "event_id", "event_type")).alias("value")).write.text(where)
    rows = logs.log_table(spark, where, "log long, sequence long, event_id long, event_type string")
    torn = rows.filter("status <> 'complete'").count()
    return logs.sequence_faults(rows.filter("status = 'complete'"), "log", "sequence").withColumn("torn", F.lit(torn).cast("long"))


@query("str03_follower", f"""
WITH k AS (SELECT *, CASE WHEN event_type <> 'error' THEN 'k:' || event_type ELSE 's:' || sequence END AS held FROM ({LOG})), f AS (SELECT *, min(sequence) OVER (PARTITION BY log, held) AS first FROM k),
p AS (SELECT *, dense_rank() OVER (PARTITION BY log ORDER BY first) AS place FROM f), s AS (SELECT *, min(CASE WHEN place > 40 THEN sequence END) OVER (PARTITION BY log) AS stop FROM p),
r AS (SELECT *, stop IS NOT NULL AND sequence >= stop AS refused FROM s), l AS (SELECT *, max(CASE WHEN NOT refused THEN sequence END) OVER (PARTITION BY log, held) AS last FROM r)
SELECT log, sequence, event_id, event_type, refused FROM l WHERE refused OR sequence = last""")
def str03(spark, sf):
    rows = select(spark, sf, LOG).withColumn("replaceable", F.col("event_type") != "error")
    return logs.coalesced(rows, "log", "sequence", "event_type", "replaceable", 40).drop("replaceable")


@query("snk05_sorted_files", "SELECT l_orderkey, l_linenumber, l_partkey, 0::BIGINT AS out_of_order FROM lineitem")
def snk05(spark, sf):
    """Line items as sorted line files, and how many neighbouring files, by name, are not in order."""
    where, order = shared_path(spark, "sorted"), ["l_orderkey", "l_linenumber", "l_partkey"]
    pages.write_sorted(table(spark, sf, "lineitem").select(*order), where, order, 500)
    rows = spark.read.schema("l_orderkey long, l_linenumber int, l_partkey long").json(where)
    files = rows.select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("name"), F.struct(*order).alias("at")).groupBy("name").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    from pyspark.sql import Window

    wrong = files.withColumn("before", F.max("high").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1))).filter("before > low").count()
    return rows.withColumn("out_of_order", F.lit(wrong).cast("long"))


ACTS = f"SELECT s.site, s.unit, s.path, e.event_type AS interaction, CASE e.user_id % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'declared' ELSE 'derived' END AS basis, 'ev' || CAST(e.event_id % 50 AS VARCHAR(9)) AS evidence FROM ({SITES}) AS s JOIN events AS e ON e.event_id = s.site"
RULES = [("view", "user", "inbound", "network"), ("click", "user", "inbound", "network"), ("purchase", "bank", "outbound", "process")]
TEMPLATES = [("spoof", "view", "network", "inbound"), ("tamper", "view", "network", "inbound"), ("repudiate", "purchase", "process", "outbound"), ("leak", "click", "network", "outbound")]


def _acts(spark, sf):
    """Events joined with themselves; neither side is broadcast."""
    return select(spark, sf, ACTS.replace("SELECT", "SELECT /*+ MERGE(e) */", 1))


def _owned(spark, sf):
    known = lambda c: F.array_compact(F.array(c))
    things = select(spark, sf, THINGS).select("thing", known("unit").alias("units"), known("path").alias("paths"), known("root").alias("roots"))
    return cut(W.owners(select(spark, sf, SITES), things, _folded(spark, sf).withColumnRenamed("library", "thing")), "owners")


def _flows(spark, sf):
    rules = spark.createDataFrame(RULES, "interaction string, peer string, direction string, boundary string")
    return cut(T.flows(_acts(spark, sf).drop("unit", "path"), _owned(spark, sf), rules, 3), "flows")


OWNERS = f"""{FOLDED}, t AS ({THINGS}), s AS ({SITES}),
bu AS (SELECT site, thing FROM s JOIN t USING (unit)), bp AS (SELECT site, thing FROM s JOIN t USING (path)), nb AS (SELECT * FROM bu INTERSECT SELECT * FROM bp),
st AS (SELECT site, thing, 'source_path' AS rule FROM nb UNION SELECT site, thing, 'build_unit' FROM bu WHERE site NOT IN (SELECT site FROM nb) UNION SELECT site, thing, 'source_path' FROM bp WHERE site NOT IN (SELECT site FROM bu)),
rt AS (SELECT site, thing, 'source_root' AS rule FROM s JOIN t ON starts_with(s.path, t.root) WHERE site NOT IN (SELECT site FROM st) QUALIFY length(t.root) = max(length(t.root)) OVER (PARTITION BY site)),
fd AS (SELECT * FROM st UNION SELECT * FROM rt), ow AS (SELECT DISTINCT site, process, rule FROM fd JOIN o ON o.library = fd.thing)"""
FLOWS = f"""{OWNERS}, ac AS ({ACTS}), m AS (SELECT ac.site, ow.process, CASE interaction WHEN 'view' THEN 'ext:user' WHEN 'click' THEN 'ext:user' WHEN 'purchase' THEN 'ext:bank' ELSE 'store:' || interaction END AS peer, interaction,
  CASE WHEN interaction IN ('view', 'click') THEN 'inbound' ELSE 'outbound' END AS direction, CASE WHEN interaction IN ('view', 'click') THEN 'network' WHEN interaction = 'purchase' THEN 'process' END AS boundary,
  list_position(['verified', 'observed', 'declared', 'derived'], basis) AS b, list_position(['source_path', 'build_unit', 'source_root'], rule) AS o, evidence FROM ac JOIN ow ON ow.site = ac.site),
ev AS (SELECT process, peer, interaction, evidence, min(b) AS b FROM m GROUP BY ALL), el AS (SELECT process, peer, interaction, string_agg(evidence, ',' ORDER BY b, evidence) AS evidence FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY process, peer, interaction ORDER BY b, evidence) <= 3) GROUP BY ALL),
fl AS (SELECT process, peer, interaction, direction, boundary, count(DISTINCT site) AS sites, (['verified', 'observed', 'declared', 'derived'])[min(b)] AS basis, (['source_path', 'build_unit', 'source_root'])[max(o)] AS ownership, el.evidence, substr(sha256(process || '|' || peer || '|' || interaction), 1, 16) AS flow
  FROM m JOIN el USING (process, peer, interaction) GROUP BY ALL)"""


@query("dom32_flows", f"WITH RECURSIVE {FLOWS} SELECT * FROM fl")
def dom32(spark, sf):
    return _flows(spark, sf).withColumn("evidence", F.array_join("evidence", ","))


@query("dom32_unknowns", f"""
WITH RECURSIVE {FLOWS} SELECT 'deployment_not_described' AS kind, process AS subject, 1::BIGINT AS n FROM p UNION ALL SELECT 'boundary_not_established', process, 1 FROM p WHERE process NOT IN (SELECT process FROM fl WHERE boundary IS NOT NULL)
UNION ALL SELECT u.x, process, 1 FROM (SELECT DISTINCT process FROM fl WHERE boundary = 'network'), unnest(['peer_unidentified', 'protocol_unknown', 'authentication_not_located']) u(x)
UNION ALL SELECT 'datastore_unidentified', process || '|' || peer, 1 FROM (SELECT DISTINCT process, peer FROM fl WHERE peer LIKE 'store:%') UNION ALL SELECT 'runtime_role_unknown', library, 1 FROM l WHERE library NOT IN (SELECT library FROM o)
UNION ALL SELECT 'flow_endpoint_unresolved', interaction || '|' || coalesce(split_part(path, '/', 1), 'an unstated path'), count(*) FROM ac WHERE site NOT IN (SELECT site FROM ow) GROUP BY 2""")
def dom32b(spark, sf):
    return T.unknowns(select(spark, sf, PROCESSES), _flows(spark, sf), _folded(spark, sf), select(spark, sf, LIBRARIES), _acts(spark, sf).select("site", "interaction", "path"), _owned(spark, sf))


@query("jn22_threats", f"""
WITH RECURSIVE {FLOWS}, te(template, interaction, boundary, direction) AS (VALUES ('spoof', 'view', 'network', 'inbound'), ('tamper', 'view', 'network', 'inbound'), ('repudiate', 'purchase', 'process', 'outbound'), ('leak', 'click', 'network', 'outbound')),
th AS (SELECT DISTINCT substr(sha256(template || '|' || flow), 1, 16) AS threat, template, flow, boundary FROM fl JOIN te USING (interaction, boundary, direction))
SELECT *, (SELECT count(*) FROM th) > 12 AS cut FROM th ORDER BY threat LIMIT 12""")
def jn22(spark, sf):
    kept, cut = T.threats(_flows(spark, sf), spark.createDataFrame(TEMPLATES, "template string, interaction string, boundary string, direction string"), 12)
    return kept.withColumn("cut", F.lit(cut))
