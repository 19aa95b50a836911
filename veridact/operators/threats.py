"""Data-flow diagrams from linked facts: flows across boundaries, entry points, what is not known, and the threats that templates ask about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of evidence, strongest first, and rules of ownership, surest first.
BASES = ("verified", "observed", "declared", "derived")
OWNERSHIP = ("source_path", "build_unit", "source_root")


def _rank(column: str, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))


def _at(order: Sequence[str], rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in order]), (rank - 1).cast("int"))


def strongest_first(rows: DataFrame, keys: Sequence[str], basis: str, order: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` rows of each group by basis and then order, and (keys, omitted) of groups that have more."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(_rank(basis, BASES), *order)))
    more = placed.filter(F.col("place") > most).groupBy(*keys).agg(F.count("*").alias("omitted"))
    return placed.filter(F.col("place") <= most).drop("place"), more


def flows(sites: DataFrame, owned: DataFrame, rules: DataFrame, most_evidence: int) -> DataFrame:
    """One row per process, peer and interaction: where it leads, what it crosses, how sure it is, and its first evidence.

    ``sites``: site, interaction, basis, evidence. ``owned``: site, process, rule (of :func:`walks.owners`). ``rules``: interaction, peer,
    direction, boundary; an interaction without a rule goes out to a store of its own and crosses nothing. The surest basis of
    the sites is the flow's; of ownership, the least sure. Evidence is the strongest, then the first, ``most_evidence`` at most.
    """
    # sites and their owners are small as files and large in memory: neither is broadcast by the size of its files
    met = sites.join(owned.filter("process IS NOT NULL").hint("merge"), "site").join(rules, "interaction", "left")
    peer = F.coalesce(F.concat(F.lit("ext:"), "peer"), F.concat(F.lit("store:"), "interaction"))
    placed = met.withColumns({"peer": peer, "direction": F.coalesce("direction", F.lit("outbound")), "b": _rank("basis", BASES), "o": _rank("rule", OWNERSHIP)})
    keys = ["process", "peer", "interaction", "direction", "boundary"]
    # evidence is cut per flow before it is listed, so no list grows with the sites
    one = placed.groupBy(*keys, "evidence").agg(F.min("b").alias("b"))
    first = one.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("b", "evidence"))).filter(F.col("place") <= most_evidence)
    listed = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence"))), lambda e: e["evidence"]).alias("evidence"))
    size = placed.groupBy(*keys).agg(F.count_distinct("site").alias("sites"), F.min("b").alias("b"), F.max("o").alias("o"))
    same = [size[k].eqNullSafe(listed[k]) for k in keys]
    both = size.join(listed, same).select(*[size[k] for k in keys], "sites", _at(BASES, F.col("b")).alias("basis"), _at(OWNERSHIP, F.col("o")).alias("ownership"), "evidence")
    return both.withColumn("flow", F.substring(F.sha2(F.concat_ws("|", "process", "peer", "interaction"), 256), 1, 16))


def entry_points(sites: DataFrame, owned: DataFrame, rules: DataFrame) -> DataFrame:
    """(process, site, interaction, basis): the sites at which something comes in."""
    inward = rules.filter("direction = 'inbound'").select("interaction")
    return sites.join(inward, "interaction", "left_semi").join(owned.filter("process IS NOT NULL").select("site", "process").hint("merge"), "site").select("process", "site", "interaction", "basis").distinct()


def unknowns(processes: DataFrame, found: DataFrame, folded: DataFrame, libraries: DataFrame, sites: DataFrame, owned: DataFrame) -> DataFrame:
    """(kind, subject, n): what the evidence leaves open, by name: roles, boundaries, stores, unlinked libraries, unowned sites by folder."""
    named = lambda df, kind, subject: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), F.lit(1).cast("long").alias("n"))
    crossing = found.filter("boundary IS NOT NULL").select("process").distinct()
    network = found.filter("boundary = 'network'").select("process").distinct()
    out = named(processes, "deployment_not_described", F.col("process")).union(named(processes.join(crossing, "process", "left_anti"), "boundary_not_established", F.col("process")))
    for kind in ("peer_unidentified", "protocol_unknown", "authentication_not_located"):
        out = out.union(named(network, kind, F.col("process")))
    stores = found.filter("peer LIKE 'store:%'").select(F.concat_ws("|", "process", "peer").alias("store")).distinct()
    out = out.union(named(stores, "datastore_unidentified", F.col("store")))
    out = out.union(named(libraries.join(folded.select("library").distinct(), "library", "left_anti"), "runtime_role_unknown", F.col("library")))
    lost = owned.groupBy("site").agg(F.count("process").alias("n")).filter("n = 0").select("site")
    segment = F.coalesce(F.substring_index("path", "/", 1), F.lit("an unstated path"))
    unowned = sites.join(lost.hint("merge"), "site", "left_semi").groupBy(F.concat_ws("|", "interaction", segment).alias("subject")).agg(F.count("*").alias("n"))
    return out.union(unowned.select(F.lit("flow_endpoint_unresolved"), "subject", "n"))


def threats(found: DataFrame, templates: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(threat, template, flow, boundary): a candidate for every template that asks about a flow across a boundary, by identity, and whether more were cut.

    ``templates``: template, interaction, boundary, direction. An equi-join on what a template asks about; no pair without it is formed.
    """
    met = found.filter("boundary IS NOT NULL").join(templates, ["interaction", "boundary", "direction"])
    named = met.select(F.substring(F.sha2(F.concat_ws("|", "template", "flow"), 256), 1, 16).alias("threat"), "template", "flow", "boundary").distinct()
    kept = named.orderBy("threat", "template", "flow").limit(most)
    return kept, named.count() > most
