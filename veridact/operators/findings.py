"""Findings joined with what is known about them, scored, deduplicated, ranked and shared out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined_by_scope(items: DataFrame, history: DataFrame, values: Sequence[str]) -> DataFrame:
    """``items`` with values of the history of their file or, for functions, of exactly their bytes, and ``gap`` where there is none.

    ``items``: scope, path, start, end. ``history``: kind (file or symbol), path, start, end, values. Two equi-joins, each row in one of
    them; a function's missing history isn't replaced by its file's.
    """
    cols = [F.col(v).alias(f"h_{v}") for v in values]
    files = history.filter("kind = 'file'").select("path", F.lit(True).alias("met"), *cols)
    symbols = history.filter("kind = 'symbol'").select("path", "start", "end", F.lit(True).alias("met"), *cols)
    own = items.filter("scope = 'function'").join(symbols, ["path", "start", "end"], "left")
    rest = items.filter("scope IS DISTINCT FROM 'function'").join(files, "path", "left")
    both = own.unionByName(rest)
    return both.select(*items.columns, *[F.col(f"h_{v}").alias(v) for v in values], F.when(F.col("met").isNull(), F.lit("history_scope_unmatched")).alias("gap"))


def sink_class(check: Column, prefixes: Sequence[str], classes: Mapping[str, str]) -> Column:
    """The class of a checker's name without its analyzer's prefix; null if the table has none."""
    plain = check
    for p in prefixes:
        plain = F.when(check.startswith(p), F.substring(check, len(p) + 1, 1 << 20)).otherwise(plain)
    return F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])[plain]


def corroborated(diagnostics: DataFrame, sinks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Diagnostics in a sink of their class on their line; sinks that they suggest; and how many have no class, by check.

    ``diagnostics``: diagnostic, check, class, path, line, offset; ``sinks``: sink, class, path, start_line, end_line. First (sink,
    diagnostics); then (path, offset, class, diagnostics) of those that meet no sink; last (check, n). Spans are joined by line, a row per line.
    """
    mapped = diagnostics.filter("class IS NOT NULL AND line IS NOT NULL")
    lines = sinks.select("sink", "class", "path", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    met = mapped.join(lines, ["class", "path", "line"])
    found = met.groupBy("sink").agg(F.array_sort(F.collect_set("diagnostic")).alias("diagnostics"))
    rest = mapped.join(met.select("diagnostic").distinct(), "diagnostic", "left_anti").groupBy("path", "offset", "class").agg(F.array_sort(F.collect_set("diagnostic")).alias("diagnostics"))
    unmapped = diagnostics.filter("class IS NULL").groupBy(F.coalesce(F.nullif("check", F.lit("")), F.lit("(unnamed)")).alias("check")).agg(F.count("*").alias("n"))
    return found, rest, unmapped


def effectiveness(leads: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., level, true_leads, false_leads, kept, dropped, retention, removal) over admitted leads, in all and by each column alone.

    ``leads``: lead, status (survived, removed or else unresolved), admitted; ``labels``: lead, outcome (true or false). An unresolved
    lead is in neither denominator; a ratio without denominator is null. ``level`` names the column, null for all.
    """
    rows = leads.filter("admitted").join(labels.select("lead", "outcome"), "lead", "left")
    yes, no = F.col("outcome") == "true", F.col("outcome") == "false"
    kept, gone = F.col("status") == "survived", F.col("status") == "removed"
    measures = [F.count_if(yes).alias("true_leads"), F.count_if(no).alias("false_leads"), F.count_if(yes & kept).alias("true_kept"), F.count_if(yes & gone).alias("true_gone"), F.count_if(no & kept).alias("false_kept"), F.count_if(no & gone).alias("false_gone")]
    sets = [[], *[[F.col(b)] for b in by]]
    level = F.coalesce(*[F.when(F.grouping(b) == 0, F.lit(b)) for b in by])
    g = rows.groupingSets(sets, *[F.col(b) for b in by]).agg(*measures, level.alias("level"))
    return g.withColumns({
        "retention": F.try_divide("true_kept", F.col("true_kept") + F.col("true_gone")), "removal": F.try_divide("false_gone", F.col("false_kept") + F.col("false_gone")),
    })


def duplicates(leads: DataFrame, packs: Mapping[str, str], severities: Sequence[str]) -> DataFrame:
    """``leads`` with ``duplicate_of`` and ``method``: leads on one line are alike by their CWEs, or without any by rule and family of scanner.

    ``leads``: lead, path, line, cwes (sorted array), scanner, rule, severity. The canonical lead is the most severe, then the first
    by id; scanners that share a rule pack are one family. A lead without a path is like none.
    """
    family = F.coalesce(F.create_map(*[F.lit(x) for pair in packs.items() for x in pair])[F.col("scanner")], F.col("scanner"))
    key = F.when(F.size("cwes") > 0, F.concat(F.lit("cwe|"), F.array_join("cwes", ","))).otherwise(F.concat_ws("|", F.lit("rule"), family, F.col("rule")))
    rank = F.array_position(F.array(*[F.lit(s) for s in severities]), F.col("severity"))
    alike = Window.partitionBy("path", "line", "like")
    marked = leads.withColumn("like", F.when(F.col("path").isNotNull(), key).otherwise(F.concat(F.lit("none|"), "lead"))).withColumn("rank", rank)
    first = F.first("lead").over(alike.orderBy("rank", "lead").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    several = F.size(F.collect_set("scanner").over(alike)) > 1
    method = F.when(F.size("cwes") > 0, "same_cwe").when(several, "shared_rule_pack").otherwise("same_rule")
    out = marked.withColumn("first", first).withColumn("how", method)
    other = F.col("first") != F.col("lead")
    return out.select(*leads.columns, F.when(other, F.col("first")).alias("duplicate_of"), F.when(other, F.col("how")).alias("method"))


def rule_scores(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per rule: how its findings (rule, path, line) meet its expectations (rule, path, line, positive, kind, exception).

    A positive that is found is a true positive, or a known false positive if it has an exception; a known false negative counts while it
    isn't found; any other negative is an exclusion, kept or violated; a finding nobody expects is a false positive.
    """
    hits = findings.select("rule", "path", "line").distinct().withColumn("hit", F.lit(True))
    met = expectations.join(hits, ["rule", "path", "line"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    hit, positive, known = F.col("hit"), F.col("positive"), F.col("kind") == "known-false-negative"
    tally = met.groupBy("rule").agg(
        F.count_if(positive & hit & F.col("exception").isNull()).alias("true_positives"), F.count_if(positive & ~hit).alias("false_negatives"), F.count_if(~positive & known & ~hit).alias("known_false_negatives"),
        F.count_if(positive & hit & F.col("exception").isNotNull()).alias("known_false_positives"), F.count_if(~positive & ~known & ~hit).alias("expected_exclusions"), F.count_if(~positive & ~known & hit).alias("violated_exclusions"),
    )
    stray = hits.join(expectations.select("rule", "path", "line").distinct(), ["rule", "path", "line"], "left_anti").groupBy("rule").agg(F.count("*").alias("false_positives"))
    names = ["true_positives", "false_negatives", "known_false_negatives", "false_positives", "known_false_positives", "expected_exclusions", "violated_exclusions"]
    return tally.join(stray, "rule", "full_outer").select("rule", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def merged_dependencies(rows: DataFrame, exposures: Sequence[str]) -> DataFrame:
    """One row per dependency: observations of one package URL, or of one name without it, in one version and ecosystem, merged.

    ``rows``: source, name, purl, version, ecosystem, direct, repository, exposure. Aliases are all names; direct if any observation says so,
    null if none says; the first known repository by source and itself; the greatest exposure, or the last of the list if none is known.
    Rows without a name are left out; their number is the caller's to report.
    """
    named = rows.filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    key = [F.col("purl"), F.when(F.col("purl").isNull(), F.col("name")).alias("own_name"), F.col("version"), F.col("ecosystem")]
    rank = F.array_position(F.array(*[F.lit(e) for e in exposures]), F.col("exposure"))
    g = named.groupBy(*key).agg(
        F.min_by("name", F.struct("source", "name")).alias("name"), F.array_sort(F.collect_set("name")).alias("aliases"), F.bool_or("direct").alias("direct"),
        F.min_by("repository", F.when(F.col("repository").isNotNull(), F.struct("source", "repository"))).alias("repository"), F.max(F.when(rank > 0, rank)).alias("rank"), F.count("*").alias("observations"),
    )
    exposure = F.coalesce(F.get(F.array(*[F.lit(e) for e in exposures]), (F.col("rank") - 1).cast("int")), F.lit(exposures[-1]))
    basis = F.when(F.col("rank").isNull(), "conservative-default").otherwise("maximum-observed-evidence")
    return g.select("name", "purl", "version", "ecosystem", "aliases", "direct", "repository", exposure.alias("exposure"), basis.alias("exposure_basis"), "observations")


def risk_first(findings: DataFrame, most: int) -> DataFrame:
    """``findings`` with tier, rank and selected: critical, high, raised by a chain, reachable medium, medium, low, informational, unrated.

    ``findings``: finding, claim, severity, composed, reachable, score. A chain raises what isn't critical or high if its composed
    severity is above the finding's own. Within a tier by score, then by finding and claim; the first ``most`` are selected. Ranks are
    given tier by tier, and a tier's offset is the sum of those before it, so no one task sorts all.
    """
    names = ["unknown", "informational", "low", "medium", "high", "critical"]
    level = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0)), F.lit(1))
    own = level("severity")
    tier = (
        F.when(own == 6, 0).when(own == 5, 1).when((level("composed") > own) & (level("composed") > 3), 2).when((own == 4) & F.coalesce("reachable", F.lit(False)), 3)
        .when(own == 4, 4).when(own == 3, 5).when(own == 2, 6).otherwise(7)
    )
    marked = findings.withColumn("tier", tier)
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.coalesce("score", F.lit(0.0)).desc(), F.coalesce("finding", F.lit("")), F.coalesce("claim", F.lit(""))))
    sizes = marked.groupBy("tier").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # eight rows at most
    ranked = marked.withColumn("place", place).join(F.broadcast(before), "tier").withColumn("rank", F.col("place") + F.col("before"))
    return ranked.drop("place", "before").withColumn("selected", F.col("rank") <= most)


def rank_points(units: DataFrame, weights: Mapping[str, int], full_sites: int = 4) -> Column:
    """Whole points of a unit: shares of full scores, saturating counts and hints, and flags, each at most its weight; what is unknown adds none.

    ``units`` has lps, sii, hotspot (0 to 1), sites, hints (struct of high, medium, low, info counts), kev, epss, exposed, tainted.
    """
    w = weights

    def scaled(share: Column, weight: int) -> Column:
        return F.floor(F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * weight).cast("long")

    flag = lambda c, weight: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(weight)).otherwise(F.lit(0))
    hints = F.least(F.lit(w["hints_max"]), sum((F.coalesce(F.col(f"hints.{k}"), F.lit(0)) * w[f"hint_{k}"] for k in ("high", "medium", "low", "info")), F.lit(0)))
    total = scaled(F.col("lps"), w["lps"]) + scaled(F.col("sii"), w["sii"]) + scaled(F.col("hotspot"), w["hotspot"]) + scaled(F.col("sites") / full_sites, w["sites"]) + hints
    return total + flag("kev", w["kev"]) + scaled(F.col("epss"), w["epss"]) + flag("exposed", w["exposed"]) + flag("tainted", w["tainted"])


def fair_share(packages: DataFrame, lead_share: float, total: int) -> DataFrame:
    """(lane, package, turn): the order in which two lanes' packages are taken, ``total`` at most.

    The next is of the lane that has used the smaller part of its share, the leads on ties; a lane past its share only goes on once the other
    has nothing queued. The n-th package of a lane comes when n of its share is used, so the order is a merge by that part, and what is
    beyond a share follows; no step depends on the one before.
    """
    share = {"lead": lead_share * total, "hunt": (1 - lead_share) * total}
    n = F.row_number().over(Window.partitionBy("lane").orderBy("rank", "package")) - 1
    own = F.when(F.col("lane") == "lead", F.lit(float(share["lead"]))).otherwise(F.lit(float(share["hunt"])))
    placed = packages.withColumn("n", n).filter(F.col("n") < total).withColumn("share", own)
    beyond = F.col("n") >= F.col("share")
    part = F.when(F.col("share") > 0, F.col("n") / F.col("share")).otherwise(F.lit(float("inf")))
    turn = F.row_number().over(Window.orderBy(beyond, part, F.when(F.col("lane") == "lead", 0).otherwise(1), "n"))  # twice `total` rows at most
    return placed.withColumn("turn", turn).filter(F.col("turn") <= total).select("lane", "package", "turn")


def binaries_of(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(unit, source, binary, via): the binaries that a source ends in: compiled, then linked, at most through one static library.

    ``objects``: unit, source, object; ``links``: unit, input, output, static. Of several ways the direct one, then the first by name.
    """
    first = objects.join(links.withColumnRenamed("input", "object"), ["unit", "object"])
    direct = first.filter("NOT static").select("unit", "source", F.col("output").alias("binary"), F.lit(None).cast("string").alias("via"))
    hop = links.filter("NOT static").select("unit", F.col("input").alias("via"), F.col("output").alias("binary"))
    through = first.filter("static").select("unit", "source", F.col("output").alias("via")).join(hop, ["unit", "via"]).select("unit", "source", "binary", "via")
    return direct.union(through).groupBy("unit", "source", "binary").agg(F.min_by("via", F.struct(F.col("via").isNotNull(), "via")).alias("via"))


def same_binary(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """``pairs`` (pair, unit, left, right) with ``binary`` where both sources end in exactly one binary in common, and ``state`` else."""
    a = pairs.join(ends.select("unit", F.col("source").alias("left"), "binary"), ["unit", "left"]).select("pair", "binary")
    b = pairs.join(ends.select("unit", F.col("source").alias("right"), "binary"), ["unit", "right"]).select("pair", "binary")
    common = a.intersect(b).groupBy("pair").agg(F.count("*").alias("n"), F.min("binary").alias("one"))
    state = F.when(F.col("n").isNull(), "not_shown").when(F.col("n") > 1, "ambiguous").otherwise("continuous")
    return pairs.join(common, "pair", "left").select(*pairs.columns, F.when(F.col("n") == 1, F.col("one")).alias("binary"), state.alias("state"))


def owned_paths(paths: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, dataset): the dataset whose claim is the longest prefix of a path; null without one, an error if two are equally long.

    ``claims``: prefix, dataset. Joined on all prefixes of a path, as text.
    """
    paths = paths.select("path").distinct()
    starts = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"))
    met = starts.join(claims.select("prefix", "dataset").distinct(), "prefix").withColumn("n", F.length("prefix"))
    best = met.groupBy("path").agg(F.max("n").alias("n")).join(met, ["path", "n"]).groupBy("path").agg(F.min("dataset").alias("dataset"), F.count("*").alias("k"))
    checked = F.when(F.col("k") > 1, F.raise_error(F.concat(F.lit("claimed twice: "), "path")).cast("string")).otherwise(F.col("dataset"))
    return paths.join(best.select("path", checked.alias("dataset")), "path", "left")


def memory_context(sites: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """(site, facts, omitted): what a points-to analysis says about a site's line, the first ``most`` facts by id, and how many more.

    Facts are counted once for each different set of lines that sites stand on, not for each site.
    """
    placed = sites.groupBy("site").agg(F.array_sort(F.collect_set(F.struct("path", "line"))).alias("places"))
    asked = placed.select("places").distinct().select("places", F.explode("places").alias("p")).select("places", "p.*")
    met = asked.join(facts.select("path", "line", "fact").distinct(), ["path", "line"]).select("places", "fact").distinct()
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("places").orderBy("fact")))
    first = F.when(F.col("place") <= most, F.col("fact"))
    found = ranked.groupBy("places").agg(F.array_sort(F.collect_list(first)).alias("facts"), F.count("*").alias("n"))
    return placed.join(found, "places", "left").select("site", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), F.greatest(F.coalesce("n", F.lit(0)) - most, F.lit(0)).alias("omitted"))


def rule_hits(files: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(file, rule, line, column): every place where a rule's pattern matches a line of a text, both counted from 1."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "value"))
    found = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(p).alias("pattern")) for name, p in rules])
    each = lines.select("file", (F.col("at") + 1).alias("line"), "value", F.explode(found).alias("r")).filter("value RLIKE r.pattern")
    spans = F.expr("split(value, r.pattern, -1)")
    texts = F.expr("regexp_extract_all(value, r.pattern, 0)")
    ends = F.transform(F.sequence(F.lit(1), F.size("texts")), lambda k: F.aggregate(F.slice("gaps", F.lit(1), k), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("texts", F.lit(1), k - 1), F.lit(0), lambda a, g: a + F.length(g)) + 1)
    return each.withColumns({"gaps": spans, "texts": texts}).select("file", F.col("r.rule").alias("rule"), "line", F.explode(ends).alias("column"))


def maximal_exposure(rows: DataFrame, key: str, terms: str, exposures: Mapping[str, str], order: Sequence[str], otherwise: str) -> DataFrame:
    """(key, exposure, basis): the greatest exposure that any of a row's terms stands for, else ``otherwise`` by default."""
    words = rows.select(key, F.explode_outer(terms).alias("term"))
    known = F.create_map(*[F.lit(x) for pair in exposures.items() for x in pair])[F.lower(F.trim("term"))]
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), known)
    g = words.groupBy(key).agg(F.max(rank).alias("rank"))
    return g.select(key, F.coalesce(F.get(F.array(*[F.lit(o) for o in order]), (F.col("rank") - 1).cast("int")), F.lit(otherwise)).alias("exposure"), F.when(F.col("rank").isNull(), "conservative-default").otherwise("maximum-observed-evidence").alias("basis"))


def hardening(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(binary, check, state): what a binary's family should have and has: met, unmet, unknown, or not_applicable.

    ``expected``: family, check, value (null: doesn't apply); ``observed``: binary, family, check, value (null: not measured).
    """
    binaries = observed.select("binary", "family").distinct()
    want = binaries.join(expected.withColumnRenamed("value", "wanted"), "family")
    met = want.join(observed.select("binary", "check", F.col("value").alias("seen")), ["binary", "check"], "left")
    state = F.when(F.col("wanted").isNull(), "not_applicable").when(F.col("seen").isNull(), "unknown").when(F.col("seen") == F.col("wanted"), "met").otherwise("unmet")
    return met.select("binary", "check", state.alias("state"))
