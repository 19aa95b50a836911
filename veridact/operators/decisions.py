"""Decision tables over evidence: the first row that holds decides, and every reason and gap is named."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities, weakest first, and what the tables below are made of.
SEVERITIES = ("low", "medium", "high", "critical")
CONTRADICTION_STATES = (
    ("source_to_sink_reachability", "not_reachable"),
    ("configuration_enables", "not_exploitable_in_observed_configuration"),
)
REACHABLE = ("symbol_reachable", "reachable", "confirmed_reachable", "call_path_reachable")
UNREACHABLE = ("unreachable_in_target",)
CRITICAL_CWES = ("CWE-77", "CWE-78", "CWE-89", "CWE-94", "CWE-119", "CWE-120", "CWE-121", "CWE-122", "CWE-416", "CWE-502", "CWE-611", "CWE-787")
HIGH_CWES = CRITICAL_CWES + ("CWE-22", "CWE-269", "CWE-284", "CWE-285", "CWE-287", "CWE-306", "CWE-862", "CWE-863", "CWE-918")
CRITICAL_WORDS = (
    "command_injection", "code_injection", "remote_code_execution", "sql_injection", "deserialization", "memory_corruption",
    "buffer_overflow", "heap_overflow", "stack_overflow", "use_after_free", "arbitrary_file_write", "xxe",
)
HIGH_WORDS = CRITICAL_WORDS + (
    "privilege_escalation", "authz_bypass", "authorization_bypass", "authn_bypass", "authentication_bypass", "path_traversal",
    "arbitrary_file_read", "ssrf", "secret_exposure", "credential_exposure", "token_forgery", "account_takeover",
)
PIVOT_WORDS = ("drift", "spec", "ssrf", "bypass", "disclosure", "leak", "exposure", "redirect", "config", "idor", "traversal")
PIVOTS = ("broken_access_control", "missing_authentication", "missing_authorization", "csrf")
IMPACTS = {
    "execute unauthorized code or commands": "critical",
    "modify memory": "high", "gain privileges or assume identity": "high", "bypass protection mechanism": "high",
    "modify application data": "high", "modify files or directories": "high",
    "read memory": "medium", "read application data": "medium", "read files or directories": "medium", "alter execution logic": "medium",
    "dos: crash, exit, or restart": "medium", "dos: instability": "medium", "dos: amplification": "medium",
    "dos: resource consumption (cpu)": "medium", "dos: resource consumption (memory)": "medium", "dos: resource consumption (other)": "medium",
    "hide activities": "low", "unexpected state": "low", "quality degradation": "low",
    "reduce performance": "low", "reduce reliability": "low", "reduce maintainability": "low",
}
READ_IMPACTS = ("read memory", "read application data", "read files or directories")
#: Impact by exploitability: a weakness's own impact, then how exploitable it is.
RISK_MATRIX = {
    "critical": {"low": "medium", "medium": "high", "high": "critical"},
    "high": {"low": "low", "medium": "medium", "high": "high"},
    "medium": {"low": "low", "medium": "low", "high": "medium"},
    "low": {"low": "low", "medium": "low", "high": "low"},
}
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
NEGATED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}


def _map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def _any_in(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def adjudicate(claims: DataFrame, relations: DataFrame, required: DataFrame, existing: DataFrame) -> DataFrame:
    """(claim_id, deciding_row, state, duplicate_of, gaps): the first row of the table that holds for each claim.

    ``claims``: claim_id, duplicate_of, affected and scope (arrays), verifier_independent. ``relations``: claim_id, predicate,
    kind (supports or contradicts), counted. ``required``: claim_id, predicate. ``existing``: claim_id of claims decided earlier.
    A required predicate with counted support and no counted contradiction is satisfied, the reverse contradicted, both
    conflicted, neither unresolved. Uncounted relations decide nothing. A claim that requires nothing is confirmed if its verifier is
    independent. Unresolved predicates of a claim that isn't settled, and conflicted ones, are gaps.
    """
    counted = relations.filter("counted").groupBy("claim_id", "predicate").agg(F.bool_or(F.col("kind") == "supports").alias("has"), F.bool_or(F.col("kind") == "contradicts").alias("against"))
    has, against = F.coalesce("has", F.lit(False)), F.coalesce("against", F.lit(False))
    outcome = F.when(has & against, "conflicted").when(has, "satisfied").when(against, "contradicted").otherwise("unresolved")
    judged = required.distinct().join(counted, ["claim_id", "predicate"], "left").select("claim_id", "predicate", outcome.alias("outcome"))
    by = judged.groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("predicate", "outcome"))).alias("outcomes"))
    known = existing.select("claim_id").distinct()
    marked = (
        claims.join(by, "claim_id", "left").join(known.withColumn("seen", F.lit(True)), "claim_id", "left")
        .join(known.select(F.col("claim_id").alias("duplicate_of"), F.lit(True).alias("original")), "duplicate_of", "left")
    )

    def having(value: str) -> Column:
        return F.coalesce(F.array_sort(F.map_keys(F.map_filter("outcomes", lambda _, o: o == value))), F.array().cast("array<string>"))

    outside = F.size(F.array_intersect("affected", "scope")) == 0
    row = (
        F.when(F.coalesce("seen", "original", F.lit(False)), "r1_duplicate").when(outside, "r2_out_of_scope")
        .when(F.size(having("conflicted")) > 0, "r3_unresolved_contradiction").when(F.size(having("contradicted")) > 0, "r4_direct_contradiction")
        .when((F.size(having("unresolved")) == 0) & F.col("verifier_independent"), "r5_confirmed")
        .when(F.size(having("satisfied")) > 0, "r6_supported").otherwise("r7_insufficient_evidence")
    )
    against_state = F.coalesce(*[F.when(F.array_contains(having("contradicted"), p), F.lit(s)) for p, s in CONTRADICTION_STATES], F.lit("contradicted"))
    states = {"r1_duplicate": "duplicate", "r2_out_of_scope": "out_of_scope", "r3_unresolved_contradiction": "insufficient_evidence", "r5_confirmed": "confirmed", "r6_supported": "supported", "r7_insufficient_evidence": "insufficient_evidence"}
    gaps = (
        F.when(F.col("deciding_row") == "r3_unresolved_contradiction", F.transform(having("conflicted"), lambda p: F.concat(F.lit("unresolved_contradiction:"), p)))
        .when(F.col("deciding_row").isin("r6_supported", "r7_insufficient_evidence"), F.transform(having("unresolved"), lambda p: F.concat(F.lit("missing_direct_evidence:"), p)))
        .otherwise(F.array().cast("array<string>"))
    )
    decided = marked.withColumn("deciding_row", row)
    original = F.when(F.col("deciding_row") == "r1_duplicate", F.when(F.coalesce("original", F.lit(False)), F.col("duplicate_of")).otherwise(F.col("claim_id")))
    state = F.when(F.col("deciding_row") == "r4_direct_contradiction", against_state).otherwise(_map(states)[F.col("deciding_row")])
    return decided.select("claim_id", "deciding_row", state.alias("state"), original.alias("duplicate_of"), gaps.alias("gaps"))


def ship_block(
    state: Column, severity: Column, families: Column, kev: Column, distinct: Column, missing: Column,
    blocking: Sequence[str] = ("high", "critical"), dependency: Sequence[str] = ("sca",), kev_blocks: bool = True, require_distinct: bool = True,
) -> Column:
    """struct<status, reasons> of a finding. Qualifying findings decide before a missing input leaves the decision pending."""
    severe = F.coalesce(severity.isin(*blocking), F.lit(False))
    listed = F.lit(kev_blocks) & F.arrays_overlap(families, F.array(*[F.lit(d) for d in dependency])) & F.coalesce(kev, F.lit(False))
    held = F.lit(not require_distinct) | distinct
    publishable = state.isin("confirmed", "supported")
    qualifies, pending = severe | listed, publishable & (severity.isNull() | (F.size(missing) > 0))
    status = (
        F.when((state == "confirmed") & qualifies & held, "ship_blocking").when((state == "confirmed") & qualifies, "pending_distinct_verification")
        .when((state == "supported") & qualifies, "needs_verification").when(pending, "decision_pending").otherwise("not_ship_blocking")
    )
    reasons = F.concat(
        F.array_compact(F.array(
            F.when(severe, F.concat(F.lit("technical_severity_"), severity)), F.when(listed, F.lit("kev_listed_dependency")),
            F.when(severity.isNull() & publishable, F.lit("technical_severity_unrated")),
        )),
        F.when(publishable, F.transform(F.array_sort(missing), lambda m: F.concat(F.lit("missing_factor_"), m))).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(status == "pending_distinct_verification", F.lit("verifier_model_not_distinct")), F.when(status == "needs_verification", F.lit("claim_not_confirmed")))),
    )
    return F.struct(status.alias("status"), reasons.alias("reasons"))


def vex_status(reachability: Column, gaps: Column, run_has_gaps: Column) -> Column:
    """struct<status, justification, gap_reasons>: not_affected only if unreachable under full coverage; doubt is under investigation."""
    reach = F.lower(F.trim(F.coalesce(reachability, F.lit(""))))
    reasons = F.array_distinct(F.concat(gaps, F.when(run_has_gaps, F.array(F.lit("run_coverage_gaps"))).otherwise(F.array().cast("array<string>"))))
    status = F.when(reach.isin(*REACHABLE), "affected").when(reach.isin(*UNREACHABLE) & (F.size(reasons) == 0), "not_affected").otherwise("under_investigation")
    unexplained = F.array(F.when(reach != "", reach).otherwise(F.lit("coverage_unverified")))
    return F.struct(
        status.alias("status"), F.when(status == "not_affected", F.lit("vulnerable_code_not_in_execute_path")).alias("justification"),
        F.when((status == "under_investigation") & (F.size(reasons) == 0), unexplained).otherwise(reasons).alias("gap_reasons"),
    )


def publication_bucket(state: Column, partition: Column, withheld: Column) -> Column:
    """publishable, verification_backlog or withheld; a package that isn't partitioned under its state raises an error."""
    wrong = F.raise_error(F.concat(F.lit("not in the partition of its state: "), F.coalesce(state, F.lit("null")))).cast("string")
    return (
        F.when(F.size(withheld) > 0, F.lit("withheld")).when((state == "confirmed") & (partition == "confirmed"), F.lit("publishable"))
        .when((state == "supported") & (partition == "supported"), F.lit("verification_backlog")).otherwise(wrong)
    )


def crash_binding(reports: DataFrame, key: str, build_ids: DataFrame, revision: Column, functions: DataFrame | None, paths: DataFrame | None) -> DataFrame:
    """(key, tier, matched_frames, reasons): build, revision, symbol or unbound, the strongest that holds.

    ``reports``: key, modules (array of struct with debug_id and code_id), changelist, version, frames (array of struct with function
    and file). Identifiers compare without case or punctuation. Without any symbols the symbol tier can't be told, which
    differs from no match. Ids, functions and paths are joined, not collected.
    """

    def plain(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, "[^0-9A-Za-z]", ""))

    ids = build_ids.select(plain(F.col("debug_id")).alias("own")).filter("own <> ''").distinct()
    modules = reports.select(key, F.explode("modules").alias("m"))
    named = modules.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), plain(F.col(f"m.{f}")).alias("own")) for f in ("debug_id", "code_id")])).alias("x")).select(key, "x.*")
    built = named.join(ids, "own", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(F.concat("field", F.lit("_matched")))).alias("built"))
    frames = reports.select(key, F.posexplode("frames").alias("at", "f")).select(key, "at", "f.function", "f.file")
    met = None
    for other, column, reason in ((functions, "function", "function_matched"), (paths, "file", "file_matched")):
        if other is not None:
            hit = frames.join(other.select(F.col(other.columns[0]).alias(column)).distinct(), column, "left_semi").select(key, "at", F.lit(reason).alias("why"))
            met = hit if met is None else met.union(hit)
    out = reports.join(built, key, "left")
    if met is not None:
        found = met.groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.collect_set("why")).alias("why"))
        out = out.join(found, key, "left")
    else:
        out = out.withColumns({"at": F.lit(None).cast("array<int>"), "why": F.lit(None).cast("array<string>")})
    revised = F.array_compact(F.array(*[F.when(F.col(c) == revision, F.lit(f"{c}_matched")) for c in ("changelist", "version")]))
    tier = F.when(F.col("built").isNotNull(), "build_matched").when(F.size(revised) > 0, "revision_matched").when(F.col("at").isNotNull(), "symbol_matched").otherwise("unbound")
    why = F.when(tier == "build_matched", F.col("built")).when(tier == "revision_matched", revised).when(tier == "symbol_matched", F.col("why")).otherwise(F.array(F.lit("no_match" if met is not None else "symbols_unavailable")))
    return out.select(key, tier.alias("tier"), F.when(tier == "symbol_matched", F.col("at")).otherwise(F.array().cast("array<int>")).alias("matched_frames"), why.alias("reasons"))


def guard_bound(guard: Column) -> Column:
    """struct<bounded, reason> of a guard (state, constrains, object_bytes, operator, left, right, polarity).

    ``left`` and ``right`` are constants, null where an operand isn't one. The comparison, read as operand against constant on the
    branch taken, has to bound the operand from above within the destination's bytes.
    """
    operator, polarity = guard["operator"], guard["polarity"]
    limit = F.coalesce(guard["right"], guard["left"])
    relation = F.when(guard["right"].isNotNull(), operator).otherwise(_map(FLIPPED)[operator])
    taken = F.when(polarity == "false_branch", _map(NEGATED)[relation]).otherwise(relation)
    allowed = F.when(taken == "<", guard["object_bytes"] + 1).otherwise(guard["object_bytes"])
    reason = (
        F.when(~guard["state"].eqNullSafe("dominating"), "not_dominating").when(~guard["constrains"].eqNullSafe(True), "operand_not_constrained")
        .when(guard["object_bytes"].isNull() | (guard["object_bytes"] <= 0), "destination_size_unknown")
        .when(operator.isNull() | ~operator.isin(*FLIPPED), "operator_unknown").when(polarity.isNull() | ~polarity.isin("true_branch", "false_branch"), "polarity_unknown")
        .when(guard["left"].isNotNull() & guard["right"].isNotNull(), "both_constant").when(limit.isNull(), "no_constant")
        .when(~taken.isin("<", "<=", "=="), "no_upper_bound").when(limit > allowed, "exceeds_destination")
    )
    return F.struct(reason.isNull().alias("bounded"), F.coalesce(reason, F.concat_ws(" ", F.lit("n"), taken, limit.cast("string"))).alias("reason"))


def risk_interval(factors: Mapping[str, Column], points: Mapping[str, Mapping[str, int]], medium: int, high: int) -> Column:
    """struct<known, floor, ceiling, rating, unresolved>: points of known factors, and the range that missing ones leave open.

    A missing factor adds its least points to the floor and its most to the ceiling; there is a rating only if both ends agree.
    """
    known = floor = ceiling = F.lit(0)
    open_ = []
    for name in sorted(points):
        table = points[name]
        low, top = min(table.values()), max(table.values())
        own = _map(table)[factors[name]]
        known, floor, ceiling = known + F.coalesce(own, F.lit(0)), floor + F.coalesce(own, F.lit(low)), ceiling + F.coalesce(own, F.lit(top))
        if low != top:
            open_.append(F.when(own.isNull(), F.lit(name)))

    def band(p: Column) -> Column:
        return F.when(p >= high, "high").when(p >= medium, "medium").otherwise("low")

    unresolved = F.array_compact(F.array(*open_)) if open_ else F.array().cast("array<string>")
    return F.struct(known.alias("known"), floor.alias("floor"), ceiling.alias("ceiling"), F.when(band(floor) == band(ceiling), band(floor)).alias("rating"), unresolved.alias("unresolved"))


def technical_severity(impact: Column, exploitability: Column) -> Column:
    """The matrix's severity; null if either side is unrated."""
    return F.coalesce(*[F.when(impact == i, _map(row)[exploitability]) for i, row in RISK_MATRIX.items()])


def cwe_impact(consequences: DataFrame, key: str) -> DataFrame:
    """(key, impact, raised): a weakness's class is the strongest of its consequences' mapped impacts.

    ``consequences``: key, scopes and impacts (arrays). Reading is raised to high where a consequence of integrity has an impact that
    isn't rated low. A weakness without any mapped impact has none.
    """

    def clean(c: Column) -> Column:
        return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))

    ranks = {i: SEVERITIES.index(s) for i, s in IMPACTS.items()}
    low = F.transform("impacts", lambda i: F.coalesce(_map(IMPACTS)[clean(i)], F.lit("none")))
    integrity = F.exists("scopes", lambda s: clean(s) == "integrity") & ~F.forall(low, lambda s: s == "low")
    marked = consequences.withColumn("integral", F.bool_or(integrity).over(Window.partitionBy(key)))
    one = marked.select(key, "integral", F.explode("impacts").alias("impact")).select(key, "integral", clean(F.col("impact")).alias("impact"))
    raised = F.col("integral") & F.col("impact").isin(*READ_IMPACTS)
    scored = one.filter(F.col("impact").isin(*IMPACTS)).select(key, F.when(raised, F.lit(2)).otherwise(_map(ranks)[F.col("impact")]).alias("rank"), raised.alias("raised"))
    best = scored.groupBy(key).agg(F.max("rank").alias("rank"), F.max_by(F.struct("rank", "raised"), F.struct("rank", "raised")).alias("top"))
    return best.select(key, F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank")).alias("impact"), F.col("top.raised").alias("raised"))


def chain_severity(steps: Column, dimensions: Column, most_steps: int = 6) -> Column:
    """struct<severity, crossings>: the severity of findings in a chain, raised where they cross boundaries to a strong sink.

    ``steps``: array of struct (unit, boundary, predicate, cwe, severity, drift). ``dimensions``: for each edge, the names of what the
    edge is known to satisfy. Crossings are ``edge:kind``, each once. A chain of one step, or too many, has neither; an unrated
    step leaves the severity null.
    """

    def predicate(s: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(F.coalesce(s["predicate"], F.lit("")))), "[- ]", "_")

    def cwe(s: Column, cwes: Sequence[str]) -> Column:
        return F.coalesce(F.upper(s["cwe"]).isin(*cwes), F.lit(False))

    def critical(s: Column) -> Column:
        return cwe(s, CRITICAL_CWES) | _any_in(predicate(s), CRITICAL_WORDS)

    def strong(s: Column) -> Column:
        return critical(s) | cwe(s, HIGH_CWES) | _any_in(predicate(s), HIGH_WORDS)

    def pivot(s: Column) -> Column:
        return s["drift"] | _any_in(predicate(s), PIVOT_WORDS) | predicate(s).isin(*PIVOTS)

    def text(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    def edge(k: Column) -> Column:
        a, b = F.get(steps, k), F.get(steps, k + 1)
        known = F.coalesce(F.get(dimensions, k), F.array().cast("array<string>"))
        trust = ((text(a["boundary"]) != "") & (text(b["boundary"]) != "") & (text(a["boundary"]) != text(b["boundary"]))) | F.array_contains(known, "trust_boundary")
        drift = a["drift"] | predicate(a).contains("drift")
        privilege = F.array_contains(known, "privilege") | (pivot(a) & (predicate(b).contains("privilege") | strong(b)) & ~trust & ~drift)
        unit = (text(a["unit"]) != "") & (text(b["unit"]) != "") & (a["unit"] != b["unit"])
        kinds = F.array(F.when(trust, "trust_boundary"), F.when(drift, "spec_drift_pivot"), F.when(privilege, "privilege_boundary"), F.when(unit, "cross_unit"))
        return F.transform(F.array_compact(kinds), lambda kind: F.concat(k.cast("string"), F.lit(":"), kind))

    n = F.size(steps)
    usable = (n >= 2) & (n <= most_steps)
    crossings = F.when(usable, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), edge))).otherwise(F.array().cast("array<string>"))
    rank = F.transform(steps, lambda s: F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), s["severity"]))
    base = F.array_max(rank)
    unrated = F.exists(rank, lambda r: r.isNull() | (r == 0))
    bounded = F.exists(crossings, lambda c: c.rlike("boundary|pivot|unit"))
    two = F.size(F.filter(rank, lambda r: r >= 2)) >= 2
    later, earlier = F.slice(steps, F.lit(2), n - 1), F.slice(steps, F.lit(1), n - 1)
    to_critical, to_strong, from_pivot = F.exists(later, critical), F.exists(later, strong), F.exists(earlier, pivot)
    raised = (
        F.when(to_critical & (from_pivot | (base == 3) | (n >= 3)), F.lit(4)).when((n >= 3) & (F.size(crossings) >= 2) & to_strong, F.lit(4))
        .when((base == 3) & to_strong, F.lit(4)).when(from_pivot | to_strong | (n >= 3), F.greatest(base, F.lit(3)))
    )
    level = F.when(base == 4, F.lit(4)).when(two & bounded, F.coalesce(raised, base)).otherwise(base)
    severity = F.when(usable & ~unrated, F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), level.cast("int")))
    return F.struct(severity.alias("severity"), F.slice(crossings, 1, 16).alias("crossings"))


def independence_gaps(verifiers: DataFrame, actors: DataFrame, support: DataFrame, required: DataFrame, distinct_provider: bool = False) -> DataFrame:
    """(claim_id, independent, gaps): whether a claim's verifier is independent of its other actors, and why not.

    ``verifiers``: claim_id, actor_id, conversation_id, cache_key, prior_response, provider, request (text, null if it can't be checked).
    ``actors``: the same for every other actor of the claim. ``support`` and ``required``: claim_id, predicate, where support is of
    receipts that the verifier fetched itself. One gap per failure, by name.
    """
    v = verifiers.select("claim_id", *[F.col(c).alias(f"v_{c}") for c in ("actor_id", "conversation_id", "cache_key", "prior_response", "provider", "request")])
    both = v.join(actors.withColumn("other", F.lit(True)), "claim_id", "left")
    fails = {
        "verifier_actor_not_distinct": F.col("actor_id") == F.col("v_actor_id"),
        "verifier_conversation_has_prior_response": F.col("v_prior_response").isNotNull(),
        "verifier_conversation_not_fresh": (F.coalesce("v_conversation_id", F.lit("")) == "") | (F.col("conversation_id") == F.col("v_conversation_id")),
        "verifier_shares_cache_entry": F.col("cache_key") == F.col("v_cache_key"),
        "verifier_request_check_unavailable": F.col("v_request").isNull(),
        "verifier_request_contains_forbidden_marker": F.col("v_request").contains(F.col("actor_id")),
    }
    if distinct_provider:
        fails["verifier_provider_not_distinct"] = F.col("provider") == F.col("v_provider")
    per = both.groupBy("claim_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in fails.items()])
    lacking = required.distinct().join(support, ["claim_id", "predicate"], "left_anti").groupBy("claim_id").agg(
        F.collect_set(F.concat(F.lit("verifier_lacks_independent_support:"), "predicate")).alias("lacking")
    )
    named = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in fails]))
    gaps = F.array_sort(F.concat(named, F.coalesce("lacking", F.array().cast("array<string>"))))
    return per.join(lacking, "claim_id", "left").select("claim_id", gaps.alias("gaps")).withColumn("independent", F.size("gaps") == 0)


def route_persona(leads: DataFrame, key: str, covers: DataFrame, fallback: str = "generalist") -> DataFrame:
    """(key, persona, basis): the owner of a lead's CWE, else of its location tags, else of its component tags, else ``fallback``.

    ``leads``: key, cwe, location_tags (array), component_tags (map of tag to weight). ``covers``: persona, pattern; a pattern is a
    tag or a prefix of one that ends in ``*``. A tag belongs to one persona: that of the most specific pattern (exact, then
    longest prefix), ties by name. Tags of one basis vote with their weights. Patterns are joined on the prefixes of tags.
    """
    wild = F.col("pattern").endswith("*")
    rules = covers.select("persona", F.when(wild, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(F.col("pattern")).alias("own"), (~wild).alias("exact"))
    one = F.transform("location_tags", lambda t: F.struct(F.lit(1).alias("basis"), t.alias("tag"), F.lit(1.0).alias("weight")))
    two = F.transform(F.map_entries("component_tags"), lambda e: F.struct(F.lit(2).alias("basis"), e["key"].alias("tag"), e["value"].cast("double").alias("weight")))
    own = F.array(F.struct(F.lit(0).alias("basis"), F.col("cwe").alias("tag"), F.lit(1.0).alias("weight")))
    empty = F.array().cast("array<struct<basis:int,tag:string,weight:double>>")
    tags = leads.select(key, F.explode(F.concat(own, F.coalesce(one, empty), F.coalesce(two, empty))).alias("t")).select(key, "t.*").filter("tag IS NOT NULL AND weight > 0").distinct()
    names = tags.select("tag").distinct()
    starts = names.select("tag", F.explode(F.transform(F.sequence(F.lit(0), F.length("tag")), lambda n: F.substring(F.col("tag"), F.lit(1), n))).alias("own"))
    met = starts.join(rules, "own").filter(~F.col("exact") | (F.col("own") == F.col("tag")))
    owners = met.groupBy("tag").agg(F.min_by("persona", F.struct((~F.col("exact")).alias("a"), (-F.length("own")).alias("b"), "persona")).alias("persona"))
    votes = tags.join(owners, "tag").groupBy(key, "basis", "persona").agg(F.sum("weight").alias("weight"))
    best = votes.groupBy(key).agg(F.min_by(F.struct("basis", "persona"), F.struct("basis", -F.col("weight"), "persona")).alias("best"))
    basis = F.get(F.array(F.lit("lead_cwe"), F.lit("location_tags"), F.lit("component_tags")), F.col("best.basis"))
    return leads.select(key).join(best, key, "left").select(key, F.coalesce("best.persona", F.lit(fallback)).alias("persona"), F.coalesce(basis, F.lit("generalist")).alias("basis"))


def required_predicates(claims: DataFrame, families: DataFrame, required: DataFrame, configuration: Sequence[str], build_kinds: Sequence[str]) -> DataFrame:
    """(claim_id, predicate): what a claim has to prove: its family's predicates, and that the configuration enables it if it says so.

    ``claims``: claim_id, security_predicate, cwe, preconditions and affected (arrays; an entity begins with its kind and a colon).
    ``families``: by (cwe) or (security_predicate), family; a CWE wins; unlisted claims are of the family ``default``. ``required``: family,
    predicate. Preconditions in ``configuration``, or entities of ``build_kinds``, add ``configuration_enables``.
    """
    by_cwe = families.filter("cwe IS NOT NULL").select("cwe", F.col("family").alias("a"))
    by_predicate = families.filter("security_predicate IS NOT NULL").select("security_predicate", F.col("family").alias("b"))
    of = claims.join(by_cwe, "cwe", "left").join(by_predicate, "security_predicate", "left").withColumn("family", F.coalesce("a", "b", F.lit("default")))
    base = of.join(required, "family").select("claim_id", "predicate")
    built = F.exists("affected", lambda e: F.substring_index(e, ":", 1).isin(*build_kinds))
    extra = of.filter(F.arrays_overlap("preconditions", F.array(*[F.lit(c) for c in configuration])) | built)
    return base.union(extra.select("claim_id", F.lit("configuration_enables"))).distinct()
