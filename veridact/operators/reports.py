"""What runs, tags, coverage and reviews amount to: spans, clouds, totals, admissibility, filters, tallies and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridact.functions.paths import glob_regex


def _map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def job_spans(events: DataFrame, terminals: Mapping[str, str], started: str = "JOB_STARTED") -> DataFrame:
    """(job, attempt, status, start_ms, end_ms, events) of every attempt, in ms since the first event of all; no end while it runs.

    ``events``: sequence, at, job, attempt, type; rows without a time are nothing. An attempt begins with its first start event, else
    with its first event; its last terminal event ends it, never before it begins.
    """
    timed = events.withColumn("at", F.col("at").cast("timestamp")).filter("at IS NOT NULL")
    origin = timed.agg(F.min("at").alias("origin")).first()["origin"]
    order = F.struct("sequence")
    end = F.col("type").isin(*terminals)
    g = timed.filter("job IS NOT NULL").groupBy("job", F.coalesce("attempt", F.lit("-")).alias("attempt")).agg(
        F.min("at").alias("first"), F.min_by("at", F.when(F.col("type") == started, order)).alias("begun"), F.max_by("at", F.when(end, order)).alias("ended"),
        F.max_by("type", F.when(end, order)).alias("how"), F.count("*").alias("events"),
    )
    ms = lambda c: (F.unix_micros(c) - F.unix_micros(F.lit(origin))) / 1000
    start = F.floor(ms(F.coalesce("begun", "first")))
    return g.select("job", "attempt", F.coalesce(_map(terminals)[F.col("how")], F.lit("RUNNING")).alias("status"), start.alias("start_ms"), F.when(F.col("ended").isNotNull(), F.greatest(start, F.floor(ms(F.col("ended"))))).alias("end_ms"), "events")


def tag_cloud(records: DataFrame, rollup: DataFrame, bases: Sequence[str]) -> DataFrame:
    """(node, family, subjects, components, assignments, strongest, derived_only, leaves, lenses): the cloud's nodes, sized by what they touch.

    ``records``: tag, subject, component, basis, lenses (array); ``rollup``: tag, node, family; an unlisted tag is its own node of the family
    other. Bases go from weakest to strongest.
    """
    met = records.join(rollup, "tag", "left").withColumns({"node": F.coalesce("node", "tag"), "family": F.coalesce("family", F.lit("other"))})
    rank = F.array_position(F.array(*[F.lit(b) for b in bases]), F.col("basis"))
    g = met.groupBy("node", "family").agg(
        F.count_distinct("subject").alias("subjects"), F.count_distinct("component").alias("components"), F.count("*").alias("assignments"), F.max(rank).alias("rank"),
        F.bool_and(F.col("basis") == "derived").alias("derived_only"), F.array_sort(F.collect_set("tag")).alias("leaves"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("lenses")))).alias("lenses"),
    )
    return g.withColumn("strongest", F.get(F.array(*[F.lit(b) for b in bases]), (F.col("rank") - 1).cast("int"))).drop("rank")


def coverage_totals(parts: DataFrame, kinds: Sequence[str] = ("lines", "branches", "functions")) -> DataFrame:
    """One row: totals, covered and rates over all parts (source, <kind>_total, <kind>_covered); a rate without total is null.

    A source that comes twice is an error, not a larger total.
    """
    per = parts.groupBy("source").agg(F.count("*").alias("n"), *[F.sum(f"{k}_{w}").alias(f"{k}_{w}") for k in kinds for w in ("total", "covered")])
    once = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("source comes twice: "), "source")).cast("long")).otherwise(F.lit(0))
    sums = per.withColumn("checked", once).agg(F.sum("checked").alias("checked"), *[F.sum(f"{k}_{w}").alias(f"{k}_{w}") for k in kinds for w in ("total", "covered")])
    rates = [F.round(F.try_divide(f"{k}_covered", f"{k}_total"), 8).alias(f"{k}_rate") for k in kinds]
    return sums.filter("checked = 0").select(*[f"{k}_{w}" for k in kinds for w in ("total", "covered")], *rates)


def ineligibility(exact: Column, coverage: Column, cross_check: Column, family: Column, sink_class: Column, source_class: Column, applies: Column) -> Column:
    """array of why a graph fact can't be used directly, in fixed order; an empty one means it can."""
    none = lambda c: F.coalesce(c, F.lit("unclassified")) == "unclassified"
    return F.array_compact(F.array(
        F.when(~F.coalesce(exact, F.lit(False)), "inexact_location"), F.when(F.coalesce(coverage, F.lit("")) != "complete", "incomplete_coverage"),
        F.when(~F.coalesce(cross_check.isin("agree", "not_covered"), F.lit(False)), F.concat(F.lit("cross_check_"), F.coalesce(cross_check, F.lit("missing")))),
        F.when((family == "sink_site") & none(sink_class), "unclassified_sink"), F.when((family == "entry_point") & none(source_class), "unclassified_source"),
        F.when((family == "range_fact") & ~F.coalesce(applies, F.lit(False)), "range_not_applicable"),
        F.when((family == "dataflow_path") & none(source_class), "unclassified_source"), F.when((family == "dataflow_path") & none(sink_class), "unclassified_sink"),
    ))


def filtered_leads(leads: DataFrame, classes: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """``leads`` (scanner, native_severity, rule) with ``filtered``: the first class of stylistic rules that takes a lead, null if none does.

    A class is a scanner (a glob, of its name or the part before a colon), native severities and globs of rules; it takes a lead of its scanner
    with one of its severities, or with a rule that one of its globs matches. Classes are settings, so they are part of the plan, not a join.
    """

    def like(c: Column, pattern: str) -> Column:
        return c.rlike("^" + "".join(".*" if p == "*" else "." if p == "?" else "\\" + p if not p.isalnum() and p != "_" else p for p in pattern) + "$")

    label = F.lower(F.trim(F.coalesce("native_severity", F.lit(""))))
    found = F.lit(None).cast("int")
    for i, (scanner, severities, rules) in reversed(list(enumerate(classes))):
        own = like(F.col("scanner"), scanner) | like(F.substring_index("scanner", ":", 1), scanner)
        hit = (label != "") & label.isin(*[s.strip().lower() for s in severities]) if severities else F.lit(False)
        for r in rules:
            hit = hit | like(F.col("rule"), r)
        found = F.when(own & hit, F.lit(i)).otherwise(found)
    return leads.withColumn("filtered", found)


def excluded(path: Column, categories: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first category, in the order given, of which a path pattern matches; null if none does."""
    out = F.lit(None).cast("string")
    for name, globs in reversed(list(categories)):
        hit = F.lit(False)
        for g in globs:
            hit = hit | path.rlike(glob_regex(g))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def volume(findings: DataFrame, by: str, severities: Sequence[str], lines: DataFrame) -> DataFrame:
    """(by, findings, duplicates, duplicate_rate, severities, unknown, per_kloc) of findings (by, duplicate_of, severity) against lines (by, lines).

    Severities are counted over the closed list, zeros too, ``name=n`` in order; what isn't of the list is unknown. A scanner without
    findings has its row; one without lines has no yield.
    """
    g = findings.groupBy(by).agg(
        F.count("*").alias("findings"), F.count("duplicate_of").alias("duplicates"), *[F.count_if(F.col("severity") == s).alias(f"s_{s}") for s in severities],
        F.count_if(F.col("severity").isNull() | ~F.col("severity").isin(*severities)).alias("unknown"),
    )
    both = g.join(lines, by, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    counts = F.array_join(F.array(*[F.concat(F.lit(f"{s}="), zero(F.col(f"s_{s}")).cast("string")) for s in severities]), ",")
    return both.select(
        by, zero("findings").alias("findings"), zero("duplicates").alias("duplicates"), F.try_divide("duplicates", "findings").alias("duplicate_rate"), counts.alias("severities"), zero("unknown").alias("unknown"),
        F.try_divide(zero("findings") * 1000, F.col("lines")).alias("per_kloc"),
    )


def support_for_fix(crashes: DataFrame, fixed_in: DataFrame, key: str) -> DataFrame:
    """(key, before, after, undated, support): crashes of a bucket before and after the version that fixed it, by position of versions.

    ``crashes``: key, position (null: version unknown), occurrences; ``fixed_in``: key, position. supported if there were some before and none
    after, contradicted if some after, unknown if undated ones could be after, or there were none before.
    """
    met = fixed_in.withColumnRenamed("position", "fixed").join(crashes, key, "left")
    n = F.coalesce("occurrences", F.lit(0))
    g = met.groupBy(key, "fixed").agg(
        F.sum(F.when(F.col("position") < F.col("fixed"), n).otherwise(0)).alias("before"), F.sum(F.when(F.col("position") >= F.col("fixed"), n).otherwise(0)).alias("after"),
        F.sum(F.when(F.col("position").isNull(), n).otherwise(0)).alias("undated"),
    )
    support = F.when(F.col("after") > 0, "contradicted").when((F.col("before") > 0) & (F.col("undated") == 0), "supported").otherwise("unknown")
    return g.select(key, "before", "after", "undated", support.alias("support"))


def drift(baseline: DataFrame, current: DataFrame, tolerances: Mapping[str, float], lower_is_better: Sequence[str]) -> DataFrame:
    """(canary, metric, before, after, state): each canary's metrics against its baseline: missing, new, unmeasured, drifted or stable.

    A metric drifts if it got worse by more than its tolerance, which is 0 where none is given; getting better isn't drift.
    """
    a = baseline.select("canary", "metric", F.col("value").alias("before"), F.lit(True).alias("had"))
    b = current.select("canary", "metric", F.col("value").alias("after"), F.lit(True).alias("has"))
    both = a.join(b, ["canary", "metric"], "full_outer")
    worse = F.when(F.col("metric").isin(*lower_is_better), F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    bound = F.coalesce(_map(tolerances)[F.col("metric")], F.lit(0.0)) if tolerances else F.lit(0.0)
    state = F.when(F.col("has").isNull(), "missing").when(F.col("had").isNull(), "new").when(F.col("before").isNull() | F.col("after").isNull(), "unmeasured").when(worse > bound, "drifted").otherwise("stable")
    return both.select("canary", "metric", "before", "after", state.alias("state"))


def merged_claims(claims: DataFrame) -> DataFrame:
    """(identity, predicate, cwe, entities, preconditions, proposals): claims that say the same, with what any of them presupposes.

    Identity is a digest of predicate, CWE and the sorted entities; null CWEs are alike.
    """
    entities = F.array_sort(F.array_distinct("entities"))
    identity = F.sha2(F.concat_ws("\x1f", F.col("predicate"), F.coalesce("cwe", F.lit("")), F.array_join(entities, "\x1e")), 256)
    marked = claims.withColumns({"sorted": entities, "identity": identity})
    g = marked.groupBy("identity").agg(
        F.first("predicate").alias("predicate"), F.first("cwe").alias("cwe"), F.first("sorted").alias("entities"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("preconditions")))).alias("preconditions"), F.count("*").alias("proposals"),
    )
    return g


def root_causes(leads: DataFrame) -> DataFrame:
    """(lead, population, root_cause): the lead that stands for a lead and its duplicates, and a digest of what they share.

    ``leads``: lead, duplicate_of, cwe, path. The root cause is one per CWE and file of the lead that stands for them.
    """
    heads = leads.filter("duplicate_of IS NULL").select(F.col("lead").alias("population"), F.col("cwe").alias("head_cwe"), F.col("path").alias("head_path"))
    own = leads.select("lead", F.coalesce("duplicate_of", "lead").alias("population"))
    cause = F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce("head_cwe", F.lit("")), F.coalesce("head_path", F.lit(""))), 256), 1, 16)
    return own.join(heads, "population", "left").select("lead", "population", F.when(F.col("head_path").isNotNull(), cause).alias("root_cause"))


def repository(url: Column, hosts: Sequence[str]) -> Column:
    """struct<host, owner, name> of a repository's address on one of the hosts, lower-cased and without .git; null for any other."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(git\+|scm:git:)", ""), r"^git@([^:/]+):", "https://$1/")
    pattern = r"^(?:https?|git|ssh)://(?:[^@/]*@)?([^/:?#]+)(?::\d+)?/([\w.-]+)/([\w.-]+?)(?:\.git)?/?(?:[?#].*)?$"
    host = F.lower(F.regexp_extract(plain, pattern, 1))
    part = lambda k: F.lower(F.regexp_extract(plain, pattern, k))
    return F.when(plain.rlike(pattern) & host.isin(*hosts), F.struct(host.alias("host"), part(2).alias("owner"), part(3).alias("name")))


def triaged(leads: DataFrame, by_rule: DataFrame, by_cwe: DataFrame, otherwise: str) -> DataFrame:
    """``leads`` with ``triage`` and ``basis``: what the table says of scanner and rule, else of the CWE, else ``otherwise``."""
    met = leads.join(by_rule.select("scanner", "rule", F.col("triage").alias("r")), ["scanner", "rule"], "left").join(by_cwe.select("cwe", F.col("triage").alias("c")), "cwe", "left")
    return met.select(*leads.columns, F.coalesce("r", "c", F.lit(otherwise)).alias("triage"), F.when(F.col("r").isNotNull(), "rule").when(F.col("c").isNotNull(), "cwe").otherwise("default").alias("basis"))


def side(*keys: Column) -> Column:
    """A or B, by a digest of the keys, the same in every run and engine."""
    return F.when(F.conv(F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 8), 16, 10).cast("long") % 2 == 0, "A").otherwise("B")


def completeness(items: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, present, absent, unknown): for each field, items that have it, have it empty, or don't say."""
    one = items.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("x.*")
    return one.groupBy("field").agg(F.count_if(F.trim("value") != "").alias("present"), F.count_if(F.trim("value") == "").alias("absent"), F.count_if(F.col("value").isNull()).alias("unknown"))


def citations(cited: DataFrame, known: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How citations resolve, in all (role null) and by role, and each reviewer's decisions that the verifier overturned.

    ``cited``: role, reference; ``known``: reference; ``reviews``: reviewer, decision, verified (null: not verified).
    """
    met = cited.join(known.select("reference", F.lit(True).alias("met")).distinct(), "reference", "left")
    a = met.groupingSets([[], [F.col("role")]], F.col("role")).agg(F.count("*").alias("cited"), F.count("met").alias("resolved"), F.grouping("role").alias("whole"))
    a = a.withColumn("rate", F.try_divide("resolved", "cited"))
    b = reviews.filter("verified IS NOT NULL").groupBy("reviewer").agg(F.count("*").alias("verified"), F.count_if(F.col("verified") != F.col("decision")).alias("overturned"))
    return a, b.withColumn("rate", F.try_divide("overturned", "verified"))


def rechecks(findings: DataFrame, states: Sequence[str], most: int) -> tuple[DataFrame, int]:
    """(finding, place, admitted) of findings that may be checked again, first by severity rank, then age, then id; how many were not admitted."""
    able = findings.filter(F.col("state").isin(*states))
    chosen = able.orderBy(F.col("rank").desc(), F.col("age").desc(), "finding").limit(most)
    placed = chosen.withColumn("place", F.row_number().over(Window.orderBy(F.col("rank").desc(), F.col("age").desc(), "finding")))  # `most` rows at most
    return placed.select("finding", "place"), max(0, able.count() - most)


def demoted(statements: DataFrame, known: DataFrame) -> DataFrame:
    """(statement, state, unresolved): statements whose references all resolve keep their state, the others become unsupported and name what doesn't."""
    one = statements.select("statement", F.explode("references").alias("reference"))
    lost = one.join(known.select("reference").distinct(), "reference", "left_anti").groupBy("statement").agg(F.array_sort(F.collect_set("reference")).alias("unresolved"))
    met = statements.join(lost, "statement", "left")
    bare = F.size("references") == 0
    return met.select("statement", F.when(F.col("unresolved").isNotNull() | bare, "unsupported").otherwise(F.col("state")).alias("state"), F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"))


def subjects(modules: DataFrame, parts: DataFrame, hints: DataFrame, most_lines: int) -> tuple[DataFrame, DataFrame]:
    """(module, subject, start, end, hinted) to look at, and (module, subject, gap): a module that fits is one subject, else its parts, hinted first.

    ``modules``: module, lines; ``parts``: module, subject, start, end; ``hints``: module, line. A part too long to look at is a gap.
    """
    whole = modules.filter(F.col("lines") <= most_lines).select("module", F.lit("<module>").alias("subject"), F.lit(1).alias("start"), F.col("lines").cast("int").alias("end"))
    large = parts.join(modules.filter(F.col("lines") > most_lines).select("module"), "module", "left_semi").select("module", "subject", "start", "end")
    fits = F.col("end") - F.col("start") + 1 <= most_lines
    kept = whole.union(large.filter(fits))
    at = kept.select("module", "subject", F.explode(F.sequence("start", "end")).alias("line")).join(hints.select("module", "line").distinct(), ["module", "line"]).select("module", "subject", F.lit(True).alias("hit")).distinct()
    out = kept.join(at, ["module", "subject"], "left").withColumn("hinted", F.coalesce("hit", F.lit(False))).drop("hit")
    return out, large.filter(~fits).select("module", "subject", F.lit("subject_too_long").alias("gap"))


def link_candidates(commands: DataFrame, valued: Sequence[str], most: int) -> tuple[DataFrame, int]:
    """(name, kind, value, commands) of the libraries that commands (command, argv) link, by name, and how many candidates were left out.

    ``-lNAME``, ``-l NAME``, ``-l:FILE`` and ``-framework NAME`` name one; the value of any flag of ``valued`` names none, whatever it looks like. A
    word is a value if the words before it, in order, make it one, so the words are read once along each command.
    """
    name = r"^[A-Za-z0-9_][A-Za-z0-9_.+-]*$"
    item = "struct<name:string,kind:string,value:string>"
    none = F.lit(None).cast("string")
    begin = F.struct(F.lit("").alias("flag"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc: Column, word: Column) -> Column:
        flag = acc["flag"]
        file = F.regexp_replace(F.regexp_extract(word, r"^-l:(?:lib)?([^/]+?)(?:\.so(?:\.\d+)*|\.a|\.dylib|\.dll|\.lib)$", 1), "^$", "")
        found = (
            F.when((flag == "-l") & word.rlike(name), F.struct(word.alias("name"), F.lit("link_flag").alias("kind"), word.alias("value")))
            .when(flag == "-framework", F.struct(word.alias("name"), F.lit("framework").alias("kind"), word.alias("value"))).when(flag != "", F.lit(None).cast(item))
            .when(file != "", F.struct(file.alias("name"), F.lit("exact_library_name").alias("kind"), word.alias("value")))
            .when(word.startswith("-l") & F.substring(word, 3, 1 << 20).rlike(name), F.struct(F.substring(word, 3, 1 << 20).alias("name"), F.lit("link_flag").alias("kind"), word.alias("value")))
        )
        # a flag that needs a value, and didn't itself stand as one, waits for the next word
        waits = F.when((flag == "") & word.isin("-l", "-framework", *valued), word).otherwise(F.lit(""))
        return F.struct(waits.alias("flag"), F.when(found.isNotNull(), F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    words = F.slice("argv", F.lit(2), F.greatest(F.size("argv") - 1, F.lit(0)))
    rows = commands.select("command", F.explode(F.aggregate(words, begin, step, lambda a: a["out"])).alias("c")).select("command", "c.*")
    g = rows.groupBy("name", "kind").agg(F.min("value").alias("value"), F.count_distinct("command").alias("commands"))
    return g.orderBy("name", "kind").limit(most), max(0, g.count() - most)


def lifecycle_metrics(prior: DataFrame, current: DataFrame, states: Sequence[str], ages: DataFrame, actionable: Sequence[str] = ("high", "critical")) -> DataFrame:
    """One row: prior findings by state (closed list, zero too), rates, what is new, and the median age of what persists and matters.

    ``prior``: finding, state, severity, change_known; ``current``: state; ``ages``: finding, age. The median is null if a persisting finding of
    the bands has no age, or none persists; a state that isn't listed is an error.
    """
    wrong = F.when(~F.col("state").isin(*states), F.raise_error(F.concat(F.lit("unknown state: "), "state")).cast("int")).otherwise(0)
    rows = prior.join(ages, "finding", "left").withColumn("checked", wrong)
    of = (F.col("state") == "persisting") & F.col("severity").isin(*actionable)
    g = rows.agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states], F.count("*").alias("prior"), F.sum("checked").alias("checked"), F.count_if(~F.col("change_known")).alias("change_unknown"),
        F.median(F.when(of, F.col("age"))).alias("median"), F.count_if(of).alias("matter"), F.count(F.when(of, F.col("age"))).alias("aged"),
    )
    new = current.agg(F.count_if(F.col("state") == "new").alias("introduced"))
    both = g.withColumn("introduced", F.lit(new.first()["introduced"]))
    rate = lambda s: F.try_divide(F.col(f"n_{s}"), F.col("prior")).alias(f"{s}_rate")
    median = F.when((F.col("matter") > 0) & (F.col("matter") == F.col("aged")), F.col("median"))
    return both.filter("coalesce(checked, 0) = 0").select(*[f"n_{s}" for s in states], *[rate(s) for s in states], "change_unknown", "introduced", median.alias("median_age"))


def scorecard(functions: DataFrame, calls: DataFrame, states: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(function, <state>..., total) of the calls of each function by verdict, zeros too, and (state, n) of calls of no listed function."""
    counted = functions.select("function").distinct().join(calls.withColumnRenamed("caller", "function"), "function", "left")
    own = counted.groupBy("function").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states], F.count("state").alias("total"))
    lost = calls.join(functions.select(F.col("function").alias("caller")).distinct(), "caller", "left_anti").groupBy("state").agg(F.count("*").alias("n"))
    return own, lost


def scope_seeds(wanted: DataFrame, functions: DataFrame, units: DataFrame) -> DataFrame:
    """(seed, function, unit, reason): wanted seeds (seed, path, name) as functions and their units; what doesn't resolve says why.

    One function of the path and name resolves; none, or several, do not; a function without a unit keeps its place without one.
    """
    met = wanted.join(functions.select("path", "name", "function"), ["path", "name"], "left")
    g = met.groupBy("seed").agg(F.count("function").alias("n"), F.min("function").alias("function"))
    one = g.withColumn("function", F.when(F.col("n") == 1, F.col("function"))).join(units.groupBy("function").agg(F.min("unit").alias("unit")), "function", "left")
    reason = F.when(F.col("n") == 0, "function_not_found").when(F.col("n") > 1, "function_ambiguous").when(F.col("unit").isNull(), "unit_not_found")
    return one.select("seed", "function", "unit", reason.alias("reason"))
