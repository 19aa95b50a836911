"""Readers of scanner findings: SARIF, flat scanner JSON, and crash reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOCATION = "struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:struct<startLine:int,endLine:int,startColumn:int>>>"
SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,defaultConfiguration:struct<level:string>,properties:struct<`security-severity`:string>>>>>,"
    "originalUriBaseIds:map<string,struct<uri:string>>,"
    f"results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<{_LOCATION}>,codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{_LOCATION}>>>>>>>>>>"
)


def sarif(documents: DataFrame) -> DataFrame:
    """(tool, rule_id, level, security_severity, message, path, start_line, end_line, n_steps) of SARIF documents in ``value``.

    A result without level takes its rule's default, then ``warning``; addresses are resolved against their base; a result
    without location stays, with nulls.
    """
    runs = documents.select(F.explode(F.from_json("value", SARIF)["runs"]).alias("run"))
    rows = runs.select("run.tool.driver.name", "run.tool.driver.rules", "run.originalUriBaseIds", F.explode("run.results").alias("r"))
    rule = F.get(F.filter(F.coalesce("rules", F.array().cast("array<struct<id:string,defaultConfiguration:struct<level:string>,properties:struct<`security-severity`:string>>>")), lambda x: x["id"] == F.col("r.ruleId")), 0)
    place = F.get(F.col("r.locations"), 0)["physicalLocation"]
    base = F.try_element_at("originalUriBaseIds", place["artifactLocation"]["uriBaseId"])["uri"]
    steps = F.flatten(F.transform(F.flatten(F.transform(F.col("r.codeFlows"), lambda f: f["threadFlows"])), lambda t: t["locations"]))
    return rows.select(
        F.col("name").alias("tool"), F.col("r.ruleId").alias("rule_id"), F.coalesce("r.level", rule["defaultConfiguration"]["level"], F.lit("warning")).alias("level"),
        rule["properties"]["security-severity"].try_cast("double").alias("security_severity"), F.col("r.message.text").alias("message"),
        F.concat(F.coalesce(F.regexp_replace(base, "^file://", ""), F.lit("")), place["artifactLocation"]["uri"]).alias("path"),
        place["region"]["startLine"].alias("start_line"), F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("end_line"),
        F.coalesce(F.size(steps), F.lit(0)).alias("n_steps"),
    )


#: Registered flatteners of scanner JSON, by name: each maps a ``value`` column to (scanner, rule_id, severity, subject).
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(name: str):
    """Register a flattener."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        ADAPTERS[name] = f
        return f

    return add


def flatten(name: str, documents: DataFrame) -> DataFrame:
    return ADAPTERS[name](documents)


def _row(name: str, rule, severity, subject) -> list:
    return [F.lit(name).alias("scanner"), rule.alias("rule_id"), F.lower(F.coalesce(severity, F.lit("unknown"))).alias("severity"), subject.alias("subject")]


@adapter("grype")
def grype(documents: DataFrame) -> DataFrame:
    schema = "matches array<struct<vulnerability:struct<id:string,severity:string>,artifact:struct<name:string,version:string>>>"
    m = documents.select(F.explode_outer(F.from_json("value", schema)["matches"]).alias("m")).filter("m IS NOT NULL")
    return m.select(*_row("grype", F.col("m.vulnerability.id"), F.col("m.vulnerability.severity"), F.concat_ws("@", "m.artifact.name", "m.artifact.version")))


@adapter("osv")
def osv(documents: DataFrame) -> DataFrame:
    schema = "results array<struct<packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string>>>>>>"
    p = documents.select(F.explode(F.from_json("value", schema)["results"]).alias("r")).select(F.explode("r.packages").alias("p"))
    v = p.select("p.package", F.explode("p.vulnerabilities").alias("v"))
    return v.select(*_row("osv", F.col("v.id"), F.lit(None).cast("string"), F.concat_ws("@", "package.name", "package.version")))


@adapter("spotbugs")
def spotbugs(documents: DataFrame) -> DataFrame:
    bugs = documents.select(F.expr("xpath(value, '//BugInstance/@type')").alias("t"), F.expr("xpath(value, '//BugInstance/@priority')").alias("p"), F.expr("xpath(value, '//BugInstance/Class/@classname')").alias("c"))
    b = bugs.select(F.explode(F.arrays_zip("t", "p", "c")).alias("b"))
    level = F.when(F.col("b.p") == "1", F.lit("high")).when(F.col("b.p") == "2", F.lit("medium")).otherwise(F.lit("low"))
    return b.select(*_row("spotbugs", F.col("b.t"), level, F.col("b.c")))


@adapter("sanitizer")
def sanitizer(documents: DataFrame) -> DataFrame:
    """Sanitizer logs: the fault and the first frame with a source file."""
    fault = F.regexp_extract("value", r"ERROR: \w+Sanitizer: ([\w-]+)", 1)
    frame = F.regexp_extract("value", r"#\d+ 0x[0-9a-f]+ in (\S+) (\S+):(\d+)", 1)
    return documents.filter(fault != "").select(*_row("sanitizer", fault, F.lit("high"), frame))


@adapter("stackwalk")
def stackwalk(documents: DataFrame) -> DataFrame:
    schema = "crash_info struct<type:string>, crashing_thread struct<frames:array<struct<function:string,file:string,line:int>>>"
    r = documents.select(F.from_json("value", schema).alias("r"))
    return r.select(*_row("stackwalk", F.col("r.crash_info.type"), F.lit("high"), F.get(F.col("r.crashing_thread.frames"), 0)["function"]))


@adapter("sentry")
def sentry(documents: DataFrame) -> DataFrame:
    schema = "level string, exception struct<values:array<struct<type:string,stacktrace:struct<frames:array<struct<function:string>>>>>>"
    v = documents.select(F.from_json("value", schema).alias("r")).select("r.level", F.explode("r.exception.values").alias("v"))
    return v.select(*_row("sentry", F.col("v.type"), F.col("level"), F.element_at("v.stacktrace.frames", -1)["function"]))
