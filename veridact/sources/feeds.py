"""Readers of vulnerability feeds, layered where newer files replace older rows."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridact.operators.lifecycle import layered_upsert, newest_only

CVE = (
    "cve_id string, status string, published string, last_modified string, description_en string, weaknesses array<string>, "
    "cvss array<struct<family:string,version:string,vector:string,base_score:double,base_severity:string>>"
)


def nvd(spark: SparkSession, layers: Sequence[str]) -> DataFrame:
    """One row per CVE from JSON-lines layers (gzipped or not), oldest first; a later row wins unless it is older."""
    read = [spark.read.schema(CVE).json(p).withColumn("layer", F.lit(i)) for i, p in enumerate(layers)]
    both = read[0]
    for more in read[1:]:
        both = both.union(more)
    return layered_upsert(both, "cve_id", "layer", "last_modified").drop("layer")


def nvd_weaknesses(cves: DataFrame) -> DataFrame:
    return cves.select("cve_id", F.explode("weaknesses").alias("cwe")).distinct()


def nvd_scores(cves: DataFrame) -> DataFrame:
    return cves.select("cve_id", F.inline("cvss"))


def epss(spark: SparkSession, path: str) -> DataFrame:
    """(cve_id, epss, percentile) of a CSV with a comment on top; a value outside 0..1 is an error, not a row less."""
    rows = spark.read.schema("cve_id string, epss double, percentile double").csv(path, comment="#", header=True)
    fine = F.col("epss").between(0, 1) & F.col("percentile").between(0, 1) & F.col("cve_id").rlike("^CVE-[0-9]{4}-[0-9]{4,}$")
    return rows.filter(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad score row: "), F.coalesce("cve_id", F.lit("?")))).cast("boolean")))


def kev(documents: DataFrame) -> DataFrame:
    """Known exploited vulnerabilities of catalogue documents in ``value``."""
    entry = "struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,dueDate:string,knownRansomwareCampaignUse:string,cwes:array<string>>"
    rows = documents.select(F.from_json("value", f"catalogVersion string, vulnerabilities array<{entry}>").alias("d")).select("d.catalogVersion", F.explode("d.vulnerabilities").alias("v"))
    return rows.select(
        F.col("v.cveID").alias("cve_id"), F.col("v.vendorProject").alias("vendor_project"), F.col("v.product").alias("product"), F.col("v.vulnerabilityName").alias("vulnerability_name"),
        F.to_date("v.dateAdded").alias("date_added"), F.to_date("v.dueDate").alias("due_date"), (F.col("v.knownRansomwareCampaignUse") == "Known").alias("known_ransomware_use"),
        F.col("v.cwes").alias("cwes"), F.col("catalogVersion").alias("catalog_version"),
    )


def osv_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, modified, withdrawn, summary, raw_json) of advisories in zip archives, an archive at a time per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".json")):
                        raw = z.read(name).decode()
                        d = json.loads(raw)
                        rows.append((d["id"], d.get("modified"), d.get("withdrawn"), d.get("summary"), raw))
                yield pd.DataFrame(rows, columns=["id", "modified", "withdrawn", "summary", "raw_json"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "id string, modified string, withdrawn string, summary string, raw_json string")


def osv_current(advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest row per advisory, and ids of which one time stamp has different bytes."""
    return newest_only(advisories, "id", "modified", "raw_json")


def osv_packages(advisories: DataFrame) -> DataFrame:
    """(id, ecosystem, name, versions, events) of each affected package."""
    schema = "affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<type:string,events:array<map<string,string>>>>>>"
    rows = advisories.select("id", F.explode(F.from_json("raw_json", schema)["affected"]).alias("a"))
    events = F.flatten(F.transform(F.filter(F.col("a.ranges"), lambda r: r["type"] != "GIT"), lambda r: F.flatten(F.transform(r["events"], lambda e: F.transform(F.map_entries(e), lambda x: F.struct(x["key"].alias("kind"), x["value"].alias("version")))))))
    return rows.select("id", "a.package.ecosystem", "a.package.name", "a.versions", events.alias("events"))


def osv_aliases(advisories: DataFrame) -> DataFrame:
    return advisories.select("id", F.explode(F.from_json("raw_json", "aliases array<string>")["aliases"]).alias("alias")).distinct()


def attack_patterns(documents: DataFrame) -> DataFrame:
    """(entry_id, kind, name) of ATT&CK bundles in ``value``; revoked entries are left out."""
    ref = "array<struct<source_name:string,external_id:string>>"
    objects = documents.select(F.explode(F.from_json("value", f"objects array<struct<type:string,name:string,revoked:boolean,external_references:{ref}>>")["objects"]).alias("o"))
    found = objects.filter("o.type = 'attack-pattern' AND NOT coalesce(o.revoked, false)")
    return found.select(F.get(F.filter("o.external_references", lambda r: r["source_name"] == "mitre-attack"), 0)["external_id"].alias("entry_id"), F.lit("attack").alias("kind"), "o.name")


def weaknesses(documents: DataFrame) -> DataFrame:
    """(entry_id, kind, name) of CWE catalogues in XML documents in ``value``."""
    ids = documents.select(F.expr("xpath(value, '//*[local-name()=\"Weakness\"]/@ID')").alias("i"), F.expr("xpath(value, '//*[local-name()=\"Weakness\"]/@Name')").alias("n"))
    return ids.select(F.explode(F.arrays_zip("i", "n")).alias("w")).select(F.concat(F.lit("CWE-"), "w.i").alias("entry_id"), F.lit("cwe").alias("kind"), F.col("w.n").alias("name"))
