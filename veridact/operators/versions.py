"""Semantic versions as sortable values, and ranges of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grammar of SemVer 2.0.0, the order of events at one version, and ecosystems that order versions by it.
_IDENTIFIER = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
_PATTERN = rf"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-({_IDENTIFIER}(?:\.{_IDENTIFIER})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\z"
EVENT_ORDER = ("fixed", "introduced", "last_affected")
ORDERED_ECOSYSTEMS = ("Go", "crates.io", "npm")
V_PREFIXED = ("Go",)
#: Characters of a version, at most; a longer one can't be told.
MAX_VERSION = 256


def version_key(text: Column) -> Column:
    """A struct that sorts as SemVer 2.0.0 does; null if the text is no version. Build metadata doesn't count.

    Pre-releases come before their release; of their identifiers, numbers come before words and compare as numbers.
    """
    part = [F.regexp_extract(text, _PATTERN, i) for i in range(1, 5)]
    identifiers = F.transform(
        F.filter(F.split(part[3], r"\."), lambda x: x != ""),
        lambda x: F.struct(
            F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"),
            F.when(x.rlike("^[0-9]+$"), x.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"),
            F.when(x.rlike("^[0-9]+$"), F.lit("")).otherwise(x).alias("word"),
        ),
    )
    key = F.struct(
        *[part[i].cast("decimal(38,0)").alias(n) for i, n in enumerate(("major", "minor", "patch"))],
        (part[3] == "").cast("int").alias("release"), identifiers.alias("identifiers"),
    )
    return F.when(text.rlike(_PATTERN), key)


def in_range(version: Column, events: Column) -> Column:
    """Whether a version is affected by range events (array<struct<kind, version>>); null if it or one of them is no version.

    ``introduced`` of ``0`` is before everything, a ``limit`` of ``*`` after. Events are swept in order of version; at one
    version fixed comes before introduced, and introduced before last_affected, which still includes its version. If there are
    limits, the version has to be below one of them. Events that introduce nothing are no range: null.
    """
    own = version_key(version)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(EVENT_ORDER) for x in (k, i)])

    def point(e: Column) -> Column:
        start, end = (e["kind"] == "introduced") & (e["version"] == "0"), (e["kind"] == "limit") & (e["version"] == "*")
        at = F.when(start, 0).when(end, 2).otherwise(1)
        return F.struct(at.alias("at"), F.when(at == 1, version_key(e["version"])).alias("key"), rank[e["kind"]].alias("order"), e["kind"].alias("kind"))

    points = F.transform(events, point)
    known = F.forall(points, lambda e: (e["kind"].isin(*EVENT_ORDER, "limit")) & ((e["at"] != 1) | e["key"].isNotNull())) & F.exists(points, lambda e: e["kind"] == "introduced")
    limits = F.filter(points, lambda e: e["kind"] == "limit")
    below = (F.size(limits) == 0) | F.exists(limits, lambda e: (e["at"] == 2) | (own < e["key"]))

    def step(inside: Column, e: Column) -> Column:
        reached, passed = (e["at"] == 0) | (e["key"] <= own), (e["at"] == 0) | (e["key"] < own)
        return (
            F.when((e["kind"] == "introduced") & reached, F.lit(True)).when((e["kind"] == "fixed") & reached, F.lit(False))
            .when((e["kind"] == "last_affected") & passed, F.lit(False)).otherwise(inside)
        )

    swept = F.aggregate(F.array_sort(F.filter(points, lambda e: e["kind"] != "limit")), F.lit(False), step)
    return F.when(own.isNotNull() & F.coalesce(known, F.lit(False)), below & swept)


def spelled(version: Column, ecosystem: Column) -> Column:
    """A version as its ecosystem's ordering reads it: without the leading v that some write; null if it is too long."""
    prefixed = F.substring_index(ecosystem, ":", 1).isin(*V_PREFIXED) & version.startswith("v")
    return F.when(F.length(version) <= MAX_VERSION, F.when(prefixed, F.substring(version, 2, MAX_VERSION)).otherwise(version))


def entry_verdict(version: Column, ecosystem: Column, versions: Column, ranges: Column) -> Column:
    """struct<affected, gaps> of one affected entry of an advisory: listed versions, then ranges; what can't be told is a gap.

    ``ranges``: array of struct (type, events). SEMVER ranges order versions anywhere, ECOSYSTEM ranges where the ecosystem's order is
    known; GIT ranges say nothing beside other data, and are a gap alone. A list that misses is decisive only where versions can be
    told to be equal.
    """
    ordered = F.substring_index(ecosystem, ":", 1).isin(*ORDERED_ECOSYSTEMS)
    own = spelled(version, ecosystem)
    key = version_key(own)
    listed = F.exists(versions, lambda v: (v == version) | (ordered & key.isNotNull() & F.coalesce(version_key(spelled(v, ecosystem)) == key, F.lit(False))))
    real = F.filter(ranges, lambda r: r["type"] != "GIT")

    def judged(r: Column) -> Column:
        inside = in_range(own, F.transform(r["events"], lambda e: F.struct(e["kind"].alias("kind"), F.when(e["version"].isin("0", "*"), e["version"]).otherwise(spelled(e["version"], ecosystem)).alias("version"))))
        gap = (
            F.when(~r["type"].isin("SEMVER", "ECOSYSTEM"), F.concat(F.lit("range_type_unsupported:"), F.substring(r["type"], 1, 32)))
            .when((r["type"] == "ECOSYSTEM") & ~ordered, F.concat(F.lit("range_ordering_unsupported:"), ecosystem))
            .when(F.size(r["events"]) == 0, F.lit("malformed_range:events")).when(key.isNull(), F.concat(F.lit("version_unparseable:"), ecosystem))
            .when(~F.exists(r["events"], lambda e: e["kind"] == "introduced"), F.lit("malformed_range:no_introduced_event"))
            .when(inside.isNull(), F.concat(F.lit("range_event_unparseable:"), ecosystem))
        )
        return F.struct(F.when(gap.isNull(), inside).alias("inside"), gap.alias("gap"))

    found = F.transform(real, judged)
    inside = F.exists(found, lambda f: F.coalesce(f["inside"], F.lit(False)))
    named = F.filter(F.transform(found, lambda f: f["gap"]), lambda g: g.isNotNull())
    told = F.exists(found, lambda f: f["gap"].isNull())
    more = (
        F.when((F.size(ranges) > 0) & (F.size(real) == 0) & (F.size(versions) == 0), F.lit("range_type_unsupported:GIT"))
        .when((F.size(versions) == 0) & (F.size(ranges) == 0), F.lit("affected_entry_has_no_version_data"))
        .when((F.size(versions) > 0) & ~told & (F.size(named) == 0), F.when(~ordered, F.concat(F.lit("range_ordering_unsupported:"), ecosystem)).when(key.isNull(), F.concat(F.lit("version_unparseable:"), ecosystem)))
    )
    affected = listed | inside
    return F.struct(affected.alias("affected"), F.when(affected, F.array().cast("array<string>")).otherwise(F.concat(named, F.array_compact(F.array(more)))).alias("gaps"))


def match_packages(packages: DataFrame, affected: DataFrame, advisories: DataFrame, indexed: DataFrame, most: int = 500) -> DataFrame:
    """One row per distinct package (ecosystem, name, version): what the advisories about it say, and what they can't.

    ``affected``: advisory_id, ecosystem, name, versions, ranges; names compare without ASCII case. ``advisories``: advisory_id, withdrawn.
    ``indexed``: ecosystem. An advisory is withdrawn, else affected if one of its entries is, else undetermined if one has a gap, else
    not affected. Of each package the first ``most`` advisories by id are judged; more are the gap ``truncated``.
    """
    wanted = packages.select("ecosystem", "name", "version").distinct().withColumn("folded", ascii_lower(F.col("name")))
    known = affected.withColumn("folded", ascii_lower(F.col("name"))).drop("name")
    met = wanted.join(known, ["ecosystem", "folded"])
    package = Window.partitionBy("ecosystem", "name", "version")
    met = met.withColumn("place", F.dense_rank().over(package.orderBy("advisory_id")))
    judged = met.filter(F.col("place") <= most).join(advisories.withColumnRenamed("withdrawn", "gone").withColumn("found", F.lit(True)), "advisory_id", "left")
    judged = judged.withColumn("v", entry_verdict(F.col("version"), F.col("ecosystem"), F.col("versions"), F.col("ranges")))
    keys = ["ecosystem", "name", "version"]
    per = judged.groupBy(*keys, "advisory_id").agg(
        F.bool_or(F.col("found")).alias("found"), F.max("gone").alias("gone"), F.bool_or("v.affected").alias("affected"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("v.gaps")))).alias("gaps"),
    )
    unusable = (F.length("version") == 0) | (F.length("version") > MAX_VERSION)
    gaps = F.when(unusable, F.array(F.lit("version_unusable"))).when(F.col("found").isNull(), F.array(F.lit("advisory_record_missing"))).otherwise(F.col("gaps"))
    status = (
        F.when(unusable, "undetermined").when(F.trim(F.coalesce("gone", F.lit(""))) != "", "withdrawn").when(F.col("found").isNull(), "undetermined")
        .when(F.col("affected"), "affected").when(F.size("gaps") > 0, "undetermined").otherwise("not_affected")
    )
    per = per.withColumn("status", status).withColumn("gaps", F.when(F.col("status") == "undetermined", gaps).otherwise(F.array().cast("array<string>")))
    told = per.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("status") == "affected", F.col("advisory_id")))).alias("matches"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "undetermined", F.col("advisory_id")))).alias("undetermined"),
        F.count_if(F.col("status") == "not_affected").alias("not_affected"), F.count_if(F.col("status") == "withdrawn").alias("withdrawn"), F.flatten(F.collect_list("gaps")).alias("own"),
    )
    more = met.groupBy(*keys).agg((F.max("place") > most).alias("more"))
    out = wanted.drop("folded").join(told, keys, "left").join(more, keys, "left").join(indexed.select("ecosystem", F.lit(True).alias("known")).distinct(), "ecosystem", "left")
    none = F.array().cast("array<string>")
    named = F.array_compact(F.array(
        F.when(F.col("known").isNull(), F.concat(F.lit("ecosystem_not_indexed:"), "ecosystem")), F.when(unusable, F.lit("version_unusable")), F.when(F.col("more"), F.lit("truncated:advisories_per_package")),
    ))
    whole = F.array_sort(F.array_distinct(F.concat(named, F.coalesce("own", none))))
    return out.select(
        *keys, F.when(F.size(whole) > 0, "partial").otherwise("complete").alias("status"), F.coalesce("matches", F.array()).alias("matches"), F.coalesce("undetermined", F.array()).alias("undetermined"),
        F.coalesce("not_affected", F.lit(0)).alias("not_affected"), F.coalesce("withdrawn", F.lit(0)).alias("withdrawn"), whole.alias("gaps"),
    )


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verdict(listed: Column, in_ranges: Column, withdrawn: Column) -> Column:
    """affected, not_affected, withdrawn or undetermined, from explicit versions and ranges; null is not known."""
    return (
        F.when(withdrawn, F.lit("withdrawn"))
        .when(F.coalesce(listed, F.lit(False)) | F.coalesce(in_ranges, F.lit(False)), F.lit("affected"))
        .when(in_ranges.isNull() | listed.isNull(), F.lit("undetermined"))
        .otherwise(F.lit("not_affected"))
    )
