"""What surrounds a change: its review, deployment, hour, scope and tests, each with how far it is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridact.functions.paths import matches_glob
from veridact.operators import graph as G
from veridact.operators.walks import co_changed

#: A time of day, the date before it and the offset after it, as RFC 3339 writes them.
_STAMP = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(text: Column) -> Column:
    """A time stamp with an offset; null without one, or if it is no time."""
    return F.when(text.rlike(_STAMP), F.try_to_timestamp(F.upper(text)))


def review_speed(created: Column, head: Column, merged: Column, merged_head: Column, approvals: Column, author: Column, fast_seconds: int = 300) -> Column:
    """struct of a change's review. ``approvals``: array of struct (reviewer, at, commit); the author's own don't count.

    A known fast interval makes ``fast_approval`` true; a slow one makes it false only if the other is known. Without an
    approval of the merged head but with one of an earlier head, the approval is stale.
    """
    others = F.filter(approvals, lambda a: a["reviewer"] != author)
    of_head = F.filter(others, lambda a: a["commit"] == merged_head)

    def first(xs: Column) -> Column:
        return F.array_min(F.transform(xs, lambda a: a["at"]))

    def seconds(a: Column, b: Column) -> Column:
        return F.unix_timestamp(b) - F.unix_timestamp(a)

    to_first, to_head, to_merge = seconds(created, first(others)), seconds(head, first(of_head)), seconds(created, merged)
    fast = (to_first < fast_seconds) | (to_head < fast_seconds)
    status = F.when(created.isNull() | head.isNull() | merged.isNull(), "incomplete").otherwise("known")
    return F.struct(
        to_first.alias("first_seconds"), to_head.alias("head_seconds"), fast.alias("fast_approval"), (to_merge < fast_seconds).alias("fast_merge"),
        (F.size(of_head) > 0).alias("head_approved"), ((F.size(others) > 0) & (F.size(of_head) == 0)).alias("stale_approval"), (F.size(others) == 0).alias("unapproved"), status.alias("status"),
    )


def off_hours(at: Column, zone: str, start: str = "09:00", end: str = "18:00", weekend: Sequence[int] = (1, 7)) -> Column:
    """Whether an instant is, on the clocks of a named zone and whatever its daylight saving, on a weekend day or outside the hours.

    Instants are in UTC; days count from 1, Sunday; the end of the hours is outside.
    """
    local = F.from_utc_timestamp(at, zone)
    clock = F.date_format(local, "HH:mm")
    return F.dayofweek(local).isin(*weekend) | (clock < start) | (clock >= end)


def scope_sprawl(touched: DataFrame, roots: DataFrame, support: int, most: int, groups: int, churn: int, entropy: float) -> DataFrame:
    """(change_id, groups, churn, entropy, top_share, sprawling): how a change's churn spreads over unrelated components.

    ``touched``: change_id, component, churn. ``roots``: component, root; the empty root relates nothing. Components are related where one
    root nests the other, or where at least ``support`` changes other than the one judged, of at most ``most`` components, touched both; related
    ones are one group. Entropy is normalised by the number of groups. A change sprawls if it has enough groups, churn and entropy.
    """
    own = touched.groupBy("change_id", "component").agg(F.sum("churn").alias("churn"))
    small = own.groupBy("change_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("change_id", F.lit(1).alias("counts"))
    pairs, _ = co_changed(own, "change_id", "component", 1, most)
    named = roots.filter("root <> ''")
    above = named.select("component", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("root", "/"))), lambda n: F.array_join(F.slice(F.split("root", "/"), F.lit(1), n), "/"))).alias("root"))
    nested = above.join(named.withColumnRenamed("component", "outer"), "root").filter("component <> outer").select(F.least("component", "outer").alias("left"), F.greatest("component", "outer").alias("right")).distinct().withColumn("nested", F.lit(True))
    links = pairs.join(nested, ["left", "right"], "full_outer")
    here = own.select("change_id", F.col("component").alias("left")).join(links, "left").join(own.select("change_id", F.col("component").alias("right")), ["change_id", "right"]).join(small, "change_id", "left")
    # the change itself, if it isn't too large to count, is one of those that touched both
    related = here.filter(F.coalesce("nested", F.lit(False)) | (F.coalesce("support", F.lit(0)) - F.coalesce("counts", F.lit(0)) >= support))
    node = lambda c: F.struct("change_id", F.col(c).alias("component"))
    grouped = G.components(related.select(node("left").alias("src"), node("right").alias("dst")))
    of = grouped.select(F.col("node.change_id").alias("change_id"), F.col("node.component").alias("component"), F.col("component.component").alias("group"))
    per = own.join(of, ["change_id", "component"], "left").groupBy("change_id", F.coalesce("group", "component").alias("group")).agg(F.sum("churn").alias("churn"))
    whole = per.groupBy("change_id").agg(F.sum("churn").alias("total"), F.count("*").alias("n"))
    share = F.col("churn") / F.col("total")
    spread = per.join(whole, "change_id").groupBy("change_id", "total", "n").agg(F.sum(F.when(share > 0, -share * F.log2(share)).otherwise(0.0)).alias("bits"), F.max(share).alias("top_share"))
    normal = F.when(F.col("n") > 1, F.col("bits") / F.log2(F.col("n").cast("double"))).otherwise(F.lit(0.0))
    out = spread.select("change_id", F.col("n").alias("groups"), F.col("total").alias("churn"), normal.alias("entropy"), "top_share")
    return out.withColumn("sprawling", (F.col("groups") >= groups) & (F.col("churn") >= churn) & (F.col("entropy") >= entropy))


def test_churn(files: DataFrame, tests: Sequence[str], contracts: Sequence[str], extensions: Sequence[str], least: int) -> DataFrame:
    """(unit, production, contract, associated, unassociated, ambiguous, untested_production, untested_contract) of each review unit.

    ``files``: unit, path, component, churn. A file is a test, a contract or production by the first list that names it, else nothing. A
    test is associated by its stem, without one affix at each end, with production files of that stem, else with those of its
    component. Several files of the stem are ambiguous; unassociated tests offset nothing.
    """
    path = F.col("path")

    def named(globs: Sequence[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | matches_glob(path, g)
        return out

    produced = F.lit(False)
    for e in extensions:
        produced = produced | path.endswith(e)
    role = F.when(named(tests), "test").when(named(contracts), "contract").when(produced, "production")
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")
    subject = F.regexp_replace(F.regexp_replace(stem, "^(test_|spec_)", ""), r"(_test|Tests|Test|\.spec|\.test|_spec)$", "")
    rows = files.withColumn("role", role).filter("role IS NOT NULL").withColumn("stem", F.when(F.col("role") == "test", subject).otherwise(stem))
    code, test = rows.filter("role = 'production'"), rows.filter("role = 'test'")
    stems = code.groupBy("unit", "stem").agg(F.count_distinct("path").alias("same"))
    components = code.select("unit", "component").distinct().withColumn("beside", F.lit(True))
    met = test.join(stems, ["unit", "stem"], "left").join(components, ["unit", "component"], "left")
    tied = F.col("same").isNotNull() | F.coalesce("beside", F.lit(False))
    tested = met.groupBy("unit").agg(
        F.sum(F.when(tied, F.col("churn")).otherwise(0)).alias("associated"), F.sum(F.when(tied, 0).otherwise(F.col("churn"))).alias("unassociated"), F.count_if(F.col("same") > 1).alias("ambiguous"),
    )
    size = rows.groupBy("unit").agg(F.sum(F.when(F.col("role") == "production", F.col("churn")).otherwise(0)).alias("production"), F.sum(F.when(F.col("role") == "contract", F.col("churn")).otherwise(0)).alias("contract"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = size.join(tested, "unit", "left").withColumns({c: zero(c) for c in ("associated", "unassociated", "ambiguous")})
    return out.withColumns({
        "untested_production": (F.col("production") + F.col("contract") >= least) & (F.col("associated") == 0),
        "untested_contract": (F.col("contract") > 0) & (F.col("associated") + F.col("unassociated") == 0),
    })


def flag_counts(changes: DataFrame, unit: str, flags: Sequence[str]) -> DataFrame:
    """(unit, flag, n, availability): changes of a unit for which a flag holds; null if no change's flag is known.

    partial if some are unknown; what is known is counted then, and the reader told.
    """
    one = changes.select(unit, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("value")) for f in flags])).alias("x")).select(unit, "x.*")
    g = one.groupBy(unit, "flag").agg(F.count_if(F.col("value")).alias("yes"), F.count("value").alias("known"), F.count("*").alias("total"))
    state = F.when(F.col("known") == 0, "unavailable").when(F.col("known") < F.col("total"), "partial").otherwise("available")
    return g.select(unit, "flag", F.when(F.col("known") > 0, F.col("yes")).alias("n"), state.alias("availability"))


def accepted_records(rows: DataFrame, text: str, schema: str, required: Sequence[str], stamps: Sequence[str], closed: dict[str, Sequence[str]]) -> DataFrame:
    """``rows`` with ``record`` (null if rejected) and ``rejected``: why an exported record is not taken, null if it is.

    A record has to be JSON of the schema with its required fields, time stamps with offsets, and statuses of the closed lists.
    """
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    r = F.col("record")
    reason = F.when(r.isNull() | F.try_parse_json(F.col(text)).isNull(), F.lit("malformed"))
    for f in required:
        reason = reason.when(r[f].isNull(), F.lit(f"missing:{f}"))
    for f in stamps:
        reason = reason.when(r[f].isNotNull() & rfc3339(r[f]).isNull(), F.lit(f"timestamp:{f}"))
    for f, values in closed.items():
        reason = reason.when(r[f].isNotNull() & ~r[f].isin(*values), F.lit(f"status:{f}"))
    out = rows.withColumn("record", parsed).withColumn("rejected", reason)
    return out.withColumn("record", F.when(F.col("rejected").isNull(), F.col("record")))
