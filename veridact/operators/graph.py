"""Graph operators over edge tables (src, dst): bounded walks, paths, closure, components, dominators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridact.operators.walks import levelled as levels  # noqa: F401
from veridact.session import cut


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """(node, distance, expanded): nodes within ``depth`` steps of the seeds, by least distance.

    Level by level: the layer joins its edges, visited nodes are left out, and if a level would pass ``limit`` nodes
    in all, the first by name are admitted. ``expanded`` is false for the frontier: nodes whose own edges weren't followed.
    """
    links = edges.select("src", "dst").distinct()
    seen = cut(seeds.select("node").distinct().withColumn("distance", F.lit(0)), "walk")
    layer, total = seen, seen.count()
    for d in range(1, depth + 1):
        found = layer.join(links, layer["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        fresh = found.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d))
        if limit is not None:
            fresh = fresh.orderBy("node").limit(max(0, limit - total))
        layer = cut(fresh, "walk")
        n = layer.count()
        total += n
        seen = seen.union(layer)
        if n == 0:
            break
    return seen.withColumn("expanded", F.col("distance") < depth)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverses."""
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()


def paths(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(path): all walks of 1 to ``most`` steps from the seeds that visit no node twice."""
    links = edges.select("src", "dst").distinct()
    now = seeds.select(F.array("node").alias("path"))
    out = None
    for _ in range(most):
        step = now.join(links, F.element_at("path", -1) == links["src"]).filter(~F.array_contains("path", F.col("dst")))
        now = step.select(F.concat("path", F.array("dst")).alias("path"))
        out = now if out is None else out.union(now)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): all pairs joined by a path. Doubling: each round joins paths with paths, so rounds are logarithmic."""
    now = cut(edges.select("src", "dst").filter("src <> dst").distinct(), "closure")
    n = now.count()
    while True:
        longer = now.alias("a").join(now.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        now = cut(now.union(longer).distinct(), "closure")
        if (m := now.count()) == n:
            return now
        n = m


def reduction(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph that no longer path replaces."""
    direct = edges.select("src", "dst").filter("src <> dst").distinct()
    reach = closure(direct)
    around = direct.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    return direct.join(around.distinct(), ["src", "dst"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node each can reach. Labels jump to their label's label, so rounds are few."""
    links = cut(both_ways(edges), "components")
    labels = links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))
    labels = cut(labels, "components")
    while True:
        near = links.join(labels, links["dst"] == labels["node"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("least"))
        lower = labels.join(near, "node").select("node", F.least("component", "least").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(lower.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")), "components")
        if new.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").isEmpty():
            return new
        labels = new


def dominators(edges: DataFrame, graph: str, entry: str, post: bool = False) -> DataFrame:
    """(graph, node, idom): immediate dominators of every node that the entry reaches, graph by graph.

    A graph is one function's control flow, so a group fits a task. ``post``: of the reversed graph, from a virtual exit.
    """
    kind = edges.schema[graph].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        succ: dict[str, list[str]] = {}
        nodes = sorted({*pdf["src"], *pdf["dst"]})
        start = pdf[entry].iloc[0]
        pairs = list(zip(pdf["src"], pdf["dst"]))
        if post:
            ends = [n for n in nodes if n not in set(pdf["src"])]
            pairs, start = [(b, a) for a, b in pairs] + [("", n) for n in ends], ""
        for a, b in sorted(pairs):
            succ.setdefault(a, []).append(b)
        order, stack, seen = [], [(start, iter(succ.get(start, ())))], {start}
        while stack:
            node, rest = stack[-1]
            for n in rest:
                if n not in seen:
                    seen.add(n)
                    stack.append((n, iter(succ.get(n, ()))))
                    break
            else:
                order.append(node)
                stack.pop()
        place = {n: i for i, n in enumerate(order)}  # postorder
        pred: dict[str, list[str]] = {}
        for a, b in pairs:
            if a in seen:
                pred.setdefault(b, []).append(a)
        idom = {start: start}
        changed = True
        while changed:
            changed = False
            for n in reversed(order[:-1]):
                new = None
                for p in pred[n]:
                    if p in idom:
                        new = p if new is None else _meet(p, new, idom, place)
                if idom.get(n) != new:
                    idom[n], changed = new, True
        rows = [(pdf[graph].iloc[0], n, None if n == start else d or None) for n, d in idom.items() if n != ""]
        return pd.DataFrame(rows, columns=["graph", "node", "idom"])

    return edges.groupBy(graph).applyInPandas(solve, f"graph {kind}, node string, idom string")


def _meet(a: str, b: str, idom: dict[str, str], place: dict[str, int]) -> str:
    while a != b:
        while place[a] < place[b]:
            a = idom[a]
        while place[b] < place[a]:
            b = idom[b]
    return a


def dominator_chain(idom: DataFrame, seeds: DataFrame, most: int = 64) -> DataFrame:
    """(graph, node, dominator, steps): all dominators of the seeds, nearest first, at most so many."""
    now = seeds.join(idom, ["graph", "node"]).filter("idom IS NOT NULL").select("graph", "node", F.col("idom").alias("dominator"), F.lit(1).alias("steps"))
    now = cut(now, "chain")
    out = now
    up = idom.select("graph", F.col("node").alias("dominator"), "idom")
    for k in range(2, most + 1):
        now = cut(now.join(up, ["graph", "dominator"]).filter("idom IS NOT NULL").select("graph", "node", F.col("idom").alias("dominator"), F.lit(k).alias("steps")), "chain")
        if now.isEmpty():
            break
        out = out.union(now)
    return out


def mapped_span(hunks: Column, start: Column, end: Column) -> Column:
    """struct<start, end, touched>: a closed line span moved through hunks (old_start, old_len, new_start, new_len) in order.

    A hunk above shifts the span; one that meets it stretches it over the new lines and marks it touched. A pure insertion
    lies between two lines and touches the span only if both are in it.
    """
    begin = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(False).alias("touched"))

    def step(s: Column, h: Column) -> Column:
        last_old = h["old_start"] + F.greatest(h["old_len"], F.lit(1)) - 1
        shift = h["new_len"] - h["old_len"]
        insertion = h["old_len"] == 0
        above = F.when(insertion, h["old_start"] < s["start"]).otherwise(last_old < s["start"])
        below = F.when(insertion, h["old_start"] >= s["end"]).otherwise(h["old_start"] > s["end"])
        new_end = F.greatest(s["end"], last_old) + shift
        return (
            F.when(above, F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"), s["touched"].alias("touched")))
            .when(below, s)
            .otherwise(F.struct(F.least(s["start"], h["new_start"]).alias("start"), F.greatest(new_end, F.least(s["start"], h["new_start"])).alias("end"), F.lit(True).alias("touched")))
        )

    return F.aggregate(hunks, begin, step)


def first_rule(facts: DataFrame, key: Sequence[str], tiers: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Each fact with the rule of its first tier that has one, and there of the first position; else null.

    A tier is a rule table (its join columns, position, rule) and the columns it is joined on.
    """
    found = None
    for t, (rules, on) in enumerate(tiers):
        met = facts.join(rules, list(on)).select(*key, F.struct(F.lit(t).alias("tier"), "position").alias("at"), "rule")
        found = met if found is None else found.union(met)
    best = found.groupBy(*key).agg(F.min_by("rule", "at").alias("rule"), F.min("at.tier").alias("tier"))
    return facts.join(best, list(key), "left")


def packed(df: DataFrame, group: str, order: Sequence[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """``df`` with ``batch``: rows of a group in order, in batches closed before they pass either bound.

    The running sum starts anew with each batch, which no window can do; a group's rows stream through one task in order.
    """
    schema = df.withColumn("batch", F.lit(0)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, total, batch = None, 0, 0, 0
        for pdf in batches:
            numbers = []
            for g, s in zip(pdf[group], pdf[size]):
                if g != now:
                    now, n, total, batch = g, 0, 0, 0
                elif n >= most_rows or total + s > most_size:
                    n, total, batch = 0, 0, batch + 1
                n, total = n + 1, total + s
                numbers.append(batch)
            yield pdf.assign(batch=numbers)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def islands(df: DataFrame, keys: Sequence[str], low: str, high: str, gap: int = 1) -> DataFrame:
    """(keys, low, high, n): closed ranges that meet or lie within ``gap`` of each other, merged."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("opens", F.when(before.isNull() | (F.col(low) > before + gap), 1).otherwise(0))
    numbered = opened.withColumn("island", F.sum("opens").over(w))
    return numbered.groupBy(*keys, "island").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count("*").alias("n")).drop("island")
