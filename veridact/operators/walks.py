"""Walks that go on until nothing new is found: calls, includes, links into processes, evidence, and what is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridact.functions.paths import collapsed
from veridact.session import cut

#: Starts that share a walk and whose finds one task gives, about.
STARTS_A_TASK = 1000


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node, distance): all that each seed can reach, itself at 0, by least distance; to the end if ``depth`` is None.

    ``seeds``: seed, node. ``edges``: src, dst. Level by level; only pairs of the last level are joined, and a pair seen before is
    left out, so cycles end. Each level is written, which ends its lineage; what was seen is written together every eight levels.
    """
    links = cut(edges.select("src", "dst").distinct(), "edges")
    layer = cut(seeds.select("seed", "node").distinct().withColumn("distance", F.lit(0)), "reach")
    seen, d = layer, 0
    while depth is None or d < depth:
        d += 1
        found = layer.join(links, layer["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        layer = cut(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(d)), "reach")
        if layer.isEmpty():
            break
        seen = seen.union(layer) if d % 8 else cut(seen.union(layer), "reach")
    return seen


def shared_reach(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node, distance): what :func:`reach` finds from each of ``starts`` (node) but the start itself; ``depth`` is 1 or more.

    Starts whose edges lead to the same nodes reach the same, so one of them walks for all, and what is written grows with the different
    sets of first steps, not with the result. A set is told by its size and 192 bits. The result joins starts with their set's finds where
    it is read; the finds of a set with many starts are dealt to several tasks.
    """
    links = cut(edges.select("src", "dst").distinct(), "edges")
    own = links.join(starts.select(F.col("node").alias("src")).distinct().hint("merge"), "src", "left_semi")
    steps = F.struct(F.count("*"), F.bit_xor(F.xxhash64("dst")), F.bit_xor(F.xxhash64(F.lit(7), "dst")), F.sum(F.xxhash64(F.lit(11), "dst").cast("decimal(38,0)")))
    sets = cut(own.groupBy(F.col("src").alias("seed")).agg(steps.alias("steps")), "steps")
    walkers = sets.groupBy("steps").agg(F.min("seed").alias("walker"), F.ceil(F.count("*") / STARTS_A_TASK).alias("parts"))
    known = cut(sets.join(walkers.hint("merge"), "steps").select("seed", "walker", F.pmod(F.xxhash64("seed"), F.col("parts")).alias("part"), "parts"), "walkers")
    first = own.join(known.filter("seed = walker").select(F.col("walker").alias("src")).hint("merge"), "src", "left_semi")
    walked = reach(links, first.select(F.col("src").alias("seed"), F.col("dst").alias("node")), None if depth is None else depth - 1)
    dealt = walked.join(known.filter("seed = walker").select("seed", "parts").hint("merge"), "seed").select(F.col("seed").alias("walker"), "node", (F.col("distance") + 1).alias("distance"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return known.select("seed", "walker", "part").join(dealt.hint("merge"), ["walker", "part"]).filter("seed <> node").select("seed", "node", "distance")


def call_sites(calls: DataFrame, subjects: DataFrame, mode: str, depth: int, families: Sequence[str] = (), sink_classes: Sequence[str] = ()) -> DataFrame:
    """(subject, caller, callee, family, sink_class, distance): the calls around each subject, nearest first, within ``depth`` steps.

    ``calls``: caller, callee, family, sink_class. ``mode`` is callers or callees. Filters choose what is returned, not what is
    walked: a call on the way counts even if it is of another family. A bound above 4 is refused.
    """
    if not 1 <= depth <= 4:
        raise ValueError("depth must be within 1..4")
    if mode not in ("callers", "callees"):
        raise ValueError(f"unknown mode {mode!r}")
    near, far = ("caller", "callee") if mode == "callees" else ("callee", "caller")
    walked = reach(calls.select(F.col(near).alias("src"), F.col(far).alias("dst")), subjects.select(F.col("subject").alias("seed"), F.col("subject").alias("node")), depth - 1)
    found = calls.join(walked, calls[near] == walked["node"]).select(F.col("seed").alias("subject"), "caller", "callee", "family", "sink_class", (F.col("distance") + 1).alias("distance"))
    if families:
        found = found.filter(F.col("family").isin(*families))
    if sink_classes:
        found = found.filter(F.col("sink_class").isin(*sink_classes))
    return found.groupBy("subject", "caller", "callee", "family", "sink_class").agg(F.min("distance").alias("distance"))


def resolved_includes(asked: DataFrame, includes: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """(unit, path, header): for each file of a unit, the headers that its include lines mean.

    ``asked``: unit, path. ``includes``: path, quoted, name. ``files``: path. ``directories``: unit, quoted (true for those that only
    quoted names look in first), place, directory. A quoted name is looked for beside the file, then in the unit's directories in order;
    the first that holds it wins. A name that no directory holds, or that leaves the tree, is not resolved.
    """
    lines = asked.join(includes, "path")
    beside = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    own = lines.filter("quoted").withColumns({"place": F.lit(-1).cast("long"), "directory": beside})
    searched = lines.join(directories.select("unit", F.col("quoted").alias("for_quoted"), F.col("place").cast("long").alias("place"), "directory"), "unit").filter(~F.col("for_quoted") | F.col("quoted")).drop("for_quoted")
    tried = own.unionByName(searched).withColumn("header", collapsed(F.concat_ws("/", F.when(F.col("directory") != "", F.col("directory")), F.col("name"))))
    held = tried.join(files.select(F.col("path").alias("header")).distinct(), "header", "left_semi")
    return held.groupBy("unit", "path", "quoted", "name").agg(F.min_by("header", "place").alias("header")).select("unit", "path", "header").distinct()


def include_closure(units: DataFrame, includes: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """(unit, path): every file that a unit's main file includes, directly or not, the main file itself among them.

    A unit's directories decide what a name means, so units that look in the same directories in the same order resolve their lines as one, to
    the fixpoint. Of these, units whose main files include the same headers share one walk.
    """
    includes, files = cut(includes.select("path", "quoted", "name").distinct(), "includes"), cut(files.select("path").distinct(), "includes")
    order = directories.groupBy("unit").agg(F.to_json(F.array_sort(F.collect_set(F.struct("quoted", "place", "directory")))).alias("order"))
    known = cut(units.select("unit", "main").distinct().join(order.hint("merge"), "unit", "left").withColumn("order", F.coalesce("order", F.lit("[]"))), "includes")
    known = cut(known.join(known.groupBy("order").agg(F.min("unit").alias("searcher")), "order").select("unit", "main", "searcher"), "includes")
    searched = cut(directories.join(known.select(F.col("searcher").alias("unit")).distinct(), "unit", "left_semi"), "includes")
    layer = cut(known.select(F.col("searcher").alias("unit"), F.col("main").alias("path")).distinct(), "includes")
    seen, lines = layer, None
    while not layer.isEmpty():
        found = cut(resolved_includes(layer, includes, files, searched), "includes")
        lines = found if lines is None else lines.union(found)
        layer = cut(found.select("unit", F.col("header").alias("path")).distinct().join(seen, ["unit", "path"], "left_anti"), "includes")
        seen = cut(seen.union(layer), "includes")
    main = known.select("unit", F.col("main").alias("path"))
    if lines is None:
        return main
    at = lambda unit, path: F.struct(F.col(unit).alias("unit"), F.col(path).alias("path"))
    walked = shared_reach(lines.select(at("unit", "path").alias("src"), at("unit", "header").alias("dst")), known.select(at("searcher", "main").alias("node")))
    through = known.select("unit", at("searcher", "main").alias("seed")).join(walked.hint("merge"), "seed").select("unit", F.col("node.path").alias("path"))
    return main.union(through).distinct()


def units_of_seeds(units: DataFrame, closure: DataFrame, seeds: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Which units can hold each seed, at most ``most`` units in all: (seed, unit, kept), and (seed) of those without a kept unit.

    ``units``: unit, main. ``seeds``: seed, rank, path. A seed in a main file belongs to that unit alone; any other to all units that
    include its file. Units are admitted in order of the seeds' ranks and then of main file and unit; ``kept`` is false beyond the bound.
    """
    direct = seeds.join(units, seeds["path"] == units["main"]).select("seed", "rank", "unit", "main")
    rest = seeds.join(direct.select("seed").distinct(), "seed", "left_anti")
    through = rest.join(closure, "path").join(units, "unit").select("seed", "rank", "unit", "main")
    met = direct.union(through)
    first = met.groupBy("unit").agg(F.min(F.struct("rank", "seed", "main", "unit")).alias("turn"))
    admitted = first.orderBy("turn").limit(most).select("unit", F.lit(True).alias("kept"))
    marked = met.join(admitted, "unit", "left").select("seed", "unit", F.coalesce("kept", F.lit(False)).alias("kept"))
    return marked, seeds.select("seed").join(marked.filter("kept").select("seed").distinct(), "seed", "left_anti")


def folded(links: DataFrame, libraries: DataFrame, processes: DataFrame) -> DataFrame:
    """(library, process): the processes that a library is linked into, directly or through other libraries.

    ``links``: input, output. ``libraries``: library. ``processes``: process. What is neither ends a path; cycles end.
    """
    known = libraries.select("library").distinct()
    outward = links.join(known, links["input"] == known["library"], "left_semi").select(F.col("input").alias("src"), F.col("output").alias("dst"))
    reached = reach(outward, known.select(F.col("library").alias("seed"), F.col("library").alias("node")))
    # a library may have a process's name, so the start counts only if a link leads back to it
    met = reached.join(outward, reached["node"] == outward["src"]).select(F.col("seed").alias("library"), F.col("dst").alias("process")).distinct()
    return met.join(processes.select("process").distinct(), "process", "left_semi").select("library", "process")


def owners(sites: DataFrame, things: DataFrame, reaches: DataFrame) -> DataFrame:
    """(site, process, rule): which processes own a site: by unit (narrowed to those that list its file), by file, or by longest root.

    ``sites``: site, unit, path. ``things``: thing, units, paths, roots (arrays). ``reaches``: thing, process. A site whose rule finds
    nothing has a null process and the rule source_root.
    """
    by_unit = things.select("thing", F.explode("units").alias("unit")).distinct()
    by_path = things.select("thing", F.explode("paths").alias("path")).distinct()
    by_root = things.select("thing", F.explode("roots").alias("root")).distinct()
    of_unit = sites.join(by_unit, "unit").select("site", "thing")
    of_path = sites.join(by_path, "path").select("site", "thing")
    both = of_unit.intersect(of_path)
    narrowed = both.select("site", "thing", F.lit("source_path").alias("rule"))
    unit_only = of_unit.join(both.select("site").distinct().hint("merge"), "site", "left_anti").select("site", "thing", F.lit("build_unit").alias("rule"))
    listed = of_path.join(of_unit.select("site").distinct().hint("merge"), "site", "left_anti").select("site", "thing", F.lit("source_path").alias("rule"))
    settled = narrowed.union(unit_only).union(listed)
    open_ = sites.join(settled.select("site").distinct().hint("merge"), "site", "left_anti").filter("path IS NOT NULL")
    starts = open_.select("site", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("root"))
    met = starts.join(by_root, "root")
    longest = met.groupBy("site").agg(F.max(F.length("root")).alias("n"))
    rooted = met.join(longest.hint("merge"), "site").filter(F.length("root") == F.col("n")).select("site", "thing", F.lit("source_root").alias("rule"))
    found = settled.union(rooted)
    owned = found.join(reaches, "thing").select("site", "process", "rule").distinct()
    rules = found.select("site", "rule").distinct()
    return sites.select("site").join(rules.hint("merge"), "site", "left").join(owned.hint("merge"), ["site", "rule"], "left").select("site", "process", F.coalesce("rule", F.lit("source_root")).alias("rule"))


def supporting(relations: DataFrame, starts: DataFrame, kinds: Sequence[str] = ("SUPPORTS", "DERIVED_FROM"), hops: int = 2) -> DataFrame:
    """(identity, evidence, hops): what supports an identity, directly or by what that is derived from, by least number of steps.

    ``relations``: source, kind, target; a SUPPORTS relation points at what is supported, a DERIVED_FROM relation at what it is derived from.
    """
    kept = relations.filter(F.col("kind").isin(*kinds))
    toward = kept.select(F.when(F.col("kind") == "SUPPORTS", F.col("target")).otherwise(F.col("source")).alias("src"), F.when(F.col("kind") == "SUPPORTS", F.col("source")).otherwise(F.col("target")).alias("dst"))
    found = shared_reach(toward, starts.select(F.col("identity").alias("node")), hops)
    return found.select(F.col("seed").alias("identity"), F.col("node").alias("evidence"), F.col("distance").alias("hops"))


def retained(objects: DataFrame, references: DataFrame, roots: Column) -> DataFrame:
    """``objects`` (object, ...) with ``kept``: roots, and whatever a kept object refers to, however far. ``references``: src, dst."""
    seeds = objects.filter(roots).select(F.lit(0).alias("seed"), F.col("object").alias("node"))
    kept = reach(references, seeds).select(F.col("node").alias("object"), F.lit(True).alias("kept")).distinct()
    return objects.join(kept, "object", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def reduced_parents(parents: DataFrame) -> DataFrame:
    """(child, parent): the parents that no other parent of the child leads to. ``parents``: child, parent, without cycles.

    Each direct parent's ancestors are walked from the parents alone, not from all pairs.
    """
    direct = parents.select("child", "parent").filter("child <> parent").distinct()
    tops = direct.select(F.col("parent").alias("seed"), F.col("parent").alias("node")).distinct()
    above = reach(direct.select(F.col("child").alias("src"), F.col("parent").alias("dst")), tops).filter("distance > 0").select(F.col("seed").alias("other"), F.col("node").alias("parent"))
    implied = direct.select("child", F.col("parent").alias("other")).join(above, "other").select("child", "parent").distinct()
    return direct.join(implied, ["child", "parent"], "left_anti")


def levelled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, level) by longest path from a source, and (node) of those on or behind a cycle, which have no level. No bound on depth."""
    links = cut(edges.select("src", "dst").distinct(), "levels")
    waits = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("waits"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    rest = cut(nodes.join(waits, "node", "left").select("node", F.coalesce("waits", F.lit(0)).alias("waits")), "levels")
    done, level = None, 0
    while True:
        ready = cut(rest.filter("waits = 0").select("node", F.lit(level).alias("level")), "levels")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        freed = links.join(ready, links["src"] == ready["node"], "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("freed"))
        rest = cut(rest.filter("waits > 0").join(freed, "node", "left").select("node", (F.col("waits") - F.coalesce("freed", F.lit(0))).alias("waits")), "levels")
        level += 1
    none = rest.select("node", F.lit(0).alias("level")).limit(0)
    return (none if done is None else done), rest.select("node")


def co_changed(df: DataFrame, group: str, member: str, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(left, right, support) with left < right of members that share ``least`` groups or more, and (group, n) of the groups left out.

    A group of over ``most`` members says nothing about coupling; it is left out of support, and returned, never silently.
    """
    rows = df.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    bulk = sizes.filter(F.col("n") > most)
    kept = rows.join(bulk.select("g"), "g", "left_anti")
    lists = kept.groupBy("g").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    left = lists.select(F.posexplode("ms").alias("at", "left"), "ms")
    pairs = left.select("left", F.explode(F.slice("ms", F.col("at") + 2, F.size("ms"))).alias("right")).groupBy("left", "right").agg(F.count("*").alias("support"))
    return pairs.filter(F.col("support") >= least), bulk.withColumnRenamed("g", group)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in order, with ``omitted``: how many more there are."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("omitted", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return out.filter(F.col("place") <= n)
