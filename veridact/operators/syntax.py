"""Syntax trees and source lines as tables: projections, functions with their complexity, and slices.

A node table has file, ordinal (array<int>: the way from the root, child by child), type, field, named, text, start_line,
end_line and error. A node's ancestors are the prefixes of its ordinal, so every question about them is an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridact.session import cut

#: Steps from a declarator to the name inside it, at most.
DECLARATOR_DEPTH = 64
MAX_NAME_BYTES = 512
#: Rounds of backward definitions, and identifiers followed from a line; what goes beyond is a named gap.
MAX_ROUNDS, MAX_IDENTIFIERS = 8, 32


def _key(ordinal: Column) -> Column:
    """An ordinal as text, which joins and sorts plainly within one node's children."""
    return F.array_join(F.transform(ordinal, lambda k: k.cast("string")), ".")


def _above(nodes: DataFrame, including: bool = False) -> DataFrame:
    """(file, key, above, depth): every node with each of its ancestors, the root as the empty text."""
    n = F.size("ordinal")
    steps = F.sequence(F.lit(0), n if including else n - 1)
    some = nodes.filter(F.lit(True) if including else n > 0)
    return some.select("file", "key", F.explode(F.transform(steps, lambda k: F.struct(_key(F.slice("ordinal", F.lit(1), k)).alias("above"), k.alias("depth")))).alias("a")).select("file", "key", "a.*")


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left`` and ``right`` joined on file and ``on``. Both grow with the nodes, and repetitive trees are small as files and large in memory,
    so neither is broadcast by the size of its files."""
    return left.join(right.hint("merge"), ["file", on], how)


def _names(nodes: DataFrame, wanted: DataFrame, fields: Sequence[str], identifiers: Sequence[str]) -> DataFrame:
    """(file, key, name_key): the child that names each wanted node (file, key), through declarators down to the identifier."""
    parent = F.when(F.size("ordinal") > 0, _key(F.slice("ordinal", F.lit(1), F.size("ordinal") - 1)))
    children = nodes.withColumn("parent", parent).filter("parent IS NOT NULL")
    place = F.element_at("ordinal", -1)
    out, now = None, wanted.select("file", "key", F.col("key").alias("at"), F.lit(0).alias("round"))
    for k in range(DECLARATOR_DEPTH):
        order = {f: i for i, f in enumerate(fields if k == 0 else ("declarator", "name"))}
        rank = F.coalesce(*[F.when(F.col("field") == f, F.lit(i)) for f, i in order.items()], F.when(F.col("type").isin(*identifiers), F.lit(len(order))))
        met = _met(now, children.select("file", F.col("parent").alias("at"), F.col("key").alias("name_key"), "type", "field", rank.alias("rank"), place.alias("place")), "at").filter("rank IS NOT NULL")
        best = met.groupBy("file", "key").agg(F.min_by(F.struct("name_key", "type", "field"), F.struct("rank", "place")).alias("b")).select("file", "key", "b.*")
        deeper = (F.col("field") == "declarator") & ~F.col("type").isin(*identifiers)
        best = cut(best.withColumn("deeper", F.coalesce(deeper, F.lit(False))), "names")
        done = best.filter("NOT deeper").select("file", "key", "name_key")
        out = done if out is None else out.union(done)
        now = best.filter("deeper").select("file", "key", F.col("name_key").alias("at"), F.lit(k + 1).alias("round"))
        if now.isEmpty():
            break
    return out


def project(nodes: DataFrame, definitions: Sequence[str], calls: Sequence[str], imports: Sequence[str], identifiers: Sequence[str], indirect_imports: Sequence[str] = ()) -> DataFrame:
    """(file, key, category, written_name, enclosing, qualifiers, import_form) of every definition, call, import and reference.

    Names are as written, none is resolved. A name with an error, or longer than ``MAX_NAME_BYTES``, projects nothing. ``enclosing`` is
    the nearest definition around, ``qualifiers`` the last sixteen names of those around, outermost first.
    """
    keyed = cut(nodes.withColumn("key", _key(F.col("ordinal"))), "nodes")
    kind = F.col("type")
    category = F.when(kind.isin(*definitions), "definition").when(kind.isin(*calls), "call_expression").when(kind.isin(*imports), "import").when(kind.isin(*identifiers), "reference")
    marked = keyed.withColumn("category", category).filter("category IS NOT NULL")
    fields = {"definition": ("name", "declarator"), "call_expression": ("function", "name", "method", "constructor", "type"), "import": ("source", "path", "module_name", "name")}
    named = None
    for c, own in fields.items():
        found = _names(keyed, marked.filter(F.col("category") == c), own, identifiers)
        named = found if named is None else named.union(found)
    exported = keyed.filter("field = 'source'").select("file", _key(F.slice("ordinal", F.lit(1), F.size("ordinal") - 1)).alias("key")).distinct().withColumn("sourced", F.lit(True))
    marked = _met(_met(marked, named, "key", "left"), exported, "key", "left").filter("type <> 'export_statement' OR sourced")
    own = F.when(F.col("category").isin("reference", "import"), F.coalesce("name_key", "key")).otherwise(F.col("name_key"))
    texts = keyed.select("file", F.col("key").alias("anchor"), F.col("text").alias("written_name"), F.col("error").alias("bad"))
    written = _met(marked.withColumn("anchor", own), texts, "anchor").filter("NOT bad AND written_name <> ''").filter(F.octet_length("written_name") <= MAX_NAME_BYTES)
    written = cut(written.select("file", "key", "ordinal", "category", "written_name"), "written")
    around = _met(_above(written), written.filter("category = 'definition'").select("file", F.col("key").alias("above"), F.col("written_name").alias("outer")), "above")
    chain = around.groupBy("file", "key").agg(F.max_by("above", "depth").alias("enclosing"), F.array_sort(F.collect_list(F.struct("depth", "outer"))).alias("outers"))
    names = F.coalesce(F.transform("outers", lambda o: o["outer"]), F.array().cast("array<string>"))
    form = F.when(F.col("category") == "import", "syntax_declaration").when((F.col("category") == "call_expression") & F.col("written_name").isin(*indirect_imports, ""), "call_expression")
    out = _met(written, chain, "key", "left")
    return out.select("file", "key", "category", "written_name", "enclosing", F.slice(names, F.greatest(F.size(names) - 15, F.lit(1)), 16).alias("qualifiers"), form.alias("import_form"))


def functions(nodes: DataFrame, units: Sequence[str], decisions: Sequence[str], nesting: Sequence[str], flat: Sequence[str], boolean: Sequence[str], containers: Sequence[str], identifiers: Sequence[str]) -> DataFrame:
    """(file, key, qualified_name, start_line, end_line, cyclomatic, cognitive, max_nesting, parent, gaps) of every function.

    A node counts for the innermost function around it. Cyclomatic is one more than decisions and boolean operators; cognitive adds, for
    each nesting construct, one and the number of such constructs around it in the function, one for each flat one and for
    each boolean operator that doesn't continue the same operator of the expression around. Errors in the span are a gap.
    """
    keyed = cut(nodes.withColumn("key", _key(F.col("ordinal"))), "nodes")
    is_unit = F.col("type").isin(*units) & F.col("named")
    marks = keyed.filter(is_unit | F.col("type").isin(*nesting) | F.col("type").isin(*containers)).select(
        "file", F.col("key").alias("above"), is_unit.alias("unit"), (F.col("type").isin(*nesting) & F.col("named")).alias("nests"), F.col("type").isin(*containers).alias("holds"))
    around = cut(_met(_above(keyed), marks, "above"), "around")
    owner = around.filter("unit").groupBy("file", "key").agg(F.max_by("above", "depth").alias("owner"), F.max("depth").alias("owner_depth"))
    deep = _met(around.filter("nests"), owner, "key").filter("depth > owner_depth").groupBy("file", "key").agg(F.count("*").alias("nesting"))
    parent = keyed.select("file", F.col("key").alias("above"), F.col("type").alias("outer_type"))
    operator = F.when(~F.col("named") & F.col("type").isin(*boolean), F.col("type"))
    # an operator is a child of its expression, whose parent's own operator it continues or not
    tokens = keyed.filter(operator.isNotNull()).select("file", "key", operator.alias("operator"), _key(F.slice("ordinal", F.lit(1), F.greatest(F.size("ordinal") - 2, F.lit(0)))).alias("outer"))
    outer = keyed.filter(operator.isNotNull()).select("file", _key(F.slice("ordinal", F.lit(1), F.size("ordinal") - 1)).alias("outer"), operator.alias("outer_operator")).dropDuplicates(["file", "outer"])
    starts = _met(tokens, outer, "outer", "left").select("file", "key", (~F.col("operator").eqNullSafe(F.col("outer_operator"))).alias("opens"))
    own = _met(_met(_met(keyed, owner, "key"), deep, "key", "left"), starts, "key", "left").withColumn("nesting", F.coalesce("nesting", F.lit(0)))
    named, kind = F.col("named"), F.col("type")
    decides = (named & kind.isin(*decisions)) | F.col("opens").isNotNull()
    points = F.when(named & kind.isin(*nesting), 1 + F.col("nesting")).when(named & kind.isin(*flat), 1).when(F.col("opens"), 1).otherwise(0)
    inner = own.filter(~is_unit | ~F.col("named"))
    measured = inner.groupBy("file", F.col("owner").alias("key")).agg(F.count_if(decides).alias("decided"), F.sum(points).alias("cognitive"), F.max("nesting").alias("max_nesting"), F.bool_or("error").alias("bad"))
    found = keyed.filter(is_unit)
    names = _met(_names(keyed, keyed.filter(is_unit | F.col("type").isin(*containers)), ("name", "declarator"), identifiers), keyed.select("file", F.col("key").alias("name_key"), "text"), "name_key").select("file", "key", F.col("text").alias("name"))
    titled = _met(keyed.filter(is_unit | F.col("type").isin(*containers)), names, "key", "left").select("file", "key", F.coalesce("name", F.concat(F.lit("<anonymous:"), F.col("start_line").cast("string"), F.lit(">"))).alias("title"))
    chain = _met(_above(found, including=True), titled.withColumnRenamed("key", "above"), "above").groupBy("file", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "title"))), lambda t: t["title"]), ".").alias("qualified_name"))
    out = _met(_met(_met(found, measured, "key", "left"), chain, "key"), owner.select("file", "key", F.col("owner").alias("parent")), "key", "left")
    zero = F.lit(0)
    return out.select(
        "file", "key", "qualified_name", "start_line", "end_line", (1 + F.coalesce("decided", zero)).alias("cyclomatic"), F.coalesce("cognitive", zero).alias("cognitive"), F.coalesce("max_nesting", zero).cast("long").alias("max_nesting"), "parent",
        F.when(F.coalesce("bad", F.lit(False)) | F.col("error"), F.array(F.lit("parse_errors_in_span"))).otherwise(F.array().cast("array<string>")).alias("gaps"),
    )


def file_summary(functions_of: DataFrame, threshold: int) -> DataFrame:
    """(file, functions, total, highest, average, share_above): the complexity of a file's functions."""
    g = functions_of.groupBy("file").agg(F.count("*").alias("functions"), F.sum("cyclomatic").alias("total"), F.max("cyclomatic").alias("highest"), F.avg("cyclomatic").alias("average"), F.avg((F.col("cyclomatic") > threshold).cast("int")).alias("share_above"))
    return g


_ASSIGNS = r"(?:[-+*/%&|^]|<<|>>|//|\*\*)?=(?![=>])|:="


def tokenised(lines: DataFrame, comment: str, ignored: Sequence[str]) -> DataFrame:
    """(function, line, names, defines, right) of source lines: data names, those the line defines, and those right of its assignment.

    Literals and comments (from ``comment`` to the end) are removed; a name that a bracket follows is called, not read. A name is defined
    if an assignment, or ``++`` or ``--``, follows it, its index or its member.
    """
    literal = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
    plain = F.regexp_replace(F.regexp_replace(F.col("text"), literal, '""'), comment + ".*$", "")

    def data(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(r"(?<![\w.])([A-Za-z_]\w*)(?!\w)(?!\s*\()"), F.lit(1))
        return F.filter(F.array_distinct(found), lambda n: ~n.isin(*ignored))

    targets = F.regexp_extract_all(plain, F.lit(rf"(?<![\w.])([A-Za-z_]\w*)(?:\[[^\]]*\]|\s*(?:\.|->)\s*\w+)*\s*(?:{_ASSIGNS}|\+\+|--)"), F.lit(1))
    parts = F.split(plain, _ASSIGNS, 2)
    right = F.when(F.size(parts) > 1, data(F.get(parts, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return lines.select("function", "line", data(plain).alias("names"), F.array_distinct(targets).alias("defines"), right.alias("right"))


def lexical_slice(tokens: DataFrame, anchors: DataFrame, headers: DataFrame, rounds: int = MAX_ROUNDS, most: int = MAX_IDENTIFIERS) -> tuple[DataFrame, DataFrame]:
    """(function, line, reasons) of the lines that matter to the anchors, and (function, gap) of what was left out.

    ``tokens`` is :func:`tokenised`; ``anchors``: function, line; ``headers``: function, line, params (array). A function's header matters, any
    line that shares a data name with an anchor (interacter), and, backward from the anchors, every earlier line that defines a name
    followed, whose right side is followed in turn (backward_def), for so many rounds. A line follows at most ``most`` names.
    """
    params = headers.select("function", "line", F.col("params").alias("given"))
    known = cut(tokens.join(params, ["function", "line"], "left"), "tokens")
    defined = known.select("function", F.col("line").alias("at"), F.explode(F.array_distinct(F.concat("defines", F.coalesce("given", F.array().cast("array<string>"))))).alias("name"), F.col("given").isNotNull().alias("is_header"))
    read = known.join(anchors.distinct(), ["function", "line"], "left_semi")
    wide = read.filter(F.size("names") > most).select("function", F.concat(F.lit("truncated:anchor:"), F.col("line").cast("string")).alias("gap"))
    followed = read.select("function", F.explode(F.slice("names", 1, most)).alias("name")).distinct()
    shared = known.select("function", "line", F.explode("names").alias("name")).join(followed, ["function", "name"], "left_semi").select("function", "line").distinct().join(anchors, ["function", "line"], "left_anti")
    frontier = read.select("function", "line", F.explode(F.slice("names", 1, most)).alias("name"))
    seen, gaps = None, wide
    for k in range(rounds + 2):
        met = frontier.join(defined, ["function", "name"]).filter("at < line").select("function", F.col("at").alias("line"), "is_header").groupBy("function", "line").agg(F.bool_or("is_header").alias("is_header"))
        fresh = met if seen is None else met.join(seen, ["function", "line"], "left_anti")
        fresh = cut(fresh, "slice")
        if fresh.isEmpty():
            break
        if k > rounds:
            gaps = gaps.union(fresh.select("function", F.lit("truncated:rounds").alias("gap")).distinct())
            break
        seen = fresh.select("function", "line") if seen is None else cut(seen.union(fresh.select("function", "line")), "slice")
        source = known.join(fresh.filter("NOT is_header"), ["function", "line"], "left_semi")
        gaps = gaps.union(source.filter(F.size("right") > most).select("function", F.concat(F.lit("truncated:definition:"), F.col("line").cast("string")).alias("gap")))
        frontier = source.select("function", "line", F.explode(F.slice("right", 1, most)).alias("name"))
    why = lambda df, r: df.select("function", "line", F.lit(r).alias("reason"))
    marked = why(headers, "function_header").union(why(shared, "interacter"))
    if seen is not None:
        marked = marked.union(why(seen, "backward_def"))
    return marked.groupBy("function", "line").agg(F.array_sort(F.collect_set("reason")).alias("reasons")), gaps.distinct()


def memory_slice(loads: DataFrame, stores: DataFrame, anchors: DataFrame) -> DataFrame:
    """(function, line, reasons): stores that may reach the memory that an anchor's line reads. (function, line, objects) on both sides."""
    read = loads.join(anchors, ["function", "line"], "left_semi").select("function", F.col("line").alias("at"), F.explode("objects").alias("object"))
    written = stores.select("function", "line", F.explode("objects").alias("object"))
    met = written.join(read, ["function", "object"]).filter("line <> at").select("function", "line").distinct()
    return met.withColumn("reasons", F.array(F.lit("may_store")))


#: Strategies by name with their precision, least precise first: each takes what it needs and gives (function, line, reasons).
STRATEGIES: dict[str, int] = {"lexical": 0, "syntax": 1, "points_to": 2, "def_use": 3}


def composed(contributions: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> tuple[DataFrame, list[str]]:
    """(function, line, strategy, reasons): per line the most precise strategy that has it, with the reasons of all, and the gaps.

    A strategy that fails is a gap, and the others stand; an unknown name is refused.
    """
    whole, gaps = None, []
    for name, part in sorted(contributions.items()):
        if name not in STRATEGIES:
            raise KeyError(f"unknown strategy {name!r}")
        try:
            rows = part() if callable(part) else part
        except Exception as e:  # a strategy's own failure, whatever it is, is a gap by contract
            gaps.append(f"strategy_failed: {name}: {type(e).__name__}")
            continue
        rows = rows.select("function", "line", F.lit(STRATEGIES[name]).alias("precision"), F.lit(name).alias("strategy"), "reasons")
        whole = rows if whole is None else whole.union(rows)
    if whole is None:
        raise ValueError("no strategy gave anything")
    g = whole.groupBy("function", "line").agg(F.max_by("strategy", F.struct("precision", "strategy")).alias("strategy"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return g, gaps


def anchored_calls(calls: DataFrame, lines: DataFrame) -> DataFrame:
    """(function, callee, line, state): the line of decompiled text on which a function calls another.

    ``calls``: function, callee; ``lines``: function, line, text. Literals and comments say nothing. One call in the text anchors it; of several the
    first line is named and the state is ambiguous; without any it is not found.
    """
    plain = F.regexp_replace(F.regexp_replace("text", r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", '""'), r"//.*$|/\*.*?\*/", " ")
    placed = lines.select("function", "line", F.explode(F.regexp_extract_all(plain, F.lit(r"(?<!\w)([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("callee"))
    found = placed.groupBy("function", "callee").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    met = calls.select("function", "callee").distinct().join(found, ["function", "callee"], "left")
    return met.select("function", "callee", "line", F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("anchored").alias("state"))
