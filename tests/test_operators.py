import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veridact.functions import paths as P
from veridact.operators import aggregates as A
from veridact.operators import evidence as E
from veridact.operators import graph as G
from veridact.operators import joins as J
from veridact.operators import lifecycle as L
from veridact.operators import ranking as R
from veridact.operators import search as S
from veridact.operators import versions as V


def test_missing_metric_is_not_zero(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 5.0), ("c", 2.0, 5.0)], "k string, x double, y double")
    got = {r["k"]: r for r in R.instability(df, {"x": 1.0, "y": 1.0}, []).collect()}
    assert got["a"]["weight_coverage"] == 0.5 and got["a"]["missing_inputs"] == ["y"] and got["a"]["score"] == 0.0
    assert got["b"]["score"] == 50.0  # y is constant and scores 0


def test_entropy_of_one_is_positive_zero(spark):
    df = spark.createDataFrame([("a", "x", 5)], "k string, m string, n int")
    assert str(A.entropy(df, ["k"], "n").first()["entropy"]) == "0.0"


def test_ratio_and_wilson_without_trials(spark):
    r = spark.range(1).select(A.ratio(F.lit(0), F.lit(0)).alias("r"), A.wilson(F.lit(0), F.lit(0)).alias("w"), A.ratio(F.lit(None).cast("int"), F.lit(3)).alias("u")).first()
    assert (r["r"]["status"], r["r"]["value"], r["w"], r["u"]["status"]) == ("empty_denominator", None, None, "unavailable")


def test_closed_vocabulary_refuses_unknown_values(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert rows(A.closed_counts(df, "v", ["a", "b"])) == [("a", 1), ("b", 0), ("null", 1)]
    with pytest.raises(Exception, match="unknown v"):
        A.closed_counts(df, "v", ["b"]).collect()


def test_strict_sum_is_null_if_any_value_is(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    assert rows(df.groupBy("k").agg(A.strict_sum(F.col("v")).alias("s"))) == [("a", None), ("b", 2)]


def test_midrank_maps_zero_and_below_to_zero(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (5,), (9,), (None,)], "v int")
    assert rows(R.midrank(df, "v", "p")) == sorted([(-1, 0.0), (0, 0.0), (5, 0.6), (5, 0.6), (9, 0.9), (None, None)], key=repr)


def test_overlap_join_equals_nested_loops(spark):
    random.seed(3)
    a = [(i, random.randint(0, 3), s := random.randint(-50, 50), s + random.randint(0, 30)) for i in range(60)]
    b = [(i, random.randint(0, 3), s := random.randint(-50, 50), s + random.randint(0, 30)) for i in range(60)]
    da, db = spark.createDataFrame(a, "i long, k long, s long, e long"), spark.createDataFrame(b, "j long, k long, u long, v long")
    for tolerance in (0, 4):
        got = rows(J.overlap_join(da, db, ["k"], ("s", "e"), ("u", "v"), 7, tolerance).select("i", "j"))
        assert got == sorted(((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] - tolerance <= y[3] and y[2] <= x[3] + tolerance), key=repr)


def test_dyadic_cover_is_exact_and_disjoint(spark):
    cases = [(a, b) for a in range(0, 40) for b in range(a, 40)]
    got = spark.createDataFrame(cases, "a long, b long").select("a", "b", J.dyadic_cover(F.col("a"), F.col("b"), 6).alias("c")).collect()
    for r in got:
        points = [p for level, block in r["c"] for p in range(block << level, (block + 1) << level)]
        assert sorted(points) == list(range(r["a"], r["b"])), (r["a"], r["b"], r["c"])


def test_tiered_match_uses_each_row_once(spark):
    prior = spark.createDataFrame([(1, "x", "m"), (2, "x", "m"), (3, "y", "m")], "id int, e string, r string")
    current = spark.createDataFrame([(7, "x", "m"), (8, "z", "m"), (9, None, "m"), (10, None, None)], "id int, e string, r string")
    assert rows(J.tiered_match(prior, current, "id", [("exact", "e"), ("moved", "r")])) == [(1, 7, "exact"), (2, 8, "moved"), (3, 9, "moved")]


def test_as_of_strict_and_not(spark):
    left = spark.createDataFrame([("a", 5), ("a", 7)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "p"), ("a", 6, "q")], "k string, u int, v string")
    assert rows(J.as_of(left, right, ["k"], "t", "u", "v").select("t", "last_v")) == [(5, None), (7, "q")]
    assert rows(J.as_of(left, right, ["k"], "t", "u", "v", strict=False).select("t", "last_v")) == [(5, "p"), (7, "q")]


def test_longest_prefix_and_root(spark):
    df = spark.createDataFrame([(1, "a/b/c"), (2, "a/x"), (3, "z")], "i int, p string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert rows(J.longest_prefix(df, "p", roots, "root", ["i"]).select("i", "root")) == [(1, "a/b"), (2, "a"), (3, None)]


def test_version_order_and_range(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r["v"] for r in df.orderBy(V.version_key(F.col("v"))).collect()] == order
    same = spark.range(1).select((V.version_key(F.lit("1.2.3+a")) == V.version_key(F.lit("1.2.3"))).alias("x"), V.version_key(F.lit("1.2")).alias("n")).first()
    assert same["x"] and same["n"] is None
    events = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in (("introduced", "0"), ("fixed", "1.0.0"), ("introduced", "1.0.0"), ("last_affected", "2.0.0"))])
    got = spark.createDataFrame([("0.1.0",), ("1.0.0",), ("2.0.0",), ("2.0.1",), ("x",)], "v string").select("v", V.in_range(F.col("v"), events).alias("in")).collect()
    assert [r["in"] for r in got] == [True, True, True, False, None]


def test_layered_upsert_equals_replay(spark):
    random.seed(5)
    layers = [(random.choice("abc"), i, random.choice([None, 1, 2, 3])) for i in range(40)]
    alive = {}
    for k, i, m in layers:
        old = alive.get(k)
        if old is None or old[1] is None or m is None or m >= old[1]:
            alive[k] = (i, m)
    got = rows(L.layered_upsert(spark.createDataFrame(layers, "k string, layer int, m int"), "k", "layer", "m"))
    assert got == sorted(((k, i, m) for k, (i, m) in alive.items()), key=repr)


def test_neighbourhood_limit_and_frontier(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(G.neighbourhood(edges, seeds, 1)) == [("a", 0, True), ("b", 1, False), ("c", 1, False)]
    assert rows(G.neighbourhood(edges, seeds, 3, limit=2).select("node")) == [("a",), ("b",)]


def test_levels_name_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    done, rest = G.levels(edges)
    assert rows(done) == [("a", 0), ("b", 1), ("c", 2)] and rows(rest) == [("x",), ("y",)]


def test_components_and_dominators(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src long, dst long")
    assert {r["component"] for r in G.components(edges).collect()} == {0, 50}
    cfg = spark.createDataFrame([("f", s, d, "1") for s, d in (("1", "2"), ("1", "3"), ("2", "4"), ("3", "4"), ("4", "5"))], "graph string, src string, dst string, entry string")
    assert {r["node"]: r["idom"] for r in G.dominators(cfg, "graph", "entry").collect()} == {"1": None, "2": "1", "3": "1", "4": "1", "5": "4"}
    assert {r["node"]: r["idom"] for r in G.dominators(cfg, "graph", "entry", post=True).collect()} == {"5": None, "4": "5", "2": "4", "3": "4", "1": "4"}


def test_greedy_batches_close_before_a_bound(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([4, 4, 4, 9, 1, 1, 1])], "g string, i int, s int")
    assert [r["batch"] for r in G.packed(df, "g", ["i"], "s", 2, 8).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_span_mapping_of_insertions(spark):
    h = lambda *x: F.array(F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("old_start", "old_len", "new_start", "new_len"))]))
    r = spark.range(1).select(
        G.mapped_span(h(3, 0, 4, 2), F.lit(5), F.lit(8)).alias("above"), G.mapped_span(h(6, 0, 7, 2), F.lit(5), F.lit(8)).alias("inside"),
        G.mapped_span(h(8, 0, 9, 2), F.lit(5), F.lit(8)).alias("after"), G.mapped_span(h(5, 2, 5, 0), F.lit(5), F.lit(8)).alias("cut"),
    ).first()
    assert [tuple(x) for x in r] == [(7, 10, False), (5, 10, True), (5, 8, False), (5, 6, True)]


def test_globs(spark):
    cases = [("*.c", "a/b.c", True), ("src/*.c", "src/x/b.c", False), ("src/**/b.c", "src/b.c", True), ("**/t?st", "a/test", True), ("a/**", "a/b/c", True), ("a.c", "abc", False)]
    for pattern, path, want in cases:
        assert spark.range(1).select(P.matches_glob(F.lit(path), pattern).alias("m")).first()["m"] is want, pattern


def test_paths_names_and_identifiers(spark):
    r = spark.range(1).select(
        P.normalized_relative(F.lit("a//./b")), P.normalized_relative(F.lit("../x")), P.tail_name(F.lit("ns::C<int>::f(int, char)")), P.cwe_number(F.lit("CWE-079")), P.cwe_number(F.lit("x")),
        P.advisory_token(F.lit("cve-2024-1234")), P.plain_code(F.lit("a /* b */ = 1; // c\n d")), P.commit_refs(F.lit("fix CVE-2024-1111, cwe-79 and cve-2024-1111")), P.cvss_band(F.lit(9.8)), P.cvss_band(F.lit(None).cast("double")),
    ).first()
    assert list(r) == ["a/b", None, "f", 79, None, "CVE-2024-1234", "a = 1; d", ["CVE-2024-1111", "CWE-79"], "critical", "unknown"]


def test_cursors():
    key, request = b"k", {"tool": "find"}
    c = S.make_cursor(request, "m1", [3], key, expires=100)
    assert S.read_cursor(c, request, "m1", key, now=50) == [3]
    for bad in ((c, {"tool": "x"}, "m1", key, 50), (c, request, "m2", key, 50), (c, request, "m1", b"z", 50), (c, request, "m1", key, 100), ("AAAA" * 20, request, "m1", key, 50)):
        with pytest.raises(S.CursorError):
            S.read_cursor(*bad)


def test_contained_chains_go(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c"]), (3, ["a", "c"]), (4, ["a", "b", "c"])], "k int, c array<string>")
    assert [r["k"] for r in R.drop_contained(df, "c", "k").orderBy("k").collect()] == [1, 3, 4]


def test_identity_is_content(spark):
    a, b = spark.range(1).select(E.identity("function", "s1", "n"), E.identity("function", "s1", "m")).first()
    assert a.startswith("asr:function:") and len(a) == 13 + 64 and a != b


def test_points_interval(spark):
    bands = [(0, "low"), (5, "high")]
    r = spark.range(1).select(L.points_interval(F.lit(5), F.lit(0), F.lit(3), bands).alias("a"), L.points_interval(F.lit(3), F.lit(0), F.lit(3), bands).alias("b")).first()
    assert r["a"]["rating"] == "high" and r["b"]["rating"] is None


def test_current_paths_follow_renames_back(spark):
    from veridact.operators import replay

    rows_ = [("r", 0, "new", "mid"), ("r", 1, "mid", "old"), ("r", 2, "old", None), ("r", 2, "other", None), ("s", 0, "old", None)]
    df = spark.createDataFrame(rows_, "repo string, pos int, path string, was string")
    got = {(r["repo"], r["pos"], r["path"]): r["current_path"] for r in replay.current_paths(df, "repo", "pos", "path", "was").collect()}
    assert got == {("r", 0, "new"): "new", ("r", 1, "mid"): "new", ("r", 2, "old"): "new", ("r", 2, "other"): "other", ("s", 0, "old"): "old"}


def test_chains_repeat_no_step(spark):
    from veridact.operators import replay

    steps = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "step string, severity double")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = {"".join(r["chain"]): round(r["score"], 6) for r in replay.chains(steps, links, 3).collect()}
    assert got == {"ab": 3.1, "abc": 3.2, "ba": 3.1, "bc": 3.1}


def test_global_rank_equals_a_sort(spark):
    df = spark.createDataFrame([((i * 37) % 101, i) for i in range(300)], "a int, b int").repartition(5)
    got = [(r["a"], r["b"]) for r in R.global_rank(df, [F.col("a"), F.col("b").desc()]).orderBy("rank").collect()]
    assert got == sorted(((i * 37) % 101, i) for i in range(300)) or got == sorted((((i * 37) % 101, i) for i in range(300)), key=lambda x: (x[0], -x[1]))
    assert R.global_rank(df.limit(0), [F.col("a")]).count() == 0
