"""Decision tables, versions, walks, syntax and logs on their edge cases."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veridact.functions.paths import collapsed, glob_regex
from veridact.operators import change as C
from veridact.operators import decisions as D
from veridact.operators import findings as O
from veridact.operators import syntax as S
from veridact.operators import versions as V
from veridact.operators import walks as W
from veridact.session import discard, shared_path
from veridact.sources import logs, pages


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def adjudicated(spark, relations, required=("source_to_sink_reachability", "guard_absent"), independent=True, existing=(), duplicate_of=None, affected=("e",), scope=("e",)):
    claims = spark.createDataFrame([("c", duplicate_of, list(affected), list(scope), independent)], "claim_id string, duplicate_of string, affected array<string>, scope array<string>, verifier_independent boolean")
    rel = spark.createDataFrame([("c", *r) for r in relations], "claim_id string, predicate string, kind string, counted boolean")
    req = spark.createDataFrame([("c", p) for p in required], "claim_id string, predicate string")
    done = spark.createDataFrame([(e,) for e in existing], "claim_id string")
    r = D.adjudicate(claims, rel, req, done).first()
    return r["deciding_row"], r["state"], r["duplicate_of"], r["gaps"]


def test_adjudication_rows_in_order(spark):
    path, guard = "source_to_sink_reachability", "guard_absent"
    both = [(path, "supports", True), (guard, "supports", True)]
    assert adjudicated(spark, both, existing=("c",)) == ("r1_duplicate", "duplicate", "c", [])
    assert adjudicated(spark, both, existing=("d",), duplicate_of="d") == ("r1_duplicate", "duplicate", "d", [])
    assert adjudicated(spark, both, affected=("x",))[:2] == ("r2_out_of_scope", "out_of_scope")
    assert adjudicated(spark, [*both, (path, "contradicts", True)]) == ("r3_unresolved_contradiction", "insufficient_evidence", None, [f"unresolved_contradiction:{path}"])
    assert adjudicated(spark, [(path, "contradicts", True)])[:2] == ("r4_direct_contradiction", "not_reachable")
    assert adjudicated(spark, [(guard, "contradicts", True)])[:2] == ("r4_direct_contradiction", "contradicted")
    assert adjudicated(spark, both)[:2] == ("r5_confirmed", "confirmed")
    assert adjudicated(spark, both, independent=False) == ("r6_supported", "supported", None, [])
    assert adjudicated(spark, [(path, "supports", True), (guard, "supports", False)]) == ("r6_supported", "supported", None, [f"missing_direct_evidence:{guard}"])
    assert adjudicated(spark, [])[0] == "r7_insufficient_evidence" and adjudicated(spark, [], required=())[0] == "r5_confirmed"


def test_guards_bound_from_above_only(spark):
    kind = "struct<state:string,constrains:boolean,object_bytes:int,operator:string,left:int,right:int,polarity:string>"
    rows = [("dominating", True, 16, "<", None, 17, "true_branch"), ("dominating", True, 16, "<=", None, 17, "true_branch"), ("dominating", True, 16, ">", None, 16, "false_branch"), ("dominating", True, 16, ">", 10, None, "true_branch"),
            ("partial", True, 16, "<", None, 1, "true_branch"), ("dominating", None, 16, "<", None, 1, "true_branch"), ("dominating", True, None, "<", None, 1, "true_branch"), ("dominating", True, 16, "<", 1, 1, "true_branch")]
    df = spark.createDataFrame([(r,) for r in rows], f"g {kind}").select(D.guard_bound(F.col("g")).alias("d"))
    assert [r["d"]["reason"] for r in df.collect()] == ["n < 17", "exceeds_destination", "n <= 16", "n < 10", "not_dominating", "operand_not_constrained", "destination_size_unknown", "both_constant"]


def test_versions_are_strict(spark):
    texts = ["v1.0.0", "1.0.0-01", "1.0", "01.2.3", "1.2.3-a.01", "1.2.3-0a", "1.2.3-", "1.2.3+", "1.2.3\n", "1.2.3-0"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.version_key(F.col("t")).isNotNull().alias("ok")).collect()
    assert [r["t"] for r in got if r["ok"]] == ["1.2.3-0a", "1.2.3-0"]


@pytest.mark.parametrize("events, inside", [
    ([("introduced", "0"), ("fixed", "1.0.0")], {"0.9.0"}), ([("introduced", "1.0.0"), ("last_affected", "1.0.0")], {"1.0.0"}),
    ([("introduced", "0"), ("fixed", "1.0.0"), ("introduced", "1.0.0")], {"0.9.0", "1.0.0", "2.0.0"}), ([("introduced", "0"), ("limit", "1.0.0")], {"0.9.0"}),
    ([("introduced", "0"), ("limit", "1.0.0"), ("limit", "*")], {"0.9.0", "1.0.0", "2.0.0"}), ([("introduced", "0"), ("limit", "1.0.0"), ("limit", "1.5.0")], {"0.9.0", "1.0.0"}),
    ([("fixed", "1.0.0")], None), ([("introduced", "x")], None), ([], None), ([("odd", "1.0.0"), ("introduced", "0")], None),
])
def test_ranges_sweep_events_and_limits(spark, events, inside):
    df = spark.createDataFrame([(v, events) for v in ("0.9.0", "1.0.0", "2.0.0")], "v string, e array<struct<kind:string,version:string>>")
    got = {r["v"]: r["x"] for r in df.select("v", V.in_range(F.col("v"), F.col("e")).alias("x")).collect()}
    assert ({v for v, x in got.items() if x} == inside) if inside is not None else set(got.values()) == {None}


def test_walks_end_on_cycles_and_go_as_far_as_there_is(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 0)], "src long, dst long")
    found = W.reach(chain, spark.createDataFrame([(0, 0)], "seed long, node long"))
    assert found.agg(F.max("distance"), F.count("*")).first()[:] == (70, 71)
    with pytest.raises(ValueError):
        W.call_sites(chain, chain, "callers", 5)
    done, rest = W.levelled(chain.filter("src < 70"))
    assert done.agg(F.max("level")).first()[0] == 70 and rest.count() == 0
    done, rest = W.levelled(chain)
    assert done.count() == 0 and rest.count() == 71


def test_includes_shadow_in_order_and_stay_in_the_tree(spark):
    units = spark.createDataFrame([("u", "src/m.c")], "unit string, main string")
    files = spark.createDataFrame([("src/m.c",), ("src/a.h",), ("inc/a.h",), ("inc/b.h",), ("sys/b.h",)], "path string")
    includes = spark.createDataFrame([("src/m.c", True, "a.h"), ("src/m.c", False, "b.h"), ("src/a.h", True, "../../etc/x.h"), ("inc/b.h", True, "missing.h"), ("inc/b.h", True, "../src/m.c")], "path string, quoted boolean, name string")
    directories = spark.createDataFrame([("u", False, 2, "sys"), ("u", False, 1, "inc")], "unit string, quoted boolean, place int, directory string")
    assert sorted(r["path"] for r in W.include_closure(units, includes, files, directories).collect()) == ["inc/b.h", "src/a.h", "src/m.c"]
    texts = {"a/./b//c": "a/b/c", "a/../b": "b", "../a": None, "/a": None, "a/..": None, "a/b/../../c": "c"}
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", collapsed(F.col("t")).alias("x")).collect()}
    assert got == texts


def test_bulk_changes_are_left_out_and_counted(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), *[(3, f"x{i}") for i in range(9)], (3, "a"), (3, "b")]
    pairs, bulk = W.co_changed(spark.createDataFrame(rows, "c long, p string"), "c", "p", 2, 5)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 2)] and [tuple(r) for r in bulk.collect()] == [(3, 11)]


def test_slices_follow_definitions_backward(spark):
    text = ["int f(int n) {", "  int a = n;", "  b = a + 1; // c", '  s = "b";', "  a++;", "  g(b, a);", "  z = 1;"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "function string, line int, text string")
    tokens = S.tokenised(lines, "//", ["int"])
    anchors, headers = spark.createDataFrame([("f", 6)], "function string, line int"), spark.createDataFrame([("f", 1, ["n"])], "function string, line int, params array<string>")
    found, gaps = S.lexical_slice(tokens, anchors, headers)
    assert {r["line"]: r["reasons"] for r in found.collect()} == {1: ["backward_def", "function_header"], 2: ["backward_def", "interacter"], 3: ["backward_def", "interacter"], 5: ["backward_def", "interacter"]}
    assert gaps.count() == 0
    _, gaps = S.lexical_slice(tokens, anchors, headers, rounds=0)
    assert [r["gap"] for r in gaps.collect()] == ["truncated:rounds"]
    with pytest.raises(KeyError):
        S.composed({"guess": found})


def test_fair_share_never_starves_a_lane(spark):
    rows = [("lead", f"l{i}", i) for i in range(3)] + [("hunt", f"h{i}", i) for i in range(9)]
    df = spark.createDataFrame(rows, "lane string, package string, rank int")
    order = [r["package"] for r in O.fair_share(df, 0.5, 8).orderBy("turn").collect()]
    assert order == ["l0", "h0", "l1", "h1", "l2", "h2", "h3", "h4"]
    assert [r["package"] for r in O.fair_share(df, 0.0, 3).orderBy("turn").collect()] == ["h0", "h1", "h2"]


def test_time_stamps_need_offsets(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01t00:00:00+02:00", "2024-01-01T00:00:00", "2024-02-30T00:00:00Z", "2024-01-01"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.rfc3339(F.col("t")).isNotNull().alias("x")).collect()
    assert [r["x"] for r in got] == [True, True, False, False, False]


@pytest.mark.parametrize("pattern, yes, no", [
    ("*.c", ["a.c", "x/y/a.c"], ["a.cc"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "a/xb"]), ("a/**", ["a/b", "a/b/c"], ["a", "ba/b"]), ("a?/*.h", ["ab/x.h"], ["a/x.h", "ab/c/x.h"]), ("x**y/z", ["xy/z"], []), ("a.b/c", ["a.b/c"], ["aXb/c"]),
])
def test_globs(pattern, yes, no):
    import re

    assert all(re.match(glob_regex(pattern), p) for p in yes) and not any(re.match(glob_regex(pattern), p) for p in no)


def write(path, records, tail=b""):
    path.write_bytes(b"".join(json.dumps(r).encode() + b"\n" for r in records) + tail)


def test_logs_are_followed_and_begun_anew(tmp_path):
    path, rows = tmp_path / "log", [{"sequence": i, "kind": "p" if i % 2 else f"e{i}"} for i in range(1, 8)]
    assert logs.read_page(str(path)).status == "missing"
    write(path, rows[:4], b'{"sequence": 5')
    page = logs.read_page(str(path), max_records=3)
    assert [r["sequence"] for r in page.records] == [1, 2, 3] and page.status == "backlog"
    page = logs.read_page(str(path), page.cursor)
    assert [r["sequence"] for r in page.records] == [4] and page.status == "torn_tail" and page.reset is None
    write(path, rows)
    os.utime(path)
    again = logs.read_page(str(path), page.cursor)
    assert [r["sequence"] for r in again.records] == [5, 6, 7] and again.status == "caught_up"
    other = tmp_path / "other"
    write(other, rows[:2])
    os.replace(other, path)
    assert logs.read_page(str(path), again.cursor).reset == "log_replaced_or_truncated"
    os.remove(path)
    assert logs.read_page(str(path), again.cursor).reset == "log_removed"
    write(path, [rows[0], rows[2]])
    with pytest.raises(logs.LogError):
        logs.read_page(str(path))
    with pytest.raises(ValueError):
        logs.read_page(str(path), logs.Cursor(5, 0))


def test_followers_refuse_beyond_capacity(tmp_path):
    path = tmp_path / "log"
    write(path, [{"sequence": i, "kind": "p" if i % 2 else f"e{i}"} for i in range(1, 8)])
    follower = logs.Follower(str(path), lambda r: r["kind"], 3)
    assert follower.poll(max_records=4) == "backlog" and sorted(follower.held) == ["e2", "e4", "p"]
    at = follower.cursor
    assert follower.poll(max_records=4) == "capacity_reached" and follower.cursor == at
    follower.capacity = 9
    assert follower.poll() == "caught_up" and follower.held["p"]["sequence"] == 7
    assert [r["sequence"] for r in logs.records(str(path))] == list(range(1, 8))


def test_pages_end_with_named_gaps():
    def request(name, page):
        if name == "limited" and page == 2:
            raise pages.Stopped("rate_limited")
        if name == "back" and page == 2:
            return pages.Reply(200, [{"id": 9}], 1)
        return pages.Reply(200, [{"id": 1}, {"id": page}], page + 1 if page < 3 else None)

    def end(name, **kw):
        rows = list(pages.paginate(request, name, lambda r: str(r["id"]), **({"max_pages": 9, "max_records": 9} | kw)))
        return [r["key"] for r in rows[:-1]], rows[-1]["gap"], rows[-1]["duplicates"]

    assert end("all") == (["1", "2", "3"], None, 3)
    assert end("limited") == (["1"], "rate_limited", 1) and end("back") == (["1", "9"], "page_malformed", 1)
    assert end("all", max_pages=2)[1] == "pagination_bound_reached" and end("all", max_records=2) == (["1", "2"], "pagination_bound_reached", 3)


def test_shared_paths_are_named_and_discarded(spark):
    path = shared_path(spark, "test")
    spark.range(3).write.parquet(path)
    assert discard(spark) >= 1 and not os.path.exists(path)


@pytest.fixture
def written(monkeypatch):
    """How many rows walks write, cut by cut."""
    counts, cut = [], W.cut

    def counted(df, tag):
        out = cut(df, tag)
        counts.append(out.count())
        return out

    monkeypatch.setattr(W, "cut", counted)
    return counts


def test_supporting_shares_the_walk_of_equal_starts(spark, written, monkeypatch):
    n, r = 300, random.Random(5)
    kinds = ["SUPPORTS", "DERIVED_FROM", "MENTIONS"]
    around = [(f"d{i}", "DERIVED_FROM", "hub") for i in range(n)] + [(f"s{i}", "SUPPORTS", "hub") for i in range(n)]
    mixed = [(f"x{r.randrange(30)}", r.choice(kinds), f"x{r.randrange(30)}") for _ in range(70)]
    for rows, a_task in ((around, 1000), (around, 7), (mixed, 2)):
        monkeypatch.setattr(W, "STARTS_A_TASK", a_task)
        edges = {(t, s) if k == "SUPPORTS" else (s, t) for s, k, t in rows if k != "MENTIONS"}
        want = {(a, c): 2 for a, b in edges for x, c in edges if b == x and a != c} | {(a, b): 1 for a, b in edges if a != b}
        names = sorted({x for s, _, t in rows for x in (s, t)})
        written.clear()
        found = W.supporting(spark.createDataFrame(rows, "source string, kind string, target string"), spark.createDataFrame([(x,) for x in names], "identity string"))
        got = [((x["identity"], x["evidence"]), x["hops"]) for x in found.collect()]
        assert len(got) == len(want) and dict(got) == want
        assert rows is mixed or (len(want) == n * n + 2 * n and sum(written) < 20 * n)


def test_include_closure_shares_the_walk_of_equal_units(spark, written):
    n, m = 200, 30
    r = random.Random(6)
    units = [(i, f"src/m{i}.c") for i in range(n)]
    includes = [(f"src/m{i}.c", False, f"h{i % 2}.h") for i in range(n)] + [(f"{d}/h{i}.h", False, f"h{j}.h") for d in ("a", "b") for i in range(m) for j in {(i + 2) % m, r.randrange(m)}]
    files = [(f"a/h{i}.h",) for i in range(m)] + [(f"b/h{i}.h",) for i in range(0, m, 3)] + [(p,) for _, p in units]
    directories = [(i, False, p, d) for i in range(n) for p, d in enumerate(("a", "b") if i % 3 else ("b", "a"))]
    held, looks = {p for p, in files}, {}
    for u, _, p, d in directories:
        looks.setdefault(u, {})[p] = d
    want = set()
    for u, main in units:
        front = [main]
        while front:
            p = front.pop()
            if (u, p) not in want:
                want.add((u, p))
                for q, _, name in includes:
                    if q == p:
                        front += [f"{looks[u][k]}/{name}" for k in sorted(looks[u]) if f"{looks[u][k]}/{name}" in held][:1]
    frames = [spark.createDataFrame(x, s) for x, s in ((units, "unit long, main string"), (includes, "path string, quoted boolean, name string"), (files, "path string"), (directories, "unit long, quoted boolean, place int, directory string"))]
    got = [tuple(x) for x in W.include_closure(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(written) < len(want)


def test_a_path_that_comes_twice_is_not_claimed_twice(spark):
    paths = spark.createDataFrame([("a/b",), ("a/b",), ("c",), (None,), (None,)], "path string")
    claims = spark.createDataFrame([("a/", "x"), ("", "all")], "prefix string, dataset string")
    assert sorted(map(tuple, O.owned_paths(paths, claims).collect()), key=repr) == [("a/b", "x"), ("c", "all"), (None, None)]
    with pytest.raises(Exception, match="claimed twice"):
        O.owned_paths(paths, claims.union(spark.createDataFrame([("a/", "y")], claims.schema))).collect()


def test_memory_context_counts_facts_once_for_equal_lines(spark):
    """Sites on one line share its facts; one that stands on several lines has the facts of all, each once."""
    r = random.Random(8)
    sites = [(i, "f", i % 2) for i in range(3000)] + [(5000, "f", 0), (5000, "f", 1), (5000, "f", 9), (5001, None, 1), (5002, "g", 1)]
    facts = [("f", i % 2, f"m{r.randrange(400)}") for i in range(3000)]
    found = O.memory_context(spark.createDataFrame(sites, "site long, path string, line int"), spark.createDataFrame(facts, "path string, line int, fact string"), 4)
    want = {}
    for s, p, n in sites:
        want.setdefault(s, set()).update(f for q, m, f in facts if (q, m) == (p, n)) if s >= 5000 or s < 2 else want.setdefault(s, want[s % 2])
    assert {x["site"]: (x["facts"], x["omitted"]) for x in found.collect()} == {s: (sorted(fs)[:4], max(0, len(fs) - 4)) for s, fs in want.items()}
    observed = [int(m["numOutputRows"]) for m in join_rows(found)]
    assert observed and max(observed) < 10 * len(sites)


def join_rows(df):
    """The metrics of all joins of a plan that has run."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Join" in kind:
            out.append({"numOutputRows": node.metrics().apply("numOutputRows").value()})
    return out


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tree(spark):
    return spark.createDataFrame([("f", [1], "function_definition", None, True, "def", 1, 5, False), ("f", [1, 0], "identifier", "name", True, "g", 1, 1, False), ("f", [1, 1], "if_statement", "body", True, "if", 2, 3, False)],
        "file string, ordinal array<int>, type string, field string, named boolean, text string, start_line int, end_line int, error boolean")


def test_functions_broadcast_no_nodes(spark):
    """Trees are small as files and large in memory, so the size of a file says nothing about a broadcast."""
    found = S.functions(tree(spark), ["function_definition"], ["if_statement"], ["if_statement"], [], ["&&"], [], ["identifier"])
    assert "BroadcastHashJoin" not in planned(found)
    assert [(r["qualified_name"], r["cyclomatic"]) for r in found.collect()] == [("g", 2)]
    assert "BroadcastHashJoin" not in planned(S.file_summary(found, 3))


def test_projection_broadcasts_no_nodes(spark):
    found = S.project(tree(spark), ["function_definition"], ["call"], ["import_statement"], ["identifier"])
    assert "BroadcastHashJoin" not in planned(found)
    assert sorted((r["category"], r["written_name"]) for r in found.collect()) == [("definition", "g"), ("reference", "g")]


def test_flows_and_unknowns_broadcast_no_sites(spark, small):
    from veridact.operators import threats as T
    from veridact.plans import evidence_queries as E

    assert "BroadcastHashJoin" not in planned(E._acts(spark, small))
    sites, owned = E._acts(spark, small), E._owned(spark, small)
    rules = spark.createDataFrame(E.RULES, "interaction string, peer string, direction string, boundary string")
    found = T.flows(sites.drop("unit", "path"), owned, rules, 3)
    lost = T.unknowns(rules.select(F.col("peer").alias("process")), found, rules.select(F.col("peer").alias("library")), rules.select(F.col("peer").alias("library")), sites.select("site", "interaction", "path"), owned)
    for plan in (planned(found), planned(lost)):
        assert "BroadcastHashJoin [site" not in plan and "SortMergeJoin [site" in plan
