import io
import json
import zipfile

import pytest
from conftest import rows

from veridact.sources import coverage, documents, feeds, findings, history, pages, profiles, sinks


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i, v) for i, v in enumerate(text.split("\n"))], "file string, line_no int, value string")


def docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_lcov_merges_by_most_hits(spark):
    text = "TN:\nSF:a.c\nFN:1,f\nFNDA:2,f\nDA:1,0\nDA:2,3\nBRDA:2,0,0,-\nBRDA:2,0,1,4\nend_of_record\nSF:a.c\nDA:1,5\nend_of_record"
    assert rows(coverage.lcov(lines(spark, text))) == [("a.c", 2, 2, 2, 1, 1, 1)]


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "x.info").write_text("SF:b.c\nDA:1,1")
    assert coverage.lcov(coverage.read_lines(spark, str(tmp_path))).first()["lines_hit"] == 1


def test_cobertura_jacoco_and_llvm(spark):
    c = '<coverage><packages><package><classes><class filename="a.py"><methods/><lines><line number="1" hits="1" branch="true" condition-coverage="50% (1/2)"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>'
    assert rows(coverage.cobertura(docs(spark, c))) == [("a.py", 2, 1, 2, 1, 0, 0)]
    j = '<report><package name="p"><sourcefile name="A.java"><counter type="LINE" missed="1" covered="3"/></sourcefile></package></report>'
    assert rows(coverage.jacoco(docs(spark, j))) == [("p/A.java", 4, 3, 0, 0, 0, 0)]
    v = json.dumps({"data": [{"files": [{"filename": "x.cc", "summary": {"lines": {"count": 5, "covered": 4}, "functions": {"count": 1, "covered": 1}}}]}]})
    got = coverage.with_rates(coverage.llvm_json(docs(spark, v))).first()
    assert (got["lines_rate"], got["branches_rate"]) == (0.8, None)


def test_profiles(spark):
    assert rows(profiles.folded_stacks(lines(spark, "a;b;a 3\na;c 2"))) == [("a", 3, 5), ("b", 0, 3), ("c", 2, 2)]
    perf = "prog 1 2.0: 1 cycles:u:\n\tff01 main+0x1 (/bin/p)\n\tff02 f (/bin/p)\n\nprog 1 2.1: 1 cycles:u:\n\tff01 main (/bin/p)"
    assert rows(profiles.perf_script(lines(spark, perf)))[-1][0] == "main"
    cg = "fl=(1) a.c\nfn=(1) main\n10 5\ncfn=(2) g\ncalls=1 3\n+1 40\nfn=(2)\n3 40"
    assert rows(profiles.callgrind(docs(spark, cg))) == [("g", "a.c", 3, "self", 40), ("main", "a.c", 10, "self", 5), ("main", "a.c", 11, "inclusive", 40)]
    assert rows(profiles.llvm_samples(lines(spark, "main:100:2\n 1: 5\nf:7:0"))) == [("f", 7, 0), ("main", 100, 2)]


def test_sarif_levels_and_bases(spark):
    place = {"physicalLocation": {"artifactLocation": {"uri": "a.c", "uriBaseId": "R"}, "region": {"startLine": 3}}}
    run = {"tool": {"driver": {"name": "t", "rules": [{"id": "r1", "defaultConfiguration": {"level": "error"}, "properties": {"security-severity": "7.5"}}]}}, "originalUriBaseIds": {"R": {"uri": "file:///src/"}}, "results": [{"ruleId": "r1", "message": {"text": "m"}, "locations": [place]}, {"ruleId": "r2", "message": {"text": "n"}}]}
    got = rows(findings.sarif(docs(spark, json.dumps({"runs": [run]}))))
    assert got == [("t", "r1", "error", 7.5, "m", "/src/a.c", 3, 3, 0), ("t", "r2", "warning", None, "n", None, None, None, 0)]
    back = findings.sarif(docs(spark, json.dumps({"runs": [run]}))).filter("path IS NOT NULL")
    assert json.loads(sinks.sarif_results(back).first()["value"])["ruleId"] == "r1"


def test_scanner_adapters(spark):
    grype = json.dumps({"matches": [{"vulnerability": {"id": "CVE-1", "severity": "High"}, "artifact": {"name": "z", "version": "1"}}]})
    assert rows(findings.flatten("grype", docs(spark, grype))) == [("grype", "CVE-1", "high", "z@1")]
    log = "==1==ERROR: AddressSanitizer: heap-use-after-free on address\n    #0 0xabc in f a.c:3"
    assert rows(findings.flatten("sanitizer", docs(spark, log))) == [("sanitizer", "heap-use-after-free", "high", "f")]
    xml = '<BugCollection><BugInstance type="NP" priority="1"><Class classname="A"/></BugInstance></BugCollection>'
    assert rows(findings.flatten("spotbugs", docs(spark, xml))) == [("spotbugs", "NP", "high", "A")]
    osv = json.dumps({"results": [{"packages": [{"package": {"name": "p", "version": "2"}, "vulnerabilities": [{"id": "G"}]}]}]})
    assert rows(findings.flatten("osv", docs(spark, osv))) == [("osv", "G", "unknown", "p@2")]


def test_history(spark):
    log = "commit abcdef1 100 Ann\n3\t1\ta.c\n-\t-\tb.png\ncommit abcdef2 90 Bob"
    got = rows(history.numstat_log(lines(spark, log)).select("commit", "author", "path", "added", "binary"))
    assert got == [("abcdef1", "Ann", "a.c", 3, False), ("abcdef1", "Ann", "b.png", None, True), ("abcdef2", "Bob", None, None, None)]
    assert rows(history.hunks(lines(spark, "commit abcdef1\n@@ -3 +3,2 @@ x\n@@ -9,0 +11 @@"))) == [("abcdef1", 1, 3, 1, 3, 2), ("abcdef1", 2, 9, 0, 11, 1)]
    from pyspark.sql import functions as F

    assert tuple(spark.range(1).select(history.renamed_paths(F.lit("a/{b => c}/d")).alias("x")).first()["x"]) == ("a/b/d", "a/c/d")
    sha = "0" * 40
    assert rows(history.blame(lines(spark, f"{sha} 1 5 1\nauthor Ann\n\tcode"))) == [(sha, "Ann", 5)]


def test_feeds(spark, tmp_path):
    for i, (m, s) in enumerate((("2024-02", "new"), ("2024-01", "late"))):
        (tmp_path / f"{i}.json").write_text(json.dumps({"cve_id": "CVE-2024-0001", "status": s, "last_modified": m, "weaknesses": ["CWE-79"]}))
    got = feeds.nvd(spark, [str(tmp_path / "0.json"), str(tmp_path / "1.json")])
    assert got.first()["status"] == "new" and rows(feeds.nvd_weaknesses(got)) == [("CVE-2024-0001", "CWE-79")]
    (tmp_path / "e.csv").write_text("#model\ncve,epss,percentile\nCVE-2024-0001,0.5,0.9\n")
    assert feeds.epss(spark, str(tmp_path / "e.csv")).count() == 1
    (tmp_path / "e2.csv").write_text("cve,epss,percentile\nCVE-2024-0001,1.5,0.9\n")
    with pytest.raises(Exception, match="bad score row"):
        feeds.epss(spark, str(tmp_path / "e2.csv")).collect()
    k = json.dumps({"catalogVersion": "1", "vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-01-02", "knownRansomwareCampaignUse": "Known"}]})
    assert feeds.kev(docs(spark, k)).first()["known_ransomware_use"] is True
    adv = {"id": "G-1", "modified": "1", "aliases": ["CVE-1"], "affected": [{"package": {"ecosystem": "npm", "name": "x"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0.0"}]}]}]}
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("G-1.json", json.dumps(adv))
    (tmp_path / "osv.zip").write_bytes(sink.getvalue())
    rows_ = feeds.osv_archives(spark, str(tmp_path / "osv.zip"))
    newest, conflicts = feeds.osv_current(rows_)
    assert conflicts.count() == 0 and rows(feeds.osv_aliases(newest)) == [("G-1", "CVE-1")]
    assert [tuple(e) for e in feeds.osv_packages(newest).first()["events"]] == [("introduced", "0"), ("fixed", "2.0.0")]
    cwe = '<Weakness_Catalog><Weaknesses><Weakness ID="79" Name="XSS"/></Weaknesses></Weakness_Catalog>'
    assert rows(feeds.weaknesses(docs(spark, cwe))) == [("CWE-79", "cwe", "XSS")]


def test_documents(spark):
    df = spark.createDataFrame([(1, "a\nbb\nccc\nd"), (2, None), (3, "")], "k int, t string")
    assert rows(documents.chunks(df, "k", "t", 2, 100).select("k", "chunk", "first_line", "text")) == [(1, 0, 1, "a\nbb"), (1, 1, 3, "ccc\nd")]
    api = json.dumps({"paths": {"/x": {"get": {"operationId": "g"}, "parameters": {}}}})
    assert rows(documents.openapi_operations(docs(spark, api))) == [("/x", "get", "g")]
    idl = "service S { rpc A (B) returns (stream C); rpc D (E) returns (F) {} }"
    assert rows(documents.idl_operations(docs(spark, idl))) == [("S", "A", "B", "C"), ("S", "D", "E", "F")]
    ir = "define i32 @f(i32 %x) {\nentry:\n  br i1 %c, label %a, label %b\na:\n  %r = call i32 @g(i32 1)\n  br label %b\nb:\n  ret i32 0\n}"
    module = spark.createDataFrame([("m", ir)], "module string, value string")
    assert rows(documents.ir_edges(module).select("src", "dst")) == [("a", "b"), ("entry", "a"), ("entry", "b")]
    assert rows(documents.ir_calls(module)) == [("m", "f", "a", "g")]


def test_publish_reuses_equal_content(spark, tmp_path):
    df = spark.range(10)
    path, wrote = sinks.publish(df, str(tmp_path))
    again = sinks.publish(df.orderBy(df.id.desc()), str(tmp_path))
    assert wrote and again == (path, False)
    sinks.write_json_cells(spark.createDataFrame([(None, 'a"b', 1)], "x string, y string, z int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().asDict() == {"x": "null", "y": '"a\\"b"', "z": "1"}


def test_names_of_many_sorted_files_sort_as_their_rows(spark, tmp_path):
    n = 6001
    numbers = spark.range(n).selectExpr("(id * 7919) % 6001 AS k").repartition(3)
    for name, per_file, most in (("one", 1, n), ("several", 7, 858)):
        found = pages.write_sorted(numbers, str(tmp_path / name), ["k"], per_file)
        paths = sorted((tmp_path / name).glob("part-*"))
        assert len(paths) == found.count() == most
        assert [json.loads(line)["k"] for p in paths for line in p.read_text().split()] == list(range(n))
    assert pages.write_sorted(numbers.limit(0), str(tmp_path / "none"), ["k"], 7).count() <= 1
