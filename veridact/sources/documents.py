"""Readers of texts that become evidence: chunks of documents, interface descriptions, and modules of intermediate code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(docs: DataFrame, key: str, text: str, max_lines: int, max_bytes: int) -> DataFrame:
    """(key, chunk, first_line, last_line, text): whole lines, no more than either bound, in order; a longer line stands alone.

    Rows are cut one by one in their task; nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(content: str) -> Iterator[tuple[int, int, str]]:
        held, size, first = [], 0, 1
        for no, line in enumerate(content.split("\n"), 1):
            n = len(line.encode()) + 1
            if held and (len(held) >= max_lines or size + n > max_bytes):
                yield first, no - 1, "\n".join(held)
                held, size, first = [], 0, no
            held.append(line)
            size += n
        if held:
            yield first, first + len(held) - 1, "\n".join(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *c) for k, t in zip(pdf["key"], pdf["text"]) if t for i, c in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["key", "chunk", "first_line", "last_line", "text"])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInPandas(run, f"key {kind}, chunk int, first_line int, last_line int, text string").withColumnRenamed("key", key)


def openapi_operations(documents: DataFrame) -> DataFrame:
    """(path, method, operation_id) of OpenAPI documents as JSON in ``value``."""
    paths = documents.select(F.from_json("value", "paths map<string,map<string,struct<operationId:string>>>")["paths"].alias("p"))
    ops = paths.select(F.explode("p").alias("path", "methods")).select("path", F.explode("methods").alias("method", "op"))
    return ops.filter(F.lower("method").isin("get", "put", "post", "delete", "options", "head", "patch", "trace")).select("path", F.lower("method").alias("method"), F.col("op.operationId").alias("operation_id"))


def idl_operations(documents: DataFrame) -> DataFrame:
    """(service, method, request, response) of protocol definitions in ``value``."""
    service = F.regexp_extract_all("value", F.lit(r"(?s)service\s+(\w+)\s*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}"), F.lit(0))
    s = documents.select(F.explode(service).alias("s"))
    rpc = r"rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)"
    calls = s.select(F.regexp_extract("s", r"service\s+(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("s", F.lit(rpc), F.lit(0))).alias("c"))
    return calls.select("service", *[F.regexp_extract("c", rpc, i).alias(n) for i, n in ((1, "method"), (2, "request"), (3, "response"))])


_DEFINE = re.compile(r"^define\b.*?@(?P<name>\"[^\"]+\"|[\w.$-]+)\s*\(")
_LABEL = re.compile(r"^(?P<label>[\w.$-]+):")
_TARGET = re.compile(r"label %([\w.$-]+)")
_CALL = re.compile(r"\bcall\b[^@%]*@([\w.$-]+)\s*\(")


def ir_edges(modules: DataFrame) -> DataFrame:
    """(module, function, src, dst) of textual LLVM modules (module, value): control-flow edges between basic blocks."""
    return _ir(modules, "edge").select("module", "function", F.col("a").alias("src"), F.col("b").alias("dst"))


def ir_calls(modules: DataFrame) -> DataFrame:
    """(module, function, block, callee): direct calls."""
    return _ir(modules, "call").select("module", "function", F.col("a").alias("block"), F.col("b").alias("callee"))


def _ir(modules: DataFrame, kind: str) -> DataFrame:
    def parse(text: str) -> Iterator[tuple[str, str, str, str]]:
        function = block = None
        for line in text.splitlines():
            if m := _DEFINE.match(line):
                function, block = m["name"].strip('"'), "entry"
            elif line.startswith("}"):
                function = None
            elif function is not None:
                if m := _LABEL.match(line):
                    block = m["label"]
                    continue
                code = line.strip()
                if code.startswith(("br ", "switch ", "indirectbr ")) or "invoke " in code or code.startswith(("i", "]")) and "label %" in code:
                    for target in dict.fromkeys(_TARGET.findall(code)):
                        yield "edge", function, block, target
                for callee in _CALL.findall(code):
                    yield "call", function, block, callee

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, f, a, b) for m, t in zip(pdf["module"], pdf["value"]) if t for k, f, a, b in parse(t) if k == kind]
            yield pd.DataFrame(rows, columns=["module", "function", "a", "b"]).drop_duplicates() if kind == "edge" else pd.DataFrame(rows, columns=["module", "function", "a", "b"])

    return modules.select("module", "value").mapInPandas(run, "module string, function string, a string, b string")


def graph_csv(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, callee) of an exported property graph: calls inside a method, to the method of that name; an unknown callee is null."""
    methods = nodes.filter("label = 'METHOD'").select(F.col("id").alias("method_id"), F.col("name").alias("method"))
    calls = nodes.filter("label = 'CALL'").select(F.col("id").alias("call_id"), F.col("name").alias("callee"))
    inside = edges.filter("label = 'CONTAINS'").select(F.col("src").alias("method_id"), F.col("dst").alias("call_id"))
    known = methods.select(F.col("method").alias("callee"), F.lit(True).alias("known")).distinct()
    return inside.join(methods, "method_id").join(calls, "call_id").join(known, "callee", "left").select(F.col("method").alias("caller"), "callee", F.coalesce("known", F.lit(False)).alias("resolved"))


_BLOCK = re.compile(r"^\s*\[B(\d+)(?: \((ENTRY|EXIT)\))?\]")
_SUCC = re.compile(r"^\s*Succs \(\d+\): (.*)$")


def clang_cfg(dumps: DataFrame) -> DataFrame:
    """(function, src, dst) of CFG dumps in ``value``: successors of numbered blocks; an unreachable one is left out."""

    def parse(text: str) -> Iterator[tuple[str, str, str]]:
        function = block = None
        for line in text.splitlines():
            if m := _BLOCK.match(line):
                block = m[1]
            elif m := _SUCC.match(line):
                for target in re.findall(r"\bB(\d+)(\(Unreachable\))?", m[1]):
                    if not target[1]:
                        yield function, block, target[0]
            elif line and not line[0].isspace() and "(" in line:
                function = re.sub(r"\(.*", "", line).split()[-1].lstrip("*&")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for t in pdf["value"] if t for r in parse(t)], columns=["function", "src", "dst"])

    return dumps.select("value").mapInPandas(run, "function string, src string, dst string")


def clangd_symbols(dumps: DataFrame) -> DataFrame:
    """(id, name, scope, kind, file, line) of symbol documents in a YAML stream in ``value``; other documents are left out."""
    docs = dumps.select(F.explode(F.split("value", r"(?m)^--- ")).alias("d")).filter(F.col("d").startswith("!Symbol"))
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("d", rf"(?m)^\s*{k}:\s*(.*)$", 1), "^['\"]|['\"]$", "")), F.lit(""))
    return docs.select(field("ID").alias("id"), field("Name").alias("name"), field("Scope").alias("scope"), field("Kind").alias("kind"), F.regexp_replace(field("FileURI"), "^file://", "").alias("file"), field("Line").cast("int").alias("line"))


def dwarf_functions(dumps: DataFrame) -> DataFrame:
    """(name, low, high) of subprograms in debug dumps in ``value``: addresses as numbers, ``high`` exclusive.

    A high address written as a size is added to the low one; subprograms without addresses are declarations and are left out.
    """
    entries = dumps.select(F.explode(F.split("value", r"(?m)^0x[0-9a-f]+:\s+")).alias("e")).filter(F.trim("e").startswith("DW_TAG_subprogram"))
    number = lambda c: F.conv(F.regexp_replace(c, "^0x", ""), 16, 10).cast("decimal(20,0)")
    part = lambda k: F.nullif(F.regexp_extract("e", rf"{k}\s*\(\"?(0x[0-9a-f]+|[^\")]*)\"?\)", 1), F.lit(""))
    low, high = number(part("DW_AT_low_pc")), number(part("DW_AT_high_pc"))
    rows = entries.select(part("DW_AT_name").alias("name"), low.alias("low"), F.when(high < low, low + high).otherwise(high).alias("high"))
    return rows.filter("low IS NOT NULL AND high IS NOT NULL")


def exported_rows(documents: DataFrame) -> DataFrame:
    """(query_id, row, truncated) of query exports in ``value``; an export with fewer declared rows than it holds is an error."""
    d = documents.select(F.from_json("value", "query_id string, columns array<string>, rows array<array<string>>, row_count long, truncated boolean").alias("d")).select("d.*")
    fine = F.when(F.col("row_count") >= F.size("rows"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("more rows than declared: "), "query_id")).cast("boolean"))
    return d.filter(fine).select("query_id", F.explode("rows").alias("row"), "truncated")
