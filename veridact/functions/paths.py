"""Paths, names and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A regular expression for a path pattern, folder by folder: ``*`` and ``?`` stay within a name, ``**`` does not.

    A folder that ends in ``**`` stands for any folders, also none. A pattern without a slash matches a name at any depth.
    """
    folders = pattern.split("/")
    if len(folders) == 1:
        folders.insert(0, "**")
    name = folders.pop()
    return "^" + "".join(_part(f[:-2]) + "(?:[^/]+/)*" if f.endswith("**") else _part(f) + "/" for f in folders) + _part(name) + "$"


def _part(text: str) -> str:
    """One name of a path pattern."""
    within = {"*": "[^/]*", "?": "[^/]"}
    return ".*".join("".join(within.get(c) or re.escape(c) for c in piece) for piece in text.split("**"))


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def first_category(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first category in order of which a pattern matches; null if none does."""
    found = None
    for name, patterns in rules:
        hit = None
        for p in patterns:
            hit = matches_glob(path, p) if hit is None else hit | matches_glob(path, p)
        found = F.when(hit, F.lit(name)) if found is None else found.when(hit, F.lit(name))
    return found


def normalized_relative(path: Column) -> Column:
    """A relative path with single slashes and no ``.`` parts; an absolute path or one with ``..`` is null."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(^|/)(\./)+", "$1"), "/+", "/")
    return F.when(~clean.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), clean)


def tail_name(name: Column) -> Column:
    """The last part of a qualified function name, without parameters and template arguments."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\(.*$", ""), r"<[^<>]*>", "")
    return F.element_at(F.split(bare, r"::|\."), -1)


def cwe_number(text: Column) -> Column:
    """The number of a weakness named ``CWE-79``, ``cwe79`` or ``79``; else null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"(?i)^(?:cwe[-_ ]?)?0*([0-9]{1,5})$", 1), F.lit("")).cast("int")


def advisory_token(text: Column) -> Column:
    """An upper-case CVE or a GHSA identifier; else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"(?i)^cve-[0-9]{4}-[0-9]{4,}$"), F.upper(t)).when(t.rlike(r"(?i)^ghsa(-[0-9a-z]{4}){3}$"), F.concat(F.lit("GHSA"), F.lower(F.substring(t, 5, 100))))


def plain_code(code: Column) -> Column:
    """Code without comments and with single spaces."""
    bare = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"(?m)(//|#).*$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def commit_refs(message: Column, most: int = 20) -> Column:
    """Identifiers of advisories and weaknesses named in a message: upper case, sorted, distinct, bounded."""
    found = F.regexp_extract_all(message, F.lit(r"(?i)\b((?:CVE-[0-9]{4}-[0-9]{4,})|(?:GHSA(?:-[0-9a-z]{4}){3})|(?:CWE-[0-9]+))\b"), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.upper(x)))), 1, most)


def cvss_band(score: Column) -> Column:
    """Severity of a base score; null and anything outside 0..10 is unknown."""
    return F.when(score.isNull() | (score < 0) | (score > 10), F.lit("unknown")).when(score == 0, F.lit("none")).when(score < 4, F.lit("low")).when(score < 7, F.lit("medium")).when(score < 9, F.lit("high")).otherwise(F.lit("critical"))


def collapsed(path: Column) -> Column:
    """A relative path without ``.`` parts, empty parts, and ``..`` parts that undo a folder; null if it is absolute or leaves the tree."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: (
        F.when((p == "..") & (F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.concat(out, F.array(p)))
    ))
    joined = F.array_join(step, "/")
    return F.when(~path.startswith("/") & (joined != "") & ~joined.rlike(r"^\.\.(/|$)"), joined)
