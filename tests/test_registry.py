import duckdb
import pytest

import __spark_entry__ as entry
from veridact.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return plain(v.item())
    return v if isinstance(v, (int, str, bool)) else str(v)[:19] if hasattr(v, "year") else [plain(x) for x in v] if hasattr(v, "__iter__") else str(v)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
