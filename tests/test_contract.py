"""Every registered query with SQL gives the same rows as the SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as core

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = DATA / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(spark, duck, query, sql):
    ours = query(spark, str(DATA))
    rows = duck.execute(sql)
    names = [d[0] for d in rows.description]
    assert sorted(ours.columns) == sorted(names)
    order = sorted(names)
    key = lambda rs, cols: sorted(repr([plain(r[cols.index(c)]) for c in order]) for r in rs)
    assert key([tuple(r) for r in ours.collect()], ours.columns) == key(rows.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(core.ORACLES) - {"event_topic_counts"}))
def test_oracle(spark, duck, name):
    same(spark, duck, core.QUERIES[name], core.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_without_oracle(spark, name):
    assert core.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
