"""Every registered query of the engine against its SQL."""

import datetime
import decimal

import duckdb
import pytest

from quillspan.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in catalogue.ORACLE_SQL:
        q = db.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in q.description]
        want = sorted(repr([plain(dict(zip(names, r))[c]) for c in cols]) for r in q.fetchall())
        assert sorted(names) == cols and got == want
    assert got


def test_flagship(spark, sf):
    assert catalogue.flagship(spark, sf).count() > 3
