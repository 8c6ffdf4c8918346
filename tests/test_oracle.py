"""Every query with an SQL twin gives the same rows on the smallest data set."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, db, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    cur = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want, columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
