"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidesmith.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def same_rows(spark_df, relation):
    names = [c[0] for c in relation.description]
    assert sorted(spark_df.columns) == sorted(names)
    at = [names.index(c) for c in spark_df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(map(plain, r)) for r in spark_df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    assert len(mine) == len(theirs)
    assert [p for p in zip(mine, theirs) if p[0] != p[1]][:3] == []


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_oracles_rows(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
