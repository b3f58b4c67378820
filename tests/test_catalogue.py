import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import tessera.plans.flagship  # noqa: F401  registers the queries of the build
from tessera.plans.catalogue import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 9)
    return v


def same(columns, rows):
    return sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got.columns, [tuple(r) for r in got.collect()]) == same(want.columns, want.fetchall())
