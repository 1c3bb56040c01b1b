"""Every query with SQL against DuckDB, and the others' invariants, at the smallest scale."""

import os

import duckdb
import pytest

from neurospan import catalog, catalog_image, catalog_proof, catalog_space, catalog_store

QUERIES, ORACLES = catalog.QUERIES | catalog_space.QUERIES | catalog_image.QUERIES | catalog_proof.QUERIES | catalog_store.QUERIES, catalog.ORACLES | catalog_space.ORACLES | catalog_image.ORACLES | catalog_proof.ORACLES | catalog_store.ORACLES

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shape(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(shape, v))
    return v


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    order, at = sorted(df.columns), {c: i for i, c in enumerate(want.columns)}
    key = lambda t: repr(t)
    assert sorted((tuple(shape(r[c]) for c in order) for r in got), key=key) == sorted((tuple(shape(r[at[c]]) for c in order) for r in want.fetchall()), key=key)
