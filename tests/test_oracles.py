"""Every query of the catalogue with a DuckDB twin returns the same rows."""

import math

import duckdb
import pandas as pd
import pytest

from quillgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "year"):
        return str(pd.Timestamp(value))
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_checked():
    unchecked = {"d_resolve_entity_types", "g_cluster_entities"}
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == unchecked


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
