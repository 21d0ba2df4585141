"""Every query of the catalog against its DuckDB equivalent on the smallest tables."""

import math
import os

import duckdb
import pytest

from fathom import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def rows(frame):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert name in catalog.ORACLES
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_covariance_of_all_places(spark, sf_dir):
    places = len(spark.read.parquet(f"{sf_dir}/embeddings.parquet").first().embedding)
    pairs = {(r.i, r.j) for r in catalog.QUERIES["covariance_whole"](spark, sf_dir).collect()}
    assert pairs == {(i, j) for i in range(places) for j in range(i, places)}
