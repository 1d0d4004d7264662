"""Queries against DuckDB over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans import catalog, registry

SF = "/root/testdata/sf0.001"
catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():  # noqa: ANN201
    made = duckdb.connect()
    for f in os.listdir(SF):
        made.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return made


def plain(v: object) -> str:
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "none" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):  # noqa: ANN001
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[i]) for i in places) for r in cursor.fetchall()) == ours


QUICK = ("smote", "partial_autocorrelation", "holt_winters_by_user", "arima_by_user", "isolation_forest", "decoder_generate", "lstm_score", "cnn_score", "pipeline_pca", "random_search", "bayesian_search", "training_log", "random_vectors")


@pytest.mark.parametrize("name", QUICK)
def test_query_runs(spark, name):  # noqa: ANN001
    assert registry.QUERIES[name](spark, SF).count() > 0
