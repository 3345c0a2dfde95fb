"""The operators' SQL in DuckDB against their queries."""

import duckdb
import pytest

from folioframe.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    expect = db.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert set(got.columns) == set(expect.columns)
    rows = lambda f: sorted(f[sorted(f.columns)].itertuples(index=False, name=None), key=str)
    assert rows(got) == rows(expect)
