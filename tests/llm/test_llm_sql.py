"""The registered queries against DuckDB at the smallest scale, and the rest for their shape."""

from __future__ import annotations

import duckdb
import pytest

from ordinate.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].astype(object).values.tolist())) == sorted(map(tuple, want[cols].astype(object).values.tolist()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_for_each_input(spark, name):
    out = queries.queries()[name](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/{'pages' if 'html' in name else 'documents'}.parquet").count()
