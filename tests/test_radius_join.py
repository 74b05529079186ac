"""radius_join: pairs of many copies, of lists in several rows, and at the edge of the radius."""

from __future__ import annotations

import duckdb

from ordinate.plans import catalog


def test_pairs_equal_the_sql_and_are_made_from_copies(spark, tmp_path):
    price = "CASE WHEN id % 7 = 0 THEN id % 40 * 2.000003 WHEN id % 11 = 0 THEN NULL ELSE id % 30 * 0.7 END"
    rows = f"id * 3 % 2503 AS p_partkey, CASE WHEN id < 1200 THEN 1 ELSE id % 5 END AS p_size, CASE WHEN id < 1200 THEN 900.5D ELSE {price} END AS p_retailprice"
    spark.sql(f"SELECT {rows} FROM range(2500)").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.queries()["radius_join"](spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = duckdb.sql(catalog.oracle_sql()["radius_join"]).fetchall()
    assert len(want) > 1200 * 1199 // 2 and sorted(map(tuple, found.collect())) == sorted(want)
    # the join sees a row for each list of copies; before, it saw 1,200 x 3 x 1,200 candidates
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("Join") and "collect_list" in plan
