"""Neighbour lists of all rows, not of a few."""

from __future__ import annotations

import os

import pytest

from ordinate.plans import catalog

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_remap_takes_whole_lists(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "vec_id").collect()
    kept = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id").collect()}
    want = {r["label"]: [] for r in rows}
    for label, i in sorted(map(tuple, rows)):
        if i in kept:
            want[label].append(str(i + 1_000_000))
    got = {r["qid"]: r["ids"] for r in catalog.queries()["neighbor_remap_whole"](spark, SF).collect()}
    assert got == {k: ",".join(v) for k, v in want.items()}
    assert max(map(len, want.values())) > 8
    print(len(rows), sum(map(len, want.values())), len(want))
