"""The grid of the embedding: whatever is within the distance meets in a cell; hot keys in lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from ordinate.llm import simhash


@pytest.mark.parametrize("n", [10, 100_000, 10**8, 10**11])
def test_all_within_the_distance_meet(n):
    rng = np.random.default_rng(n % 97)
    grid = simhash.grid_for(n)
    assert 1 <= simhash.spread_of(4, *grid) <= 2
    cells = simhash._cells(*grid)
    fp = rng.integers(0, 2**64, 200, dtype=np.uint64)
    fp[:3] = [0, 2**64 - 1, 0x5555555555555555]
    near = fp.copy()
    for i in range(len(near)):
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            near[i] ^= np.uint64(1 << int(b))
    of = lambda x: {(c, f) for c, f in zip(*(col.to_pylist() for col in cells(pa.record_batch([pa.array(x.view(np.int64))], ["fp"])).columns))}
    for a, b in zip(fp, near):
        assert {c for c, _ in of(np.array([a]))} & {c for c, _ in of(np.array([b]))}


def test_random_fingerprints_meet_as_often_as_reckoned():
    rng = np.random.default_rng(2)
    n = 30_000
    fp = rng.integers(0, 2**64, n, dtype=np.uint64)
    for grid in ((2, 1), (3, 2)):
        out = simhash._cells(*grid)(pa.record_batch([pa.array(fp.view(np.int64))], ["fp"]))
        each, chance = simhash.meetings(*grid)
        assert abs(out.num_rows / n / each - 1) < 0.05
        counts = np.unique(np.asarray(out.column(0)), return_counts=True)[1]
        assert (counts * (counts - 1) / 2).sum() <= 4 * n * n / 2 * chance + 50  # a pair meets in at most a few cells


def test_lookups_with_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(4000)], "id long, k long")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 4000, 2)] + [(7, 70)], "k long, v long")
    want = sorted((i, k, k * 10 if k == 7 or k % 2 == 0 else None) for i, k in ((i, 7 if i % 3 else i) for i in range(4000)))
    for few in (0, 10**6):
        monkeypatch.setattr(simhash, "FEW", few)
        got = sorted((r["id"], r["k"], r["v"]) for r in simhash.looked_up(left, right, "k", 2001).collect())
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 0)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 80)) for _ in range(30)]
    rows = [(i, base[i % 30] + (" tail" * (i // 30 % 3))) for i in range(240)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    monkeypatch.setattr(simhash, "FEW", 10**6)
    assert got == sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    prints = {i: int(f, 16) for i, f, _ in got}
    comp = {i: c for i, _, c in got}
    assert all(comp[a] == comp[b] for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
