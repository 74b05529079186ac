"""Suffix dedup: ranges between splitters, and anchors of many places dealt in windows, lose no match."""

import random

import numpy as np
import pytest

from ordinate.llm import suffix_dedup
from tests.llm.test_llm import brute_repeats


def texts(seed: int, n: int) -> list[tuple[int, str]]:
    """A passage in most texts, after and before other words, some of it cut short, some twice."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = []
    for i in range(n):
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(3)]
        a, z = rng.randint(0, 40), rng.randint(60, len(passage))
        out.append((i, own[0] + passage[a:z] + own[1] + (passage[z - 70 : z] + own[2] if rng.random() < 0.3 else "")))
    return out


@pytest.mark.parametrize("hot", [((10**9, 1), (10**9, 1)), ((3, 4), (20, 16)), ((1, 1), (2, 77)), ((5, 3),)])
def test_windows_lose_nothing(spark, hot):
    some = texts(len(hot), 150)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(6)
    got = suffix_dedup.dedup_repeats(df, parts=7, hot=hot).collect()
    assert sorted((r["doc_id"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in got) == brute_repeats(some)


def test_windows_cover_every_distance():
    for n in (1, 2, 3, 4, 16, 77):
        lo, hi = suffix_dedup._windows(n)
        assert [o for a, z in zip(lo, hi) for o in range(a, z + 1)] == list(range(77))


def test_splitters_divide_the_places():
    rng = random.Random(5)
    grams = sorted(bytes(rng.choice(b"abc") for _ in range(24)) for _ in range(900))
    weight = np.array([rng.randint(2, 40) for _ in grams], np.int64)
    blobs = [b"".join(grams[i::3]) + weight[i::3].tobytes() for i in range(3)]
    bounds = suffix_dedup.splitters(blobs, 10)
    part = np.searchsorted(bounds, np.array(grams, "S24"), "right")
    sums = np.bincount(part, weight)
    assert len(sums) == 10 and sums.max() < 1.2 * sums.mean()
    assert len(suffix_dedup.splitters([], 4)) == 0
