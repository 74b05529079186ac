"""Periodic runs against a plain search for maximal repetitions."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import periodic


def plain_runs(w, least=24, times=3):
    found, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            part = w[i : i + length]
            if length >= max(least, times * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rng):
    out = []
    while len(out) < rng.randint(20, 400):
        kind = rng.randint(0, 5)
        if kind == 0:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            out += (unit * rng.randint(2, 40))[: rng.randint(5, 150)]
        elif kind == 1:
            out += out[-rng.randint(1, 30) :] * rng.randint(1, 4)
        elif kind == 2:
            inner = [rng.choice("ab")] * rng.randint(20, 30) + [rng.choice("cd")]
            out += inner * rng.randint(1, 6)
        else:
            out += [str(rng.randint(0, 3 if kind == 3 else 50)) for _ in range(rng.randint(1, 40))]
    return out


def test_runs_equal_a_plain_search():
    rng = random.Random(3)
    for trial in range(300):
        w = made(rng)
        ids = {}
        assert periodic.runs_of(np.array([ids.setdefault(x, len(ids)) for x in w])) == plain_runs(w), trial
        if trial % 5 == 0:
            assert periodic.runs_of(np.array([ids[x] for x in w]), 8, 2) == plain_runs(w, 8, 2), trial


def test_matches_of_frequent_and_rare_words():
    rng = np.random.default_rng(1)
    w = np.where(rng.random(5000) < 0.5, 0, rng.integers(1, 300, 5000))
    got = periodic.lag_matches(w, 1600)
    assert got.tolist() == [0] + [int((w[:-q] == w[q:]).sum()) for q in range(1, 1601)]


@pytest.mark.parametrize("kind", ["one word", "two words in turn", "words and one word"])
def test_very_long_texts(kind):
    rng = np.random.default_rng(2)
    n = 400_000
    w = np.zeros(n, np.int32) if kind == "one word" else np.arange(n) % 2 if kind == "two words in turn" else np.r_[rng.zipf(1.3, n // 2) % 5000, np.full(n // 2, 7)]
    began = time.perf_counter()
    runs = periodic.runs_of(w)
    assert time.perf_counter() - began < 20
    assert (0, n, 1 if kind == "one word" else 2) in runs if kind != "words and one word" else any(length >= n // 2 and p == 1 for _, length, p in runs)


def loop(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def test_query_columns(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, None if i % 13 == 0 else " \n ".join(made(rng)) if i % 3 else "" if i % 7 == 0 else "  ".join(["la"] * rng.randint(0, 60)), "x") for i in range(120)]
    rows += [rows[5], rows[7], (None, "la " * 30, "x"), (121, "ü " * 25 + "\x1c\x85", "x"), (122, "tic tac " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, _ in rows:
        w = loop(i, t)
        runs = plain_runs(w) if i != 122 else periodic.runs_of(np.array([len(x) + x[1] for x in w]))
        stay = [True] * len(w)
        for s, k, p in runs:
            stay[s + p : s + k] = [False] * (k - p)
        best = (None, None, None, None)
        for s, k, p in runs:
            if best[0] is None or k * best[2] > best[1] * p:
                best = (s, k, p, 1000 * k // p)
        want.append((i if i is not None else -1, len(runs), *best, hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for x, y in zip(w, stay) if y)).hexdigest()))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in periodic.op13_periodic(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[1] for r in got) > 20
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120)) > 3


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, collapsed string")
    assert periodic.find_runs(none).count() == 0 and periodic.find_runs(none.withColumn("n_runs", F.lit("clash"))).columns == ["doc_id", "text", "n_runs", "runs", "collapsed"]
