"""URL filters against a plain reading of every rule for every URL."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ordinate.llm import url_filter as U

A, Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[at:]
    return rest[:at].translate(str.maketrans(A, Z)), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def judged(url, rules, listed):
    host, path = parts(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[2], max(fit)[3]
    return host, path, None, "block" if host and (host, path) in {parts(x) for x in listed} else "allow"


def urls(rng, n):
    def one():
        host = ".".join(rng.choice(["a", "b", "WWW", "x1", "com", "net", "é", ""]) for _ in range(rng.randint(1, 5)))
        path = "".join("/" + rng.choice(["en", "es", "fr", "a", "", "ab"]) for _ in range(rng.randint(0, 4)))
        return rng.choice(["http://", "https://", "://", "", "x://y://"]) + host + path + rng.choice(["", "?q=/en/", "#top", "?", "/?a#b", "\n"])

    return [one() for _ in range(n)] + [None, "", "://", "http:///en/", "http://a.com" + "/en" * 20_000, "http://" + "a." * 20_000 + "com/en/", "HTTP://Example.COM/en/1"]


@pytest.mark.parametrize("blocks", [1 << 18, 1])
@pytest.mark.parametrize("few", [50_000, 0])
def test_against_all_rules(spark, blocks, few):
    rng = random.Random(few + blocks)
    some = [(rng.choice(["a", "com", "b.com", "x1.b.com", "net", "www.a", "é", "A.net", "b..com"]), rng.choice(["", "/", "/en", "/en/", "/e", "/en/a/", "/es/", "//"]), rng.choice(["allow", "block"])) for _ in range(40)]
    rules = {(h.translate(str.maketrans(A, Z)), p): v for h, p, v in sorted(some, key=lambda r: r[2])}
    own = urls(rng, 900)
    listed = rng.sample(own[:900], 60) + [None, "http://a.com" + "/en" * 20_000]
    rows = [(i if i % 50 else None, u, "x") for i, u in enumerate(own)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(3)
    table = spark.createDataFrame([*some, (None, "/", "block"), ("", "/", "block"), ("a", None, "block"), ("a", "/", None)], "host string, path string, verdict string")
    got = U.judge_urls(pages, table, spark.createDataFrame([(u,) for u in listed], "url string"), most_blocks=blocks, few=few, hot=20).collect()
    want = [(i, u, *judged(u, [(*k, v) for k, v in rules.items()], listed)) for i, u, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["verdict"] for r in got} == {"allow", "block"} and any(r["rule"] for r in got)


def test_empty_tables_and_lists(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert sorted(map(tuple, U.judge_urls(pages, rules.limit(0)).select("page_id", "host", "rule", "verdict").collect())) == [(1, "a.com", None, "allow")] * 2 + [(2, "", None, "allow")]
    assert [r["rule"] for r in U.judge_urls(pages.filter("page_id = 1"), rules).collect()] == ["com/"] * 2


def test_one_url_many_times(spark):
    pages = spark.range(60_000).selectExpr("cast(1 AS long) AS page_id", "CASE WHEN id % 3 = 0 THEN concat('http://h', id, '.org/') ELSE 'http://www.example.com/en/1' END AS url")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.judge_urls(pages, rules, few=0, hot=1000).groupBy("rule").count().orderBy("rule").collect() == [(None, 20_000), ("www.example.com/en/", 40_000)]


def test_filter_misses_nothing(spark):
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(2**63), 2**63, (2, 20_000))
    df = spark.createDataFrame([(int(x),) for x in own], "h long")
    bloom = U.BlockedBloom.build(df, len(own))
    assert bloom.may_hold(own).all() and bloom.may_hold(other).mean() < 0.01 and bloom.words.nbytes <= 1 << 17
    small = U.BlockedBloom.build(df, len(own), most_blocks=4)
    assert small.may_hold(own).all() and small.words.shape == (4, 8)
