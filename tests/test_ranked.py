"""Running sums by parts, and the ordinal codes that come from them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ordinate.operators import prep, rank


def test_running_sums(spark):
    rng = random.Random(4)
    values = rng.sample(range(-10**6, 10**6), 3000)
    rows = [(float(v) / 8, rng.randrange(5)) for v in values]
    df = spark.createDataFrame(rows, "v double, w long").repartition(7)
    got = {r["v"]: r["before"] for r in rank.ranked(df, "v", "w").collect()}
    run, want = 0, {}
    for v, w in sorted(rows):
        want[v], run = run, run + w
    assert got == want
    assert rank.ranked(df.limit(0), "v", "w").count() == 0
    assert [r["before"] for r in rank.ranked(df.limit(1), "v", "w").collect()] == [0]


def test_codes_of_many_values(spark):
    words = sorted({f"w{(i * 7919) % 5003}" for i in range(4000)} | {"", "é", "\U0001f600"}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "s string").withColumn("flag", F.length("s") > 4)
    out = prep.encode_ordinal(df.withColumn("old", F.col("s")), ["s"]).collect()
    place = {w: i for i, w in enumerate(words)}
    assert len(out) == 2 * len(words) + 1 and all(r["s"] == place.get(r["old"], -1) for r in out)
    assert {r["flag"] for r in prep.encode_ordinal(df, ["flag"]).collect()} == {-1, 0, 1}
