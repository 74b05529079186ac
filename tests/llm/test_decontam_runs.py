"""Windows found by aligned runs, against every window of every item; offsets in the original text."""

from __future__ import annotations

import random
import re
import time

from ordinate.llm import decontam


def brute(doc, items, width):
    hit, found = set(), set()
    for k, item in enumerate(items):
        n = min(width, len(item))
        for j in range(len(item) - n + 1) if item else ():
            for a in range(len(doc) - n + 1):
                if doc[a : a + n] == item[j : j + n]:
                    hit.update(range(a, a + n))
                    found.add(k)
    return hit, found


def test_runs_find_every_window():
    rng = random.Random(1)
    for trial in range(300):
        width = rng.choice([2, 3, 4, 5, 13])
        letters = [b"a", b"b", b"c", b"aa"][: rng.randint(2, 4)]
        words = lambda n: [rng.choice(letters) for _ in range(n)]
        items = [words(rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        doc = words(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)
            lo = rng.randint(0, len(item))
            doc += item[lo : lo + rng.randint(0, 30)] + words(rng.randint(0, 3))
        spans, found = decontam.Matcher([((str(i),), w) for i, w in enumerate(items) if w], width).hits(doc)
        kept = [i for i, w in enumerate(items) if w]
        assert ({p for lo, hi in spans for p in range(lo, hi)}, {kept[k] for k in found}) == brute(doc, items, width)


def test_crowded_runs_find_every_window(monkeypatch):
    rng = random.Random(2)
    for trial in range(300):
        monkeypatch.setattr(decontam, "PLACES", rng.choice([0, 1, 3]))
        width = rng.choice([2, 3, 5, 13])
        words = lambda n: [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
        opening = words((width + 1) // 2)
        items = [opening + words(rng.randint(0, 20)) for _ in range(rng.randint(1, 9))]
        items = [w for i, w in enumerate(items) if w not in items[:i]]
        doc = words(rng.randint(0, 10))
        for _ in range(4):
            doc += rng.choice(items)[: rng.randint(0, 30)] + words(rng.randint(0, 3))
        spans, found = decontam.Matcher([((str(i),), w) for i, w in enumerate(items)], width).hits(doc)
        assert ({p for lo, hi in spans for p in range(lo, hi)}, found) == brute(doc, items, width)


def test_a_run_of_very_many_items():
    opening = b"which of the following statements is true".split()
    items = [((str(i),), [*opening, *(b"w%d" % (i * 7 + j) for j in range(12))]) for i in range(20_000)]
    matcher = decontam.Matcher(items, 13)
    doc = [x for i in range(200) for x in (*opening, b"x%d" % i)] + items[77][1]
    began = time.perf_counter()
    spans, found = matcher.hits(doc)
    assert time.perf_counter() - began < 0.05 and found == {77} and max(hi for _, hi in spans) == len(doc)


def test_offsets_of_the_original(spark):
    item = "What is the Answer, if any; to a question of över thirteen words or more than that?"
    text = f"é😀 intro -- {item.upper().replace('Ö', 'ö')} and an end"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, item)], "item_id long, text string")
    for size in (1 << 20, 40):
        got = {r["doc_id"]: r for r in decontam.scan(docs, bench, automaton_bytes=size).collect()}
        (span,) = got[1]["hit_at"]
        assert text[span["start"] : span["stop"]].lower() == re.sub(r"\?$", "", item.lower())
        assert got[1]["items"] == ["10", "9"] and got[1]["contaminated"] and got[2]["hit_at"] == got[3]["hit_at"] == []
