"""The pipeline against plain Python: of the toxicity stage only the model's own scores are taken, the other four stages are
worked out by brute force over what it keeps."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ordinate.llm import bpe, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "\t\n\x0b\x0c\r "
PROMISE = "what every clean page repeats at its foot"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def made():
    """(documents, benchmark, labels), with copies, near copies, shared lines, benchmark passages, nulls and repeated ids."""
    rng = random.Random(11)
    clean = [a + b for a in ("ma", "ro", "ti", "su", "ve", "Lo", "pé") for b in ("ran", "del", "kis", "mont", "feth", "gar")]
    foul = [a + b for a in ("grub", "zok", "vex") for b in ("nar", "lish", "oom", "ack")]
    prose = lambda n, odd=0.0: " ".join(rng.choice(foul if rng.random() < odd else clean) + rng.choice(["", "", ",", "."]) for _ in range(n))
    bench = [(f"b{i}", prose(n)) for i, n in enumerate((30, 20, 13, 5))] + [("null", None), ("none", "")]
    texts, toxic = [], []
    for i in range(360):
        bad = i % 3 == 0
        texts.append(prose(rng.randint(20, 160), 0.5 if bad else 0.0))
        toxic.append(int(bad))
    for i in range(40):  # lines that several share, with other cases and margins
        texts.append("\n".join([prose(30), rng.choice([PROMISE, f"  {PROMISE.upper()}\t"]), prose(25), "short"]))
        toxic.append(0)
    for i in (361, 365, 370):  # exact copies, and copies with one word more at the end of a long text
        long = prose(900)
        texts += [long, long, long + " end", texts[i]]
        toxic += [0] * 4
    for i, (_, t) in enumerate(bench[:4]):
        texts += [prose(40) + " " + t + " " + prose(30), t, lower(t).upper(), prose(900) + " " + t]
        toxic += [0] * 4
    texts += [None, "", " \n\t", "one", "<|endoftext|> and 漢字"]
    toxic += [0] * 5
    docs = [(i * 7 % 1009, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(d[0], 1, y) for d, y in zip(docs, toxic)]
    return docs + [docs[4], docs[-5]], bench, labels


def dedup_lines(docs):
    key = lambda line: lower(line.strip(SPACE))
    holders = {}
    for i, t, *_ in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    stays = lambda i, line: len(key(line)) < 10 or len(holders[key(line)]) < 2 or i == min(holders[key(line)])
    return [(i, "\n".join(x for x in (t or "").split("\n") if stays(i, x)), *rest) for i, t, *rest in docs]


def first_of_near(docs):
    def mark(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]).encode(), 42) for j in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    root = {d[0]: d[0] for d in docs}
    marks = [(d[0], mark(d[1])) for d in docs]
    for a, x in marks:
        for b, y in marks:
            if (x ^ y).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return [d for d in docs if root[d[0]] == d[0]]


def not_in_benchmark(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = set()
    for _, t in bench:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    out = []
    for d in docs:
        w = words(d[1])
        hit = {p for x in windows for j in range(len(w) - len(x) + 1) if w[j] == x[0] and tuple(w[j : j + len(x)]) == x for p in range(j, j + len(x))}
        if not hit or 20 * len(hit) < len(w):
            out.append(d)
    return out


def test_whole_pipeline(spark, tmp_path):
    d = str(tmp_path)
    docs, bench, labels = made()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    scored = toxicity.score_texts(table, toxicity.fit(table, spark.read.parquet(f"{d}/labels.parquet")))
    kept = [tuple(r) for r in scored.filter("predicted = 0").select(*corpus_pipeline.COLUMNS).collect()]
    marked = {i for i, _, y in labels if y}
    assert sum(k[0] in marked for k in kept) <= 0.1 * len(marked)
    assert sum(k[0] not in marked for k in kept) >= 0.9 * sum(x[0] not in marked for x in docs)

    lines = dedup_lines(kept)
    first = first_of_near(lines)
    last = not_in_benchmark(first, bench)
    assert len(kept) > len(first) > len(last) > 100 and lines != kept  # every stage has something to do
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, t, *_ in last:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        back = ref.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, d).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.filter(F.col("n_tokens") == 0).count() <= 1  # of the empty texts one stays
