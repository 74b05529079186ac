"""The training-data operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ordinate.llm import bpe, decontam, html, line_dedup, pii, sharding, simhash, suffix_dedup, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n_lines", "n_dropped", "fp", "component_id", "n_words", "n_hit", "items", "hit", "contaminated", "score", "predicted", "n_tokens", "ids", "base", "spans", "size", "shard", "slot", "text_crc32", "mask", "k0", "id", "batch", "root", "n"]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Lambda", "mü"]) + str(rng.randint(0, 30)) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [words(rng, n) for n in (1, 3, 4, 12, 13, 40, 120, 300, 2500)]
    out = [None, "", "\n", " \n\t ", "a", *base]
    out += [base[6], base[6], base[7] + " end", "x " + base[7], base[5] + "\n" + base[6] + "\n" + base[5] + "\nshort"]
    out += ["ab" * 400, "ab" * 300 + "c", "z" * 1000, (base[6][:150] + "|" + base[6][:150]), "é" * 130 + "q" + "é" * 130]
    out += [base[7].replace(" ", "\n"), base[7].upper().replace(" ", " \n "), base[8] + "\n" + "A common LINE here\n" * 3, "  a common line HERE \t\nelse", "a common line here"]
    return out


def rows():
    t = texts()
    out = [(i * 3 % 101, x, "en", f"s{i % 2}", i) for i, x in enumerate(t)]
    return [*out, out[9], out[20], (None, t[10], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return -(2**63) if i is None else i


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_line_dedup(docs, none):
    k = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    owners: dict = {}
    for i, t, *_ in rows():
        for line in (t or "").split("\n"):
            owners.setdefault(k(line), set()).add(key(i))
    want = []
    for i, t, *_ in rows():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k(x)) >= 10 and len(owners[k(x)]) > 1 and min(owners[k(x)]) != key(i))]
        want.append((key(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = [(key(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, shards=3).collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup.dedup_lines(none).count() == 0
    keys = np.random.default_rng(0).integers(0, 2**64, (5000, 2), dtype=np.uint64)
    mph = line_dedup.PerfectHash(keys)
    assert sorted(mph.index(keys)) == list(range(5000))


def brute_repeats(items):
    seen, out = set(), []
    done = set()
    for i, t in items:
        b = (t or "").encode()
        if (i, b) in done:
            out.append(next(x for x in out if x[0] == i and x[4] == b))
            continue
        done.add((i, b))
        cover = bytearray(len(b))
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                cover[j : j + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(b, cover) if not m)
        spans = sum(1 for j in range(len(b)) if cover[j] and not (j and cover[j - 1]))
        out.append((i, kept, len(b) - len(kept), spans, b))
    return [x[:4] for x in out]


def test_suffix_dedup(docs, none, spark):
    want = brute_repeats(sorted([(key(i), t) for i, t, *_ in rows()], key=lambda x: x[0]))
    got = [(key(r["doc_id"]), bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_repeats(docs, parts=3).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.dedup_repeats(none).count() == 0
    rng = random.Random(1)
    for trial in range(3):  # few letters, periods, copies with edits
        base = "".join(rng.choice("ab") for _ in range(700))
        some = []
        for i in range(40):
            s = base[rng.randint(0, 300) : rng.randint(350, 700)]
            for _ in range(rng.randint(0, 3)):
                p = rng.randint(0, len(s))
                s = s[:p] + rng.choice(["", "x", "abab" * 40, s[:120]]) + s[p + rng.randint(0, 2) :]
            some.append((i, s))
        got = suffix_dedup.dedup_repeats(spark.createDataFrame(some, "doc_id long, text string").repartition(4), parts=2).collect()
        assert sorted((r["doc_id"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in got) == brute_repeats(some)


def test_loser_tree_never_recompares():
    rng = random.Random(2)
    runs = []
    for _ in range(7):
        own = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30)))
        runs.append((own, [0, *(suffix_dedup.common_prefix(a, b, 0) for a, b in zip(own, own[1:]))][: len(own)], [0] * len(own)))
    out, prev = [], b""
    for r, i, h in suffix_dedup.LoserTree(runs).merged():
        s = runs[r][0][i]
        assert h == suffix_dedup.common_prefix(prev, s, 0)
        out.append(s)
        prev = s
    assert out == sorted(x for r in runs for x in r[0])


def brute_print(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none, spark):
    prints = [(i, brute_print(t)) for i, t, *_ in rows()]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {g: min(key(i) for (i, _), h in zip(prints, group) if h == g) for g in group}
    want = sorted((key(i), f"{p:016x}", first[g]) for (i, p), g in zip(prints, group))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((key(r["doc_id"]), r["fingerprint"], key(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0
    kept = {key(r["doc_id"]) for r in simhash.keep_first(docs).collect()}
    assert kept == set(first.values())


def test_links_in_crowded_cells(spark):
    rng = np.random.default_rng(6)
    centers = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fp = set(int(c) for c in centers)
    for c in centers:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(b)
            fp.add(x)
    u = np.array(sorted(fp), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    root = {r["id"]: r["root"] for r in simhash.components(df, simhash.links(df, cell=16)).collect()}
    part = {int(x): int(x) for x in u.view(np.int64)}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    s = u.view(np.int64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 4):
            part[find(int(s[i]))] = find(int(s[j]))
    for i in range(len(u)):
        for j in range(i):
            assert (find(int(s[i])) == find(int(s[j]))) == (root.get(int(s[i]), int(s[i])) == root.get(int(s[j]), int(s[j])))


def test_popcounts_bound_the_distance():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, (2, 500), dtype=np.uint64)
    low = np.abs(simhash.embed(a).astype(int) - simhash.embed(b)).sum(axis=1)
    assert (low <= np.bitwise_count(a ^ b)).all() and simhash.embed(np.array([2**64 - 1], np.uint64)).sum() == 64


PAGES = [
    (1, "u1", "<html><body><nav><a href='/'>menu here</a></nav><article><h1>Head &amp; line</h1><p>One  two\nthree.<p>Four<br>five.</p><div class='ad'>buy</div></article><footer>foot</footer></body></html>"),
    (2, "u2", None), (3, "u3", ""), (4, "u4", "no tags at all"), (5, None, "<article><p>unclosed <b>bold <p>next &lt;x&gt; &#233;"), (5, None, "<article><p>unclosed <b>bold <p>next &lt;x&gt; &#233;"),
    (6, "u6", "<article>" + "<p>para of words. </p>" * 3000 + "</article>"), (7, "u7", "<" * 3000 + "a='" * 2000), (8, "u8", "<div>" * 3000 + "deep"),
]


def test_html(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit("clash")})
    sample = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    model = html.train(sample[:150])
    got = {r["page_id"]: r["text"] for r in html.extract(pages, model).collect()}
    assert html.extract(pages, model).count() == len(PAGES)
    assert got[2] == got[3] == "" and "menu" not in got[1] and "foot" not in got[1] and "One two three." in got[1].split("\n") and "Four five." in got[1].split("\n")
    assert got[5] == "unclosed bold\nnext <x> é" and got[6].count("para of words.") >= 2990
    assert html.extract(pages.limit(0), model).count() == 0
    good = 0
    for h in sample[150:]:
        own = re.search("<article>(.*?)</article>", h, re.S)[1]
        plain = [" ".join(html.entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", own)]
        good += html.main_text(h, model) == "\n".join(filter(None, plain))
    assert good >= 0.97 * len(sample[150:])


def test_decode_keeps_no_node_under_a_dropped_one():
    nodes = html.parse("<body><div><p>a b c</p><div><p>d</p></div></div><p>e</p></body>")
    for seed in range(20):
        chosen = html.decode(nodes, np.random.default_rng(seed).normal(size=len(nodes)) * 3)
        assert all(not c or x.parent is None or chosen[x.parent.order] for x, c in zip(nodes, chosen))


def test_decontamination(docs, none, spark):
    t = texts()
    items = [(1, t[10]), (2, " ".join(t[11].split()[5:30]).upper()), (3, "a"), (4, None), (5, ""), (6, t[9]), (7, t[9]), (10, "kappa1, kappa2!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))
    want = []
    for i, x, *_ in rows():
        d, hit, found = w(x), set(), set()
        for item, b in items:
            q = w(b)
            n = min(13, len(q))
            for j in range(len(q) - n + 1) if q else ():
                for a in range(len(d) - n + 1):
                    if d[a : a + n] == q[j : j + n]:
                        hit.update(range(a, a + n))
                        found.add(str(item))
        want.append((key(i), len(d), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(d)))
    for size in (1 << 20, 100):  # one automaton, and several
        got = decontam.scan(docs, bench, automaton_bytes=size).collect()
        assert sorted((key(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got) == sorted(want)
    assert decontam.scan(none, bench).count() == 0 and decontam.scan(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.hit_spans("One, two three; four", b"\x00\x01\x01\x00") == [(5, 14)]


def test_toxicity(spark, docs, none):
    rng = random.Random(3)
    some, y = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = words(rng, rng.randint(5, 90)).split()
        for _ in range(3 if bad else 0):
            w.insert(rng.randint(0, len(w)), "vile" + rng.choice(["", "st", "ness"]))
        some.append(" ".join(w).encode())
        y.append(bad)
    y = np.array(y)
    model = toxicity.train(some[:450], y[:450])
    assert ((model.scores(toxicity.words_of(some[450:])) >= 0.5) == y[450:]).mean() >= 0.97
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == 0 for r in got if not r["text"])
    assert toxicity.score_texts(none, model).count() == 0
    assert toxicity.train([], np.zeros(0)).scores(toxicity.words_of([b"x y"]))[0] < 0.5
    # each text alone scores as it does among others
    alone = [float(model.scores(toxicity.words_of([s]))[0]) for s in some[:20]]
    assert np.allclose(alone, model.scores(toxicity.words_of(some[:20])), atol=1e-5)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(101)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) and toxicity.fit(docs, labels.limit(0)).scores(toxicity.words_of([b"x"]))[0] < 0.5


def test_gradients():
    w = toxicity.words_of([b"alpha beta gamma alpha", b"idiot beta zz"])
    m = toxicity.Model(np.unique(np.concatenate(w.units)))
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    first, owner = w.windows()
    at, mask = toxicity._slots(first, w.first[1:][owner])
    at, mask = at[:5], mask[:5].astype(float)
    rows, raw, c = m.rows(w)[at], toxicity._letters(w, at), np.array([1.0, -0.7])
    loss = lambda: float((m.forward(rows, raw @ m.p["C"], mask) * c).sum())
    g = m.gradients(rows, raw, raw @ m.p["C"], mask, c)
    triple, row = int(raw.triple[0]), int(g["rows_of_E"][1])
    for k, i in (("v", (0,)), ("u", (1,)), ("c", (0,)), ("C", (triple, 1)), ("W", (0, 2, 5)), ("W", (1, 9, 20)), ("U", (0, 3, 2)), ("U", (1, 1, 21)), ("B", (1, 0, 12)), ("E", (row, 3))):
        m.p[k][i] += 1e-4
        up = loss()
        m.p[k][i] -= 2e-4
        down = loss()
        m.p[k][i] += 1e-4
        j = (1, 3) if k == "E" else i
        assert abs((up - down) / 2e-4 - g[k][j]) < 1e-4 and (up != down or k == "c")


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    def ok(k, s):
        d = [int(c) for c in s if c.isdigit()]
        if k == 1:
            return all(int(x) <= 255 for x in s.split("."))
        if k == 2:
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
        return k == 0 or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if ok(k, m[0]))


def test_pii(docs, none):
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("ab._%@@..0123456789 +-()\nZé") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("1" * 20000 + "@" + "a." * 5000 + "5.6.7.8") is not None
    card = "4785380592391139"
    train = [f"pay {card[:4]} with card {card} ok {i} things 3.4" for i in range(40)] + [f"mail me{i}@x.org or +49 151 2345678{i % 10} at 10.0.0.{i}" for i in range(40)]
    field = pii.train(train)
    base, more = pii.find([f"first {card} and then 4785.3805.9239.1139 in 2020"], field)[0]
    assert [k for _, k, _ in base] == [2] and all(not (a < z2 and a2 < z) for a, _, z in more for a2, _, z2 in base)
    got = pii.find_spans(docs, field).collect()
    assert len(got) == len(rows()) and pii.find_spans(none, field).count() == 0
    assert pii.find([""], pii.train([])) == [([], [])]
    assert pii.masked("to a@b.c now", "email:3:8") == "to <email> now"


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.default_vocabulary())
    enc = bpe.Encoder(bpe.default_vocabulary())
    rng = random.Random(9)
    tries = ["", " ", "a" * 3000, " " * 999, "<|endoftext|>", "x<|endoftext|> y", "\n\n\n", " a", "a ", "\n a\n", "it's  we'll\t x \x1c y", "漢字 😀 naïve"]
    tries += ["".join(rng.choice(["the", "in", "ing", " ", "tion", "'s", "ab", "ba", "aa", "  ", "\n", "é", "7"]) for _ in range(40)) for _ in range(400)]
    for t in tries:
        ids = ref.encode(t, add_special_tokens=False).ids
        mine = np.frombuffer(enc.encode(t), "<u4")
        assert mine.tolist() == ids and enc.decode(mine).decode() == ref.decode(ids, skip_special_tokens=False)
    for r in bpe.encode_texts(docs).collect():
        t = r["text"] or ""
        assert r["ids"] == ref.encode(t, add_special_tokens=False).ids and r["decoded"] == t and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.encode_texts(none).count() == 0


def test_sharding(docs, none, spark):
    got = sharding.assign_shards(docs, shards=4).collect()
    assert len(got) == len(rows())
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in got)
    assert sharding.assign_shards(none).count() == 0
    rng = random.Random(8)
    many = [(i, "hot " * 30 if i % 3 == 0 else words(rng, rng.randint(1, 60))) for i in range(6000)]
    out = sharding.assign_shards(spark.createDataFrame(many, "doc_id long, text string"), shards=6).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total = [r["b"] for r in out]
    assert len(total) == 6 and max(total) <= 1.03 * min(total)
    groups = sharding.assign_shards(spark.createDataFrame(many, "doc_id long, text string"), shards=6).filter("text NOT LIKE 'hot%'").groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert groups.filter("n > 1").isEmpty()


@pytest.mark.parametrize("scale", [0.05, 1.0])
def test_topk(spark, scale):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 6)) * scale
    x[50:60] = x[40]
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    data += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (2004, [1.0, 2.0]), (2100, [0.5, 1.0]), (2005, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).cache()
    good = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in data if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for i, q in good.items():
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in good.items() if j != i and len(v) == len(q))[:10]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), leaf=16, shard_rows=200, block_queries=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, int(i % 7 == 0), int(i % 2)) for i in range(101)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, texts()[11])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, none):
            out = stage(spark, df, d)
            if name != "bpe":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.count() <= df.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    step = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, d).collect(), SCHEMA)
    assert corpus_pipeline.run(spark, d).count() == step.count() > 0
