"""The manifest against a plain tree built in one place."""

from __future__ import annotations

import random
import zlib
from functools import partial
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ordinate.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda s: sha256(s.encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes):
    """(root, the siblings left and right of each leaf by level)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            lo = i // 8 * 8
            paths[k].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
        nodes = [H("".join(nodes[lo : lo + 8])) for lo in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(("0" if r[2] is None else "1" + r[2]).encode(), []).append(r)
    order, subs, inner = sorted(groups), [], {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (-(2**63) if r[0] is None else r[0], leaf(*r)))
        root, paths = tree([leaf(*r) for r in own])
        subs.append(root)
        inner[g] = list(zip(own, paths))
    root, upper = tree(subs)
    out = []
    for g, sub, up in zip(order, subs, upper):
        for r, path in inner[g]:
            full = path + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if hit and r[1] is not None else r[1]
            node = leaf(r[0], low, *r[2:])
            for a, b in full:
                node = H(a + node + b)
            out.append((r[0], leaf(*r), sub, root, H("".join(a + b for a, b in full)), node, node == root))
    return out


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_query_against_a_plain_tree(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "manifest", partial(merkle.manifest, levels=levels))  # blocks of 4096, 8 and 64: several tables of roots
    rng = random.Random(levels)
    text = lambda: rng.choice([None, "", "Abc", "é Ä", "x" * 5000, "Ab " * rng.randint(1, 9)])
    rows = [(i * 7 % 1009 - 5, text(), rng.choice(["en"] * 5 + ["de", None, ""]), rng.choice(["s", None, "1:-"]), rng.choice([None, i])) for i in range(700)]
    rows += [rows[3], rows[3], (rows[4][0], "other", *rows[4][2:]), (None, "A", "en", "s", 1), (None, "B", "en", None, 1), (5000, "one", "fr", "s", 0)]
    rows += [(6000 + i, "T", f"lang {i:02d}", "s", 0) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("leaf", "root", "path", "ord", "group")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_one_language(spark, n):
    rows = [(i, "A", None, None, None) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in got) == sorted(r[:4] for r in (plain(rows) if n else []))


def test_traversal_holds_little_and_is_whole():
    leaves = [H(str(i)) for i in range(8**4)]
    _, want = tree(leaves)
    assert [list(zip(a, b)) for a, b in merkle.traversed(leaves, 4)] == want
    stack = merkle.Treehash(3)
    held = 0
    for x in leaves[:4096]:
        stack.add(x)
        held = max(held, sum(map(len, stack.stack)))
    assert held <= 8 + 7 * 3 and len(stack.finish()) == 8
