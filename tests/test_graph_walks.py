"""Graph walks that go side by side: what each finds is what a walk alone finds, point by point."""

from __future__ import annotations

import heapq

import numpy as np
import pytest

from ordinate.operators import ann


def alone(graph, q, k):
    """The walk of one query by a heap, over the graph's links."""
    far = lambda i: float(((graph.x[i] - q) ** 2).sum())
    at = graph.entry
    for layer in range(int(graph.level[graph.entry]), -1, -1):
        ef = 1 if layer else max(k, graph.ef)
        seen, todo, best = {at}, [(far(at), at)], [(-far(at), at)]
        while todo:
            d, i = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            for j in graph.links[layer][i].tolist():
                if j >= 0 and j not in seen:
                    seen.add(j)
                    if len(best) < ef or far(j) < -best[0][0]:
                        heapq.heappush(todo, (far(j), j))
                        heapq.heappush(best, (-far(j), j))
                        if len(best) > ef:
                            heapq.heappop(best)
        at = max(best)[1]
    return [i for _, i in sorted((-d, i) for d, i in best)[:k]]


def vectors(n, d=16, seed=4):
    return np.random.default_rng(seed).normal(size=(n, d))


@pytest.mark.parametrize("n", [0, 1, 2, 9, 700])
def test_walks_side_by_side_find_what_each_finds_alone(n):
    graph, queries = ann._Graph(vectors(n), 8, 20), vectors(300, seed=5)
    row, found, far = graph.knn(queries, 5)
    assert np.bincount(row, minlength=300).tolist() == [min(5, n)] * 300
    for i in range(0, 300, 7):
        own = found[row == i]
        assert own.tolist() == (alone(graph, queries[i], 5) if n else [])
        assert far[row == i].tolist() == ((graph.x[own] - queries[i]) ** 2).sum(axis=1).tolist()


def test_many_queries_take_few_tables_and_batches(monkeypatch):
    tables = []
    make = ann._Graph._table
    monkeypatch.setattr(ann._Graph, "_table", lambda self, q, rows: tables.append(len(q)) or make(self, q, rows))
    x = vectors(2000)
    graph = ann._Graph(x, 16, 40)
    assert len(tables) < 60 and sum(tables) == 1999  # points went in by batches, each once
    tables.clear()
    queries = vectors(1000, seed=6)
    row, found, _ = graph.knn(queries, 10)
    assert max(tables) <= ann.WALKS and len(tables) == 4
    want = np.argsort(((x[:, None] - queries[:200]) ** 2).sum(axis=2), axis=0)[:10].T
    assert np.mean([len(set(found[row == i].tolist()) & set(w.tolist())) / 10 for i, w in enumerate(want)]) >= 0.95


def test_larger_parts_walk_fewer_at_a_time(monkeypatch):
    monkeypatch.setattr(ann, "TABLE", 4000)
    graph = ann._Graph(vectors(500), 8, 20)
    assert graph.walks == 8
    row, found, _ = graph.knn(vectors(20, seed=5), 3)
    assert [found[row == i].tolist() for i in range(20)] == [alone(graph, q, 3) for q in vectors(20, seed=5)]


def test_copies_are_found_and_links_are_without_repeats():
    base = vectors(120)
    graph = ann._Graph(np.repeat(base, 10, axis=0)[np.random.default_rng(0).permutation(1200)], 16, 40)
    for own in graph.links:
        for i, to in enumerate(own):
            to = to[to >= 0]
            assert i not in to and len(set(to.tolist())) == len(to)
    row, _, far = graph.knn(base, 10)
    assert len(row) == 1200 and np.mean(far == 0) >= 0.9
