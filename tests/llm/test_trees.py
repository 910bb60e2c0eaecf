"""The additive model's fit against loops over rows, and its odd rows."""

import itertools
import math

import numpy as np

from tidewake.llm import quality


def leaf(rows):
    return sum(g for g, _ in rows) / (sum(h for _, h in rows) + quality.PRIOR)


def gain(rows):
    return sum(g for g, _ in rows) ** 2 / (sum(h for _, h in rows) + quality.PRIOR)


def brute_tree(rows, bins):
    """The best split of all rows by bin, then the best one of its two sides; values by bin."""
    parts = [list(range(bins))]
    of = lambda part: [r for b, r in rows if b in part]
    for _ in range(2):
        found = [(gain(of(p[:i])) + gain(of(p[i:])) - gain(of(p)), k, i) for k, p in enumerate(parts) for i in range(1, len(p))]
        won, k, i = max(found, key=lambda x: x[0], default=(0, 0, 0))
        if won <= 1e-9:
            break
        parts[k : k + 1] = [parts[k][:i], parts[k][i:]]
    return [leaf(of(next(p for p in parts if b in p))) for b in range(bins)]


def brute_cross(rows, n, m):
    """The best pair of splits, one each way; (gain, values)."""
    cells = lambda i, j: {(a, b): [r for x, y, r in rows if (x >= i) == a and (y >= j) == b] for a in (False, True) for b in (False, True)}
    every = [r for _, _, r in rows]
    won, i, j = max(((sum(map(gain, cells(i, j).values())) - gain(every), i, j) for i, j in itertools.product(range(1, n), range(1, m))), key=lambda x: x[0])
    return won, [[leaf(cells(i, j)[x >= i, y >= j]) for y in range(m)] for x in range(n)]


def test_op5_fit_by_loops(monkeypatch):
    for name, value in (("ROUNDS", 3), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 6), ("PAIR_BINS", 3)):
        monkeypatch.setattr(quality, name, value)
    rnd = np.random.default_rng(4)
    x = np.round(rnd.normal(size=(90, 3)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rnd.normal(size=90) / 3 > 0).astype(float)
    model = quality.fit(x, y)
    bin_of = lambda edges, v: sum(e <= v for e in edges)
    p = (y.sum() + 0.5) / 91
    base, z = math.log(p / (1 - p)), [math.log(p / (1 - p))] * 90
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    slope = lambda i: (y[i] - 1 / (1 + math.exp(-z[i])), (q := 1 / (1 + math.exp(-z[i]))) * (1 - q))
    for _ in range(3):
        for j, e in enumerate(model.edges):
            step = brute_tree([(bin_of(e, x[i, j]), slope(i)) for i in range(90)], len(e) + 1)
            tables[j] = [a + quality.RATE * b for a, b in zip(tables[j], step)]
            z = [v + quality.RATE * step[bin_of(e, x[i, j])] for i, v in enumerate(z)]
    for j, e in enumerate(model.edges):
        mean = sum(tables[j][bin_of(e, x[i, j])] for i in range(90)) / 90
        tables[j] = [t - mean for t in tables[j]]
        base += mean
        assert np.allclose(model.tables[j], tables[j])
    assert np.isclose(model.base, base)
    coarse = {k: e for a, b, ea, eb, _ in model.pairs for k, e in ((a, ea), (b, eb))}
    edges = [coarse.get(j, quality._edges(x[:, j], 3)) for j in range(3)]
    place = lambda j, k: [(bin_of(edges[j], x[i, j]), bin_of(edges[k], x[i, k]), slope(i)) for i in range(90)]
    size = lambda j: len(edges[j]) + 1
    best = sorted(((brute_cross(place(j, k), size(j), size(k))[0], j, k) for j in range(3) for k in range(j + 1, 3)), reverse=True)[:2]
    assert [(j, k) for _, j, k in best] == [(j, k) for j, k, *_ in model.pairs]
    grids = [np.zeros((size(j), size(k))) for _, j, k in best]
    for _ in range(2):
        for grid, (_, j, k) in zip(grids, best):
            step = quality.RATE * np.array(brute_cross(place(j, k), size(j), size(k))[1])
            grid += step
            z = [v + step[bin_of(edges[j], x[i, j]), bin_of(edges[k], x[i, k])] for i, v in enumerate(z)]
    for grid, (*_, t) in zip(grids, model.pairs):
        assert np.allclose(grid, t)
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-v)) for v in z])


def test_op5_odd_rows(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None), (3, ""), (4, "word " * 200_000)]
    schema = "doc_id long, text string, score string, predicted string, y int, x int, quality int"
    df = spark.createDataFrame([(*r, "s", "p", 1, 2, 3) for r in rows], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 0), (None, 1), (9, 1), (3, 7)], "doc_id long, quality int")
    got = quality.score(df, quality.train(df, labels)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(got) == len(rows) and by[1] == by[None] and by[2] == by[3] and all(len(v) == 1 for v in by.values())
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels)).count() == 0
