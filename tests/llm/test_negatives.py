"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from glimmergrid.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, id long, cell string, score double"


def table_of(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, "x", 0.5) for i, y, v in rows], SCHEMA)


def brute(rows, every=100, n_pos=5, n_neg=5, scale=256.0):
    fine = [(i, y, [math.floor(scale * float(np.float32(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return []
    sizes = [len(v) for _, _, v in fine]
    size = min(sorted(set(sizes)), key=lambda n: (-sizes.count(n), n))
    fine = [r for r in fine if len(r[2]) == size]
    out = []
    for a in sorted({i for i, _, _ in fine if i % every == 0}):
        label, v = min((y, v) for i, y, v in fine if i == a)
        told = sorted((-sum(p * q for p, q in zip(v, w)), i, y) for i, y, w in fine if i != a)
        for s, p, _ in [t for t in told if t[2] == label][:n_pos]:
            near = [(t, i) for t, i, y in told if y != label and Fraction(-s * 4, 5) <= -t <= -s][:n_neg]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, every=100, **more):
    told = hn.mine(table_of(spark, rows), lambda i: i % every == 0, **more)
    assert told.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in told.collect())


def clustered(seed, n, size=8, labels=4, groups=6):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((groups, size))
    return [(i, int(rng.integers(labels)), (middles[rng.integers(groups)] + 0.3 * rng.standard_normal(size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("cell_rows, max_words", [(1024, 64), (8, 6)])
def test_against_brute_force(spark, cell_rows, max_words):
    rows = clustered(1, 300)
    assert mined(spark, rows, 20, cell_rows=cell_rows, max_words=max_words, query_rows=4) == brute(rows, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)]
    rows += [(None, 1, [1.0] * 5), (61, None, [1.0] * 5), (62, 1, None), (63, 1, [1.0, None, 0.0, 0.0, 0.0]), (64, 1, [nan] * 5), (65, 1, [inf] * 5), (66, 2, [1.0]), (67, 2, []), (70, 0, [0.0] * 5)]
    # A third of all rows is one vector, ties go by id, and ids repeat.
    rows += [(100 + i, i % 2, [0.5, 0.5, 0.0, 0.0, 0.1]) for i in range(30)] + [rows[10], rows[10], (20, 2, [0.5, 0.5, 0.0, 0.0, 0.1])]
    assert mined(spark, rows, 10, cell_rows=8) == brute(rows, 10)


def test_empty_and_narrow(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, 1, None)]) == []
    for size in (0, 1, 2):
        rows = [(i, i % 2, [float(i % 5)] * size) for i in range(12)]
        assert mined(spark, rows, 4) == brute(rows, 4)
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])], 1) == []


def test_large_numbers(spark):
    rows = [(i, i % 2, [1e9 + 1e7 * i, -3e8, 7e8]) for i in range(12)]
    assert mined(spark, rows, 4, scale=1.0) == brute(rows, 4, scale=1.0)
    assert hn.inner_products(np.full((1, 2), 1 << 62), np.full((1, 2), 1 << 62)).tolist() == [[(1 << 63) - 1]]


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((400, 6))
    index = hn.MultiIndex(tuple(hn.codebook(h, 5, 0) for h in hn.halves(points)), (np.zeros(5), np.zeros(5)), frozenset(range(25)))
    (one, two), (a, b) = index.nearest_words(points)
    for k in range(5):
        index.radii[0][k], index.radii[1][k] = a[one == k].max(), b[two == k].max()
    cell = one * 5 + two
    index.occupied = frozenset(cell.tolist())
    for q in rng.standard_normal((20, 6)):
        x, y = (v[0] for v in index.bounds(q[None, :]))
        scores, bound = points @ q, x[one] + y[two]
        assert (scores <= bound).all()
        order = list(index.cells(x, y, 0, 25, -np.inf))
        sums = [x[c // 5] + y[c % 5] for c in order]
        assert sorted(order) == sorted(index.occupied) and sums == sorted(sums, reverse=True)
        assert list(index.cells(x, y, 3, 7, -np.inf)) == order[3:7]
        kept = list(index.cells(x, y, 0, 25, 0.5))
        assert kept == [c for c, s in zip(order, sums) if s >= 0.5] and not (scores[~np.isin(cell, kept)] >= 0.5).any()


def test_query(spark, tmp_path):
    """The registered query over a small table on disk: labels moved, ties, and what takes no part."""
    rows = clustered(5, 420, labels=10) + [(700, 3, None), (1001, None, [0.1] * 8)]
    table_of(spark, rows).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, (y + 1) % 10 if y is not None and i % 7 == 0 else y, v) for i, y, v in rows]
    assert sorted(tuple(r) for r in hn.op11_negatives(spark, str(tmp_path)).collect()) == brute(moved)
