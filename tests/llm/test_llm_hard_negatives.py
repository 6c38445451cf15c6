"""Hard negatives against a scan of all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulmark.llm import hard_negatives
from haulmark.llm.hard_negatives import LEAF, Search, Tree, bounds, boxes, mine, packed, products, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, query long, window long, slab int, score string"


def brute(rows, k=5):
    kept = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, label, *_ in rows
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)
    ]

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in kept if i % 10 == 0}:
        scored = sorted((-dot(v, w), j, lab) for j, lab, w in kept if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            inside = [s for s in scored if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, "s") for r in rows], SCHEMA).repartition(3)
    got = mine(rows_of(df, "vec_id", F.col("label"), F.col("embedding")), F.col("vec_id") % 10 == 0)
    return sorted(map(tuple, got.collect()))


def cloud(n, dims=6, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    label = rng.choice(labels, n, p=[0.5, *[0.5 / (labels - 1)] * (labels - 1)])
    points = np.round(centres[label] + rng.normal(size=(n, dims)), 2)
    return [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(points, label, strict=True))]


@pytest.mark.parametrize("page", [8192, 50])
def test_negatives_equal_a_scan(spark, monkeypatch, page):
    monkeypatch.setattr(hard_negatives, "PAGE", page)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "SLAB_PAGES", 1)
    monkeypatch.setattr(hard_negatives, "SEEDED", 3)
    monkeypatch.setattr(hard_negatives, "CHUNK", 20)
    rows = cloud(600)
    want = brute(rows)
    assert len(want) > 200
    assert mined(spark, rows) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(80, dims=3, seed=2)
    rows += [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [nan, 1.0, 1.0], 1), (103, [inf, 1.0, 1.0], 2), (110, [1.0, 1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (120, [], 1), (130, [2.0], 2), (140, [1.0, 2.0, 3.0, 4.0], 0), (150, [0.0, 0.0, 0.0], 3)]
    rows += [(200 + i, [1.0, 1.0, 1.0], i % 2) for i in range(30)]  # ties
    rows += [(300 + i, rows[5][1], 9) for i in range(12)] + [(20, [1.0, 0.5, 0.5], 0), (21, [1.0, 0.5, 0.5], 0)]
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows(spark):
    rows = [(10, [1.0, 2.0], 0)] * 3 + [(1, [1.0, 2.0], 0)] * 2 + [(2, [1.0, 1.9], 1)] * 2 + [(3, [-1.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows)


def test_nothing_to_find(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 1), (11, [1.0], 1)]) == []


def test_scores_beyond_a_long_are_an_error():
    huge = np.array([[1 << 40]])
    with pytest.raises(ValueError, match="does not fit"):
        products(huge, huge)
    assert products(np.array([[1 << 30]]), np.array([[1 << 25]])).item() == 1 << 55


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-50, 50, (300, 8)), rng.integers(150, 250, (300, 8))])
    vectors = vectors[packed(vectors)]
    asked = rng.integers(-100, 100, (5, 8))
    below, above = bounds(asked, boxes(vectors, vectors, LEAF))
    scores = asked @ vectors.T
    for i in range(below.shape[1]):
        inside = scores[:, i * LEAF : (i + 1) * LEAF]
        assert (below[:, i] <= inside.min(1)).all() and (inside.max(1) <= above[:, i]).all()
    tree, seen = Tree(np.arange(600), vectors), []
    search = Search(np.full((1, 8), 5), np.zeros(1, int), np.array([-1]), np.array([-(1 << 62)]), np.array([1 << 62]), 5)
    leaf = search._leaf
    search._leaf = lambda *a: (seen.append(a[1]), leaf(*a))
    search.scan(tree, np.array([0]))
    assert 0 < len(seen) < below.shape[1]
    order = np.lexsort((np.arange(600), -(vectors.sum(1) * 5)))[:5]
    assert search.found[0].tolist() == order.tolist()


def test_packing_keeps_every_row():
    rng = np.random.default_rng(4)
    for n, dims in ((0, 3), (1, 0), (5, 2), (1000, 4), (777, 1)):
        assert sorted(packed(rng.integers(0, 9, (n, dims)), 16).tolist()) == list(range(n))
