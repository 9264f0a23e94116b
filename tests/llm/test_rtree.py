"""Hard negatives against all pairs in plain Python, with ties, nulls, hot vectors and sums beyond 53 bits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.llm import rtree

SCHEMA = "vec_id long, embedding array<double>, label int, tree string, score string"


def plainly(rows, every=10, positives=5, negatives=10, low=30, high=90):
    given = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            given.setdefault((i, tuple(math.floor(256 * x) for x in v), label), []).append(1)
    every_row = [k for k, n in given.items() for _ in n]
    out = []
    for i, v, label in (k for k in given if k[0] % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in every_row if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and -low * s <= -100 * x[0] <= -high * s]
            out += [(i, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, **how):
    given = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    result = rtree.hard_negatives(given, F.col("id") % 10 == 0, F.col("label"), **how)
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in result.collect())


def vectors(seed, n, dim=6, scale=1.0, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    return [(i, [c + scale * r.gauss(0, 1) for c in r.choice(centres)], r.randrange(labels)) for i in range(n)]


def test_all_pairs(spark):
    rows = vectors(1, 300)
    expected = plainly(rows)
    assert len(expected) > 500
    for size in (4096, 60):  # one tree, and several
        assert found(spark, rows, tree=size) == expected


def test_odd_rows(spark):
    rows = vectors(2, 120)
    same = rows[7][1]
    rows += [(200 + i, same, i % 3) for i in range(150)]  # one vector in over half of all rows: all scores tie
    rows += [(20, rows[20][1], rows[20][2]), (30, [0.0] * 6, 1), (31, rows[31][1], rows[31][2])]  # a row twice, and one id for two
    rows += [(400, None, 1), (410, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (420, [math.nan] * 6, 1), (430, [math.inf] * 6, 1), (440, same, None), (None, same, 2)]
    rows += [(450, [0.0] * 6, 9), (460, [-x for x in same], 2), (470, same[:4], 1), (480, [], 0)]
    assert found(spark, rows, tree=64) == plainly(rows)


def test_sums_beyond_53_bits(spark):
    rows = [(i, [x * 2.0**18 for x in v], label) for i, v, label in vectors(3, 90, dim=5)]
    assert found(spark, rows) == plainly(rows)
    assert any(r[-1] > 2**53 for r in plainly(rows))


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(10, [1.0, 2.0], 1)]) == []
    assert found(spark, [(11, [1.0, 2.0], 1), (12, [1.0, 2.0], 2)]) == []


@pytest.mark.parametrize("n", [1, 2, 128, 129, 1000, 4096])
def test_boxes_hold_their_rows(n):
    r = np.random.default_rng(n)
    points = np.floor(r.normal(0, 50, (n, 8)))
    labels, ids = r.integers(0, 3, n), r.permutation(n)
    order = rtree.tiled(np.column_stack([labels, points]), leaf=32)
    assert sorted(order.tolist()) == list(range(n))
    tree = rtree.Tree(ids[order], labels[order], points[order], leaf=32, fanout=4)
    assert len(tree.levels[-1][0]) == 1
    size = 32
    for (low, high), spans, firsts in zip(tree.levels, tree.spans, tree.firsts):
        for j, at in enumerate(range(0, n, size)):
            part = slice(at, at + size)
            assert (tree.vectors[part] >= low[j]).all() and (tree.vectors[part] <= high[j]).all()
            assert spans[j] == (tree.labels[part].min(), tree.labels[part].max()) and firsts[j] == tree.ids[part].min()
        size *= 4


def test_far_boxes_are_not_opened():
    """Clusters far apart: the queue scores the rows of a few leaves only."""
    r = np.random.default_rng(5)
    points = np.concatenate([np.floor(r.normal(0, 2, (256, 2)) + [1000 * k, 0]) for k in range(16)])
    order = rtree.tiled(points, leaf=64)
    tree = rtree.Tree(np.arange(4096), np.zeros(4096, np.int64), points[order], leaf=64)
    scored = []

    class Counting(rtree.Asked):
        def add(self, scores, ids):
            scored.append(len(scores))
            super().add(scores, ids)

    anchor = np.array([1.0, 0.0])
    up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
    lows, highs = [(up @ a.T + down @ b.T).tolist() for a, b in tree.levels], [(up @ b.T + down @ a.T).tolist() for a, b in tree.levels]
    asked = Counting([rtree.Best(5)])
    rtree.search(tree, lows, highs, anchor, -1, 0, True, asked)
    assert [-s for s, _ in asked.windows[0].rows] == sorted(points[:, 0], reverse=True)[:5]
    assert sum(scored) <= 512
    scored.clear()
    window = Counting([rtree.Best(5, 2990, 3010)])
    rtree.search(tree, lows, highs, anchor, -1, 0, True, window)
    assert sum(scored) <= 512 and len(window.windows[0].rows) == 5
