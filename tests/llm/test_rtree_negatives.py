import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equitext.llm import rtree_negatives

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=5):
    use = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((k, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = lambda c: (-c[0], c[1] is not None, c[1] or 0, c[2])
    out = []
    for k, i, label, v in use:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m, lab) for m, j, lab, w in use if m != k and len(w) == len(v)]
        for pos in sorted((c for c in scored if c[3] == label), key=order)[:positives]:
            bad = [c for c in scored if c[3] != label and 80 * pos[0] <= 100 * c[0] <= 100 * pos[0]]
            out += [(i, pos[1], rank, c[1], pos[0], c[0]) for rank, c in enumerate(sorted(bad, key=order)[:negatives], 1)]
    return sorted(out, key=repr)


def _rows(n, dim, seed):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0.05, 0.2) for _ in range(dim)], r.randrange(4)) for i in range(n)]
    hot = rows[0][1]
    rows += [(n + i, hot, r.randrange(4)) for i in range(n // 3)]  # copies of one vector
    rows += [(n * 2 + i, [0.0] * dim, i % 3) for i in range(12)]
    r.shuffle(rows)
    return rows + [
        (10, rows[3][1], 2), rows[7], rows[7],  # repeated ids and rows
        (None, rows[1][1], 1), (None, rows[2][1], 0),
        (20, None, 1), (30, rows[1][1], None), (40, [float("nan")] + rows[1][1][1:], 1),
        (50, [float("inf")] * dim, 1), (60, [None] * dim, 1),
        (70, [], 0), (71, [], 0), (72, [], 1), (80, rows[1][1][:-1], 0), (81, rows[1][1][:-1], 0), (82, rows[1][1][:-1], 1),
    ]


def _mine(spark, rows, **options):
    out = rtree_negatives.mine(spark.createDataFrame(rows, KIND), F.col("id") % 10 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("dim, tile, leaf, block", [(3, 16, 4, 9), (16, 4096, 8, 4096)])
def test_matches_brute_force(spark, dim, tile, leaf, block):
    rows = _rows(150, dim, seed=dim)
    assert _mine(spark, rows, tile=tile, leaf=leaf, block=block) == brute(rows)


def test_large_components_stay_exact(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1, 1]) * r.uniform(1e6, 9e6) for _ in range(4)], i % 2) for i in range(40)]
    assert _mine(spark, rows) == brute(rows)


def test_no_rows_no_anchors_extra_columns(spark):
    assert _mine(spark, []) == []
    assert _mine(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert _mine(spark, [(10, [1.0], 0), (2, [1.0], 1)]) == []  # no positive
    odd = spark.createDataFrame(
        [(10, [1.0], 0, 3, b"x"), (1, [1.0], 0, 4, b"y"), (2, [0.9], 1, 5, b"z")], KIND + ", row int, vec binary")
    out = rtree_negatives.mine(odd, F.col("id") % 10 == 0)
    assert [tuple(r) for r in out.collect()] == [(10, 1, 1, 2, 65536, 58880)]


def _tree(vec, leaf):
    n, dim = vec.shape
    order = rtree_negatives._leaves(vec, list(range(dim)), leaf)
    assert sorted(order) == list(range(n))
    vec = vec[order]
    return rtree_negatives.Tree({"n": n, "dim": dim, "vec": vec.tobytes(), "id": order.tolist(), "known": [True] * n,
                                 "label": [0] * n, "row": order.tolist()}, leaf), vec


def test_boxes_bound_every_score_and_pack_tightly():
    r = np.random.default_rng(2)
    tree, vec = _tree(np.floor(r.normal(0, 60, (500, 3))), 8)
    anchors = np.floor(r.normal(0, 60, (7, 3)))
    scores = anchors @ vec.T
    spans = [(np.arange(0, 500, 8 * rtree_negatives.FANOUT**k)) for k in range(len(tree.levels))]
    for (low, high), first in zip(tree.bounds(anchors, False), spans):
        for i, a in enumerate(first):
            b = first[i + 1] if i + 1 < len(first) else 500
            assert (low[:, i] <= scores[:, a:b].min(axis=1)).all() and (high[:, i] >= scores[:, a:b].max(axis=1)).all()
    box = (tree.levels[0][1] - tree.levels[0][0]).prod(axis=1).mean()
    shuffled = np.array([(vec[p].max(0) - vec[p].min(0)).prod() for p in np.array_split(r.permutation(500), 63)]).mean()
    assert box < shuffled / 5


def test_search_skips_boxes_in_low_dimensions():
    r = np.random.default_rng(3)
    tree, vec = _tree(np.floor(r.normal(0, 60, (4000, 2))), 16)
    anchors = np.array([[40.0, 25.0], [-3.0, 50.0]])
    every = lambda who, first, last: np.ones((len(who), last - first), bool)
    for window in ((None, None), (100, 130), (-5000, -4800)):
        asks = rtree_negatives.Asks([(0, *window, None), (1, *window, None)], 5)
        seen = rtree_negatives.search(tree, anchors, asks, every)
        low, high = (-np.inf if window[0] is None else window[0]), (np.inf if window[1] is None else window[1])
        for anchor, cells in zip(anchors, asks.cells):
            inside = sorted((int(s) for s in vec @ anchor if low <= s <= high), reverse=True)[:5]
            assert [c[0] for c in cells] == inside
        assert seen < 3000  # of 8,000


def test_floor_and_ties_are_kept():
    vec = np.array([[1.0], [2.0], [2.0], [2.0], [3.0]])
    tree, _ = _tree(vec, 2)
    every = lambda who, first, last: np.ones((len(who), last - first), bool)
    asks = rtree_negatives.Asks([(0, None, None, 2), (0, None, 2, None)], 2)
    rtree_negatives.search(tree, np.array([[1.0]]), asks, every)
    assert [(c[0], c[2]) for c in asks.cells[0]] == [(3, 4), (2, 1)]
    assert [(c[0], c[2]) for c in asks.cells[1]] == [(2, 1), (2, 2)]
