"""Row-order SGD against a plain loop, scoring with several models at once."""

import hashlib
import math
import random

import numpy as np
import pytest

from conftest import SMALL
from equitext.operators import model as Mo
from equitext.operators import sgd as S
from equitext.plans import q_model
from equitext.sources.fixtures import LinearModel, fixture_model


def _rows(n=200, dim=5):
    r = random.Random(4)
    return [(i, [r.gauss(0, 1) for _ in range(dim)], int(r.random() < 0.4)) for i in range(n)] + [(7, [1.0] * dim, 1)] * 3


def brute(rows, start, epochs, shards, alpha=1e-4, seed=17, t0=S.T0):
    def md5(i, what):
        return hashlib.md5(f"{i}:{seed}:{what}".encode()).hexdigest()

    dealt = {}
    for i, x, y in rows:
        dealt.setdefault(int(int(md5(i, "shard")[:8], 16) / 2**32 * shards), []).append((md5(i, "sgd"), i, x, y))
    w, b, seen = np.array(start.weights), start.bias, 0
    for _ in range(epochs):
        ends = []
        for own in dealt.values():
            v, c = w.copy(), b
            for k, (_, _, x, y) in enumerate(sorted(own, key=lambda r: (*r[:2], r[3], r[2]))):
                eta = 1 / (alpha * (t0 + seen // shards + k))
                g = 1 / (1 + math.exp(-(v @ np.array(x) + c))) - y
                v, c = v * (1 - eta * alpha) - eta * g * np.array(x), c - eta * g
            ends.append((len(own), v, c))
        n = sum(e[0] for e in ends)
        w, b = sum(e[0] * e[1] for e in ends) / n, sum(e[0] * e[2] for e in ends) / n
        seen += n
    return w, b


@pytest.mark.parametrize("shards, parts, t0", [(1, 1, S.T0), (4, 3, S.T0), (4, 17, 1e6)])
def test_fit_equals_a_plain_loop_under_any_partitioning(spark, shards, parts, t0):
    rows = _rows()
    start = LinearModel((0.1, 0.0, -0.2, 0.0, 0.0), 0.3)
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int").repartition(parts)
    m = S.sgd_fit(df, start, epochs=3, shards=shards, t0=t0)
    w, b = brute(rows, start, 3, shards, t0=t0)
    assert np.allclose(m.weights, w, atol=1e-8) and m.bias == pytest.approx(b, abs=1e-8)


def test_no_rows_leave_the_start(spark):
    start = LinearModel((1.0, 2.0), 3.0)
    assert S.sgd_fit(spark.createDataFrame([], "id long, vec array<double>, label int"), start) == start


def test_models_side_by_side_equal_one_by_one(spark):
    df, wv, k, dim, model = q_model._ctx(spark, SMALL)
    other = LinearModel(tuple(-w / 2 for w in model.weights), 0.7)
    both = {r["id"]: r for r in S.score_models(df, wv, {"a": (model, "mean"), "b": (other, "sum")}, bound_rows=k).collect()}
    for name, m, how in (("a", model, "mean"), ("b", other, "sum")):
        one = Mo.score_docs(df, Mo.token_scores(wv, m), m.bias, how, bound_rows=k).collect()
        assert {r["id"]: r["pred"] for r in one} == {i: r[name] for i, r in both.items()}


def test_three_routes(spark):
    df = spark.createDataFrame([(1, 0.6, 0.2, 0.4, 0.9), (2, 0.5, 0.2, 0.4, 0.9)], "id long, g double, d double, f double, o double")
    got = S.route_three(df, "g", ["d", "f"], "o").orderBy("id").collect()
    assert [(r["route"], round(r["pred"], 9)) for r in got] == [("d+f", 0.3), ("o", 0.9)]


def test_fixture_model_has_its_dimension():
    assert fixture_model(64).dim == 64
