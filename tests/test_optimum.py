"""The optimum check must tell a fit from a model that is none, skewed lookups
must be even, and file marks must read no rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM
from equitext import session
from equitext.operators import joins as J
from equitext.operators import model as Mo
from equitext.operators import sgd as S
from equitext.plans import q_model
from equitext.sources.fixtures import LinearModel


@pytest.fixture(scope="module")
def toxicity(spark):
    from equitext.operators import split as X
    from equitext.plans.q_split import _split

    df, split = _split(spark, MEDIUM)
    return q_model._train_features(spark, MEDIUM, X.split_rows(df, split, "train"))


def _intercept_only(features):
    r = features.agg(F.avg("label").alias("p")).first()["p"]
    return LinearModel((0.0,) * 64, math.log(r / (1 - r)))


@pytest.mark.parametrize("which", ["toxicity", "nongroup", "group"])
def test_only_a_finished_fit_is_at_its_optimum(spark, toxicity, which):
    features = {"toxicity": lambda: toxicity, "nongroup": lambda: q_model._nongroup_features(spark, MEDIUM),
                "group": lambda: q_model._group_features(spark, MEDIUM)}[which]()
    fitted = Mo.train_logistic(features)
    check = lambda m: Mo.optimum_check(features, m).first()["at_optimum"]
    assert check(fitted)
    assert not check(_intercept_only(features))
    assert not check(Mo.train_logistic(features, max_iter=5, gap=None))
    assert not check(LinearModel(fitted.weights, fitted.bias + 0.01))
    nudged = [*fitted.weights]
    nudged[3] += 0.05
    assert not check(LinearModel(tuple(nudged), fitted.bias))


def test_curvature_equals_plain_arithmetic(spark):
    r = random.Random(2)
    rows = [([r.gauss(0, 1) for _ in range(3)], int(r.random() < 0.3)) for _ in range(50)]
    df = spark.createDataFrame(rows, "vec array<double>, label int").repartition(7)
    m = LinearModel((0.3, -0.2, 0.5), 0.1)
    x = np.hstack([np.array([v for v, _ in rows]), np.ones((50, 1))])
    y, c = np.array([k for _, k in rows]), np.array([*m.weights, m.bias])
    p = 1 / (1 + np.exp(-x @ c))
    pen = np.array([0.01] * 3 + [0])
    got = Mo.curvature(df, m, reg=0.01)
    assert (got.n, got.n_pos) == (50, y.sum())
    assert got.loss == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + (pen * c * c).sum() / 2)
    assert np.allclose(got.slope, x.T @ (p - y) / 50 + pen * c)
    assert np.allclose(got.second, (x * (p * (1 - p))[:, None]).T @ x / 50 + np.diag(pen))
    assert Mo.curvature(df.limit(0), m).n == 0 and not Mo.optimum_check(df.limit(0), m).first()["at_optimum"]


def test_cross_validation_equals_folds_one_by_one(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    folds = {x["id"]: x["fold"] for x in Mo.stratified_folds(df, 3).collect()}
    for loss in ("log", "hinge"):
        got = {x["fold"]: x for x in S.cross_validate(df, 3, loss, t0=1e5).collect()}
        assert set(got) == {1, 2, 3}
        for k in got:
            train = df.where(~F.col("id").isin([i for i, f in folds.items() if f == k]))
            m = S.sgd_fit(train, LinearModel((0.0,) * 4, 0.0), loss=loss, t0=1e5)
            test = [(np.dot(m.weights, v) + m.bias > 0, y == 1) for i, v, y in rows if folds[i] == k]
            tp = sum(p and y for p, y in test)
            assert got[k]["accuracy"] == pytest.approx(np.mean([p == y for p, y in test]))
            wrong = sum(p != y for p, y in test)
            assert got[k]["f1"] == pytest.approx(2 * tp / (2 * tp + wrong)) if tp + wrong else got[k]["f1"] is None
    assert S.cross_validate(df.limit(0), 3).count() == 0


def test_heavy_keys_are_broadcast_and_the_rest_is_even(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    r = random.Random(5)
    tokens = [f"t{min(int(r.paretovariate(0.7)), 3000)}" for _ in range(40_000)] + [None] * 50
    big = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id long, token string").repartition(6)
    small = spark.createDataFrame([(f"t{i}", float(i)) for i in range(1, 2900)], "token string, x double")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("left", "inner"):
            got = J.lookup_join(big, small, "token", how, bound_rows=2900, heavy_share=2e-3)
            want = big.join(small, "token", how)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        # what is shuffled lies evenly: no partition has twice the median
        heavy = [k for k in big.select("token").freqItems(["token"], 2e-3).first()[0] if k]
        assert 0 < len(heavy) <= 500
        rest = big.where(~F.col("token").isin(heavy)).join(small, "token")
        sizes = sorted(x["count"] for x in rest.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        uneven = sorted(x["count"] for x in big.join(small, "token").groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert uneven[-1] > 2 * uneven[len(uneven) // 2]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_file_marks_follow_the_files_and_read_no_rows(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    first = session.file_mark(spark, path)
    assert session.file_mark(spark, path) == first
    spark.range(5).write.mode("append").parquet(path)
    assert session.file_mark(spark, path) != first
    one = f"{MEDIUM}/labels.parquet"
    assert session.file_mark(spark, one).endswith(":1")


def test_sparse_optimum_reads_given_features_only(spark):
    from pyspark.ml.linalg import Vectors

    r = random.Random(9)
    rows = []
    for i in range(300):
        on = sorted(r.sample(range(40), r.randint(0, 8)))
        y = int(r.random() < (0.7 if 3 in on else 0.2))
        v = Vectors.sparse(40, on, [1.0 + (j % 2) for j in on]) if i % 3 else Vectors.dense([1.0 + (j % 2) if j in on else 0.0 for j in range(40)])
        rows.append((v, y, on))
    df = spark.createDataFrame([(v, y) for v, y, _ in rows], ["features", "label"])
    got = df.select(Mo.sparse_items().alias("x")).collect()
    for (_, _, on), g in zip(rows, got):
        assert [(x["index"], x["value"]) for x in g["x"] if x["value"]] == [(j, 1.0 + (j % 2)) for j in on]
    check = lambda n, tol: Mo.sparse_optimum_check(df, Mo.train_sparse(df, max_iter=n), tolerance=tol).first()
    full = check(300, 1e-3)
    assert (full["n_rows"], full["n_features"], full["at_optimum"]) == (300, 40, True)
    assert not check(1, 1e-3)["at_optimum"]
