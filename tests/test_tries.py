"""Tries per document and carried weights against a walk in plain Python, and
debiased features against token vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from equitext.functions.text import word_tokens
from equitext.operators import debias as D
from equitext.operators import tries as Tr
from equitext.operators.profile import any_group
from equitext.plans import q_debias, q_tries
from equitext.sources import fixtures as fx


@pytest.fixture(scope="module")
def searched(spark):
    docs, table, model, k = q_tries._searched(spark, MEDIUM)
    rows = {r["token"]: r for r in table.collect()}
    texts = {r["id"]: r["t"] for r in docs.select("id", word_tokens("comment_text").alias("t")).collect()}
    return docs, table, model, k, rows, texts


def _p(units, n, bias):
    z = sum(units) / 1e12 / n if n else bias
    return 1 / (1 + math.exp(-z))


def test_best_try_is_the_first_of_the_best(searched):
    docs, table, model, k, rows, texts = searched
    got = {r["id"]: r for r in Tr.best_try(docs, table, model.bias, bound_rows=k).collect()}
    assert set(got) == set(texts)
    for i, tokens in texts.items():
        known = [rows[t] for t in tokens if t in rows]
        ps = [_p([r["units"][t] for r in known], len(known), model.bias) for t in range(Tr.TRIES)]
        assert got[i]["best_try"] == ps.index(max(ps)) + 1
        assert got[i]["pred"] == pytest.approx(max(ps), abs=1e-12) and got[i]["n_known"] == len(known)
    # the best draw of every single token is another choice than the best try
    assert any(abs(r["pred"] - r["pred_token_best"]) > 1e-4 for r in got.values())


def test_draws_of_a_try_are_its_own(searched):
    rows = searched[4]
    some = [r for r in rows.values() if r["tries"] is not None]
    assert some and any(t is None for r in some for t in r["tries"])
    per = D.SearchParams().draws // Tr.TRIES
    for r in some:
        for t, best in enumerate(r["tries"]):
            assert best is None or t * per < -best["nd"] <= (t + 1) * per


def test_carried_weights_equal_the_walk_in_order(searched):
    docs, table, model, k, rows, texts = searched
    held: dict[str, tuple[int, int]] = {}
    for i in sorted(texts):
        known = [rows[t] for t in texts[i] if t in rows]
        if not known:
            continue
        ps = [_p([r["units"][held[r["token"]][1] if r["token"] in held else t] for r in known], len(known), model.bias)
              for t in range(Tr.TRIES)]
        best = ps.index(max(ps))
        for r in known:
            if r["token"] not in held and r["tries"] is not None and r["tries"][best] is not None:
                held[r["token"]] = (i, best)
    got = Tr.carried_weights(docs, table, model.bias, bound_rows=k).collect()
    assert {r["token"]: (r["writer"], r["best_try"] - 1) for r in got} == held
    # some writer's choice depends on what an earlier document wrote
    alone = Tr.try_weights(docs, Tr.best_try(docs, table, model.bias, bound_rows=k), table, bound_rows=k)
    first = {}
    for r in alone.orderBy("id").collect():
        first.setdefault(r["token"], (r["id"], r["best_try"] - 1))
    assert first != held


def test_no_documents_no_tokens(searched, spark):
    docs, table, model, k, _, _ = searched
    assert Tr.best_try(docs.limit(0), table, model.bias).count() == 0
    assert Tr.carried_weights(docs.limit(0), table, model.bias).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "qqqq zzzz")], "id long, comment_text string")
    got = Tr.best_try(blank, table, model.bias).orderBy("id").collect()
    assert [(r["id"], r["n_known"], r["best_try"]) for r in got] == [(1, 0, 1), (2, 0, 1), (3, 0, 1)]
    assert got[0]["pred"] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert Tr.carried_weights(blank, table, model.bias).count() == 0


def test_debiased_features_equal_token_arithmetic(spark):
    df, wv, model, dirs, k = q_debias.setup(spark, SMALL)
    vec = {r["token"]: np.array(r["vec"]) for r in wv.collect()}
    weights = {r["token"]: r for r in fx.fixture_weights(wv).collect()}
    scope = F.col("toxic") & any_group()
    got = {r["id"]: np.array(r["vec"]) for r in D.debiased_features(df, wv, fx.fixture_weights(wv), dirs, scope, bound_rows=k).collect()}
    P, U = np.array(dirs.pleasant), np.array(dirs.unpleasant)
    moved = 0
    for d in df.select("id", scope.alias("s"), word_tokens("comment_text").alias("t")).collect():
        x, n = np.zeros(len(P)), 0
        for t in d["t"]:
            if t not in vec:
                continue
            v, w = vec[t], weights.get(t)
            if d["s"] and w is not None:
                moved += 1
                if w["add_pleasent"] is not None and w["sub_unpleasent"] is not None:
                    v = v + w["add_pleasent"] * P - w["sub_unpleasent"] * U
                if w["sub_pleasent"] is not None and w["add_unpleasent"] is not None:
                    v = v - w["sub_pleasent"] * P + w["add_unpleasent"] * U
            x, n = x + v, n + 1
        assert np.allclose(got[d["id"]], x / n if n else x, atol=1e-12)
    assert moved


def test_features_sum_two_scalars_and_no_vector_per_occurrence(spark):
    df, wv, model, dirs, k = q_debias.setup(spark, SMALL)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        f = D.debiased_features(df, wv, fx.fixture_weights(wv), dirs, F.col("toxic"), bound_rows=k)
        plan = f._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    final = max((line for line in plan.splitlines() if "Aggregate [" in line), key=lambda line: line.count("sum("))
    # one sum per dimension, and alpha, beta and the known tokens beside them
    assert len(dirs.pleasant) + 3 <= final.count("sum(") < 2 * len(dirs.pleasant) and "Python" not in plan
