"""Debias weight application against direct vector arithmetic, and the
acceptance rules of the gated and narrow searches."""

import math

import numpy as np
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from equitext.functions.text import word_tokens
from equitext.operators import debias as D
from equitext.plans import q_debias
from equitext.sources import fixtures as fx


def _vectors(wv):
    return {r["token"]: np.array(r["vec"]) for r in wv.collect()}


def test_weighted_scores_equal_vector_arithmetic(spark):
    df, wv, model, dirs, k = q_debias.setup(spark, SMALL)
    weights = {r["token"]: r for r in fx.fixture_weights(wv).collect()}
    got = {r["id"]: r["pred"] for r in q_debias.apply_weights(spark, SMALL, "all").collect()}
    vec = _vectors(wv)
    P, U, w = np.array(dirs.pleasant), np.array(dirs.unpleasant), np.array(model.weights)
    docs = df.select("id", word_tokens("comment_text").alias("t")).limit(40).collect()
    used_partial = 0
    for d in docs:
        acc, n = np.zeros(len(w)), 0
        for t in d["t"]:
            if t not in vec:
                continue
            v = vec[t].copy()
            wt = weights.get(t)
            if wt is not None:
                if wt["add_pleasent"] is not None and wt["sub_unpleasent"] is not None:
                    v = v + wt["add_pleasent"] * P - wt["sub_unpleasent"] * U
                    used_partial += 1
                if wt["sub_pleasent"] is not None and wt["add_unpleasent"] is not None:
                    v = v - wt["sub_pleasent"] * P + wt["add_unpleasent"] * U
                    used_partial += 1
            acc += v
            n += 1
        x = acc / n if n else acc
        p = 1 / (1 + math.exp(-(x @ w + model.bias)))
        assert abs(p - got[d["id"]]) < 1e-9, d["id"]
    assert used_partial > 0


def test_narrow_search_bands(spark):
    df, wv, model, dirs, k = q_debias.setup(spark, MEDIUM)
    res = q_debias.m09_debias_search_narrow(spark, MEDIUM).collect()
    assert res
    for r in res:
        if r["add_pleasent"] is not None:
            assert 0.6 < r["p_new"] < 0.8 and r["p_base"] >= 0.9
        else:
            assert 1e-5 < r["p_new"] <= 0.3 and r["p_new"] > r["p_base"] and r["p_base"] < 0.1


def test_gated_search_applies_toxic_rule_only_to_similar_tokens(spark):
    df, wv, model, dirs, k = q_debias.setup(spark, MEDIUM)
    anchors = [list(r["vec"]) for r in fx.word_list(wv, "identity").orderBy("k").select("vec").collect()]
    sim = {r["token"] for r in D.similar_tokens(wv, anchors, q_debias.GATE_THRESHOLD).collect()}
    res = q_debias.m08_debias_search_gated(spark, MEDIUM).collect()
    toxic_rule = [r["token"] for r in res if r["add_pleasent"] is not None]
    assert all(t in sim for t in toxic_rule)
    ungated = {r["token"] for r in q_debias.m07_debias_search(spark, MEDIUM).collect()
               if r["add_pleasent"] is not None}
    assert set(toxic_rule) <= ungated
