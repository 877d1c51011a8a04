"""Properties: AUC invariances, partition independence, exact split sizes,
disjoint split, debias draws within their bands."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from equitext.operators import metrics as M
from equitext.operators import split as X
from equitext.plans import q_debias, q_profile
from equitext.sources import fixtures as fx


def _random_scores(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.random() < 0.3, round(rnd.random(), 2)) for _ in range(n)]  # many ties
    return spark.createDataFrame(rows, "toxic boolean, pred double")


def test_auc_monotone_invariant_and_complement(spark):
    df = _random_scores(spark)
    a = M.auc(df).first()["auc"]
    b = M.auc(df.withColumn("pred", F.exp(F.col("pred") * 3) - 7)).first()["auc"]
    c = M.auc(df.withColumn("pred", -F.col("pred"))).first()["auc"]
    assert abs(a - b) < 1e-12
    assert abs(a + c - 1) < 1e-12


def test_auc_matches_pairwise_bruteforce(spark):
    df = _random_scores(spark, 200, 9)
    rows = df.collect()
    pos = [r["pred"] for r in rows if r["toxic"]]
    neg = [r["pred"] for r in rows if not r["toxic"]]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(M.auc(df).first()["auc"] - brute) < 1e-12


def test_auc_independent_of_partitioning(spark):
    df = _random_scores(spark, 500, 5)
    a = M.auc(df.repartition(1)).first()["auc"]
    b = M.auc(df.repartition(7)).first()["auc"]
    assert a == b


def test_bias_aucs_match_per_group_bruteforce(spark):
    df = q_profile.labelled(spark, SMALL).where("pred IS NOT NULL AND NOT isnan(pred)").select(
        "id", "toxic", "pred", "black").collect()
    got = {r["subgroup"]: r for r in M.bias_aucs(q_profile.labelled(spark, SMALL), ["black"]).collect()}["black"]

    def auc(pos, neg):
        return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))

    sub = [r for r in df if r["black"] is not None and r["black"] > 0.5]
    bg = [r for r in df if r["black"] is not None and r["black"] <= 0.5]
    sp = [r["pred"] for r in sub if r["toxic"]]
    sn = [r["pred"] for r in sub if not r["toxic"]]
    bp = [r["pred"] for r in bg if r["toxic"]]
    bn = [r["pred"] for r in bg if not r["toxic"]]
    assert abs(got["subgroup_auc"] - auc(sp, sn)) < 1e-12
    assert abs(got["bpsn_auc"] - auc(bp, sn)) < 1e-12
    assert abs(got["bnsp_auc"] - auc(sp, bn)) < 1e-12


def test_split_sizes_are_exact(spark):
    df = q_profile.labelled(spark, SMALL)
    g = X.group_split(df)
    sizes = g.groupBy("subgroup", "toxic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")
    ).collect()
    for r in sizes:
        assert r["t"] == math.ceil(0.3 * r["n"] - 1e-9), r


def test_exact_cut_takes_the_first_rows_of_each_stratum(spark):
    df = spark.range(5000).withColumn("s", (F.col("id") % 3).cast("string"))
    h = df.withColumn("h", X.hash_order("id", 666, F.col("s")))
    cuts = {r["s"]: r["_cut"] for r in X.exact_cut(h, ["s"], "h", X.share("_n", 0.25, up=True)).collect()}
    for s in "012":
        order = sorted(r["h"] for r in h.where(F.col("s") == s).select("h").collect())
        assert cuts[s] == order[-(-len(order) // 4) - 1]


def test_disjoint_split(spark):
    df = q_profile.labelled(spark, SMALL)
    s = X.balanced_split(df, allow_overlap=False)
    assert s.groupBy("id").count().where("count > 1").count() == 0


def test_debias_draws_meet_their_bands(spark):
    df, wv, model, dirs, k = q_debias.setup(spark, MEDIUM)
    w = {r["token"]: r for r in q_debias.m07_debias_search(spark, MEDIUM).collect()}
    vecs = {r["token"]: np.array(r["vec"]) for r in wv.where(F.col("token").isin(list(w))).collect()}
    P, U, wt = np.array(dirs.pleasant), np.array(dirs.unpleasant), np.array(model.weights)
    assert w
    for tok, r in w.items():
        v = vecs[tok]
        if r["add_pleasent"] is not None:
            cand = v - r["sub_unpleasent"] * U + r["add_pleasent"] * P
            lo, hi = 0.5, 0.9
        else:
            cand = v + r["add_unpleasent"] * U - r["sub_pleasent"] * P
            lo, hi = 0.0, 0.3
        p = 1 / (1 + math.exp(-(cand @ wt + model.bias)))
        cos = cand @ v / (np.linalg.norm(cand) * np.linalg.norm(v))
        assert lo <= p <= hi and cos >= 0.8 - 1e-12, (tok, p, cos)
        assert abs(p - r["p_new"]) < 1e-9


def test_results_independent_of_shuffle_partitions(spark):
    from equitext.operators import debias as D

    def run():
        df = q_profile.labelled(spark, SMALL)
        split = sorted(tuple(r) for r in X.balanced_split(df).collect())
        bias = sorted((r["subgroup"], r["subgroup_auc"], r["bpsn_auc"]) for r in M.bias_aucs(df).collect())
        _, wv, model, dirs, k = q_debias.setup(spark, SMALL)
        w = sorted(tuple(r) for r in D.search_weights(q_debias.search_tokens(df, wv), wv, model, dirs,
                                                       bound_rows=k).collect())
        return split, bias, w

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = run()
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
