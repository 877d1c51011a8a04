"""Plan shapes and the large-data code paths, exercised on small inputs."""

import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from equitext.constants import GROUPS, WEIGHT_COLUMNS
from equitext.functions.text import word_tokens
from equitext.operators import debias as D
from equitext.operators import embed as E
from equitext.operators import joins as J
from equitext.operators import metrics as M
from equitext.operators import model as Mo
from equitext.operators import split as X
from equitext.plans import q_profile
from equitext.sources import fixtures as fx
from equitext.sources import tables as T


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sums_do_not_depend_on_buckets(spark):
    import random

    rnd = random.Random(11)
    rows = [(rnd.random() < 0.4, round(rnd.random(), 3), f"k{rnd.randint(0, 2)}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "toxic boolean, pred double, key string")
    counts = M.score_counts(df, ["key"])
    got = [
        sorted(tuple(r) for r in M.prefix_sums_below(counts, ["key"], "score", ["neg"], n).select(
            "key", "score", "pos", "neg", "neg_below").collect())
        for n in (7, 512, M.BUCKET_ROWS)
    ]
    assert got[0] == got[1] == got[2]


def test_bias_summary_equals_separate_metrics(spark):
    lab = q_profile.labelled(spark, SMALL)
    one = {r["scope"]: r for r in M.bias_summary(lab).collect()}
    overall = M.auc(lab).first()
    assert abs(one["overall"]["auc"] - overall["auc"]) < 1e-12
    for g in ("black", "white", "male"):
        inside, outside, y = F.col(g) > 0.5, F.col(g) <= 0.5, F.col("toxic")
        for name, rows in (("auc", inside), ("bpsn_auc", (outside & y) | (inside & ~y)), ("bnsp_auc", (inside & y) | (outside & ~y))):
            assert abs(one[g][name] - M.auc(lab.where(rows)).first()["auc"]) < 1e-12
    cut = {r["scope"]: r for r in M.bias_summary(lab, bucket_rows=5).collect()}
    for scope, r in one.items():  # the same through buckets of five scores
        assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(r[1:], cut[scope][1:]))
    assert one["overall"]["fp"] > 0 and one["overall"]["fn"] > 0  # the fixture errs on both sides
    for r in M.subgroup_confusion(lab).collect():
        assert [one[r["subgroup"]][c] for c in ("tp", "fp", "fn", "tn")] == [r[c] for c in ("tp", "fp", "fn", "tn")]


def test_same_aucs_under_any_number_of_partitions(spark):
    lab = q_profile.labelled(spark, SMALL).select("id", "toxic", "pred", *GROUPS)
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (3, 300):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            near_unique = lab.withColumn("pred", F.col("pred") + F.col("id") / 1e9).repartition(parts)
            seen.add(tuple(sorted(tuple(r) for r in M.bias_aucs(near_unique).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_bias_report_copies_no_row_per_group(spark):
    plan = _plan(M.bias_summary(q_profile.labelled(spark, SMALL)))
    assert "FileScan" in plan and "documents" not in plan  # reads the written score table only


def test_split_ranks_the_boundary_bucket_only(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7 == 0).alias("toxic"))
    h = df.withColumn("_h", X.hash_order("id", 1, "s")).withColumn("_s", F.lit("s"))
    kept = X.keep_first(df, 0.333, "s", seed=1)
    assert kept.count() == 1665
    first = {r["id"] for r in h.orderBy("_h").limit(1665).select("id").collect()}
    assert {r["id"] for r in kept.select("id").collect()} == first
    for fraction, want in ((0.0, 0), (1.0, 5000), (0.25, 1250), (0.0001, 0)):
        assert X.keep_first(df, fraction, "s").count() == want


def test_lookup_join_broadcasts_only_behind_a_bound(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 10)
    small = spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in _plan(J.lookup_join(big, small, "k", bound_rows=10))
        assert "BroadcastHashJoin" not in _plan(J.lookup_join(big, small, "k"))
        assert "BroadcastHashJoin" not in _plan(J.lookup_join(big, small, "k", bound_rows=10 ** 9))
        # width counts: wide rows of the same number stay out, unknown widths too
        wide = small.withColumn("vec", F.array(F.lit(0.0)))
        assert "BroadcastHashJoin" in _plan(J.lookup_join(big, wide, "k", bound_rows=10_000, dim=64))
        assert "BroadcastHashJoin" not in _plan(J.lookup_join(big, wide, "k", bound_rows=1_000_000, dim=200))
        assert "BroadcastHashJoin" not in _plan(J.lookup_join(big, wide, "k", bound_rows=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_scan_prunes_partition_and_columns(spark):
    path = tempfile.mkdtemp(prefix="equitext-split-")
    df = spark.range(100).select(
        F.col("id"), (F.col("id") % 3 == 0).alias("toxic"),
        F.when(F.col("id") % 10 < 3, "test").otherwise("train").alias("split"),
    )
    df.write.mode("overwrite").partitionBy("split").parquet(path + "/t")
    got = T.read_split(spark, path + "/t", "test", ["id"])
    plan = _plan(got)
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert got.count() == 30


def test_scoring_is_one_pass(spark):
    c = fx.comments(spark, SMALL)
    wv = fx.word_vectors(spark, SMALL)
    k, dim = fx.embedding_shape(spark, SMALL)
    s = Mo.score_docs(c, Mo.token_scores(wv, fx.fixture_model(dim)), -0.1, bound_rows=k)
    plan = _plan(s)
    assert "SortMergeJoin" not in plan
    assert "BroadcastHashJoin" in plan
    assert s.count() == c.count()


def test_group_prevalence_is_one_aggregate(spark):
    plan = _plan(q_profile.a02_group_prevalence(spark, SMALL))
    assert plan.count("HashAggregate") <= 2 and "Window" not in plan


def _vector_docs(spark):
    """Rows with repeated and null ids, blank texts and words without a vector."""
    texts = ["alpha beta alpha 2nd gamma_x", "beta delta delta", None, "", "zzz qq", "alpha", "gamma_x beta beta epsilon alpha"]
    rows = [(i % 40 if i % 11 else None, texts[i % 7], i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, comment_text string, s boolean")
    words = ["alpha", "beta", "gamma_x", "delta", "epsilon", "omega"]
    wv = spark.createDataFrame([(w, [float(k + 1), k * 0.5 - 1, -float(k)]) for k, w in enumerate(words)], "token string, vec array<double>")
    idf = spark.createDataFrame([("alpha", 1.5), ("beta", 2.0), ("gamma_x", 0.25), ("nd", 9.0)], "token string, idf double")
    return docs, wv, idf


def _vector_tables(docs, wv, idf):
    weights = wv.sparkSession.createDataFrame([("alpha", 0.5, 0.25, None, None), ("delta", None, None, 0.1, 0.2)],
                                              "token string, " + ", ".join(f"{c} double" for c in WEIGHT_COLUMNS))
    dirs = D.Directions((1.0, 2.0, 3.0), (0.5, -1.0, 0.0))
    return [E.doc_vectors(docs, wv, "mean", dim=3, bound_rows=6), E.doc_vectors(docs, wv, "sum", dim=3, bound_rows=6),
            E.tfidf_doc_vectors(docs, wv, idf, dim=3, bound_rows=6),
            D.debiased_features(docs, wv, weights, dirs, F.col("s"), bound_rows=6).select("id", "n_known", "vec")]


def test_document_vectors_above_the_broadcast_limit_are_the_same(spark, monkeypatch):
    given = _vector_docs(spark)

    def rows(t):
        return {r["id"]: (r["n_known"], [round(x, 9) for x in r["vec"]]) for r in t.collect()}

    want = [rows(t) for t in _vector_tables(*given)]
    assert all(len(w) == 41 for w in want) and want[0][5][0] > 0
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    for part, block in ((1 << 28, 1 << 26), (200, 100)):
        monkeypatch.setattr(E, "PART_BYTES", part)
        monkeypatch.setattr(E, "BLOCK_TOKENS", block)
        assert [rows(t) for t in _vector_tables(*given)] == want


def test_routed_sums_write_no_tokens_and_copy_vectors_with_the_text_only(spark, monkeypatch):
    docs, wv, _ = _vector_docs(spark)

    def rows(t):
        return {r["id"]: (r["n_known"], [round(x, 9) for x in r["vec"]]) for r in t.collect()}

    want = rows(E.doc_vectors(docs, wv, "sum", dim=3, bound_rows=6))
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(E, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(E, "materialize", lambda *_: pytest.fail("tokens are written"))
    for part in (6 * 96, 6 * 96 // 3):  # one part of the vocabulary, and three
        monkeypatch.setattr(E, "PART_BYTES", part)
        got = E.doc_vectors(docs, wv, "sum", dim=3, bound_rows=6, chars=lambda: 6 * 1200)
        assert rows(got) == want
        # 12 blocks for one part, 4 for three: 12 tasks with one cell each
        assert set(re.findall(r"direct_shuffle_partition_id\(cell#\d+\), (\d+)\)", _plan(got))) == {"12"}


def test_no_document_vector_is_shuffled_per_token(spark):
    docs, wv, idf = _vector_docs(spark)
    for t in _vector_tables(docs, wv, idf):
        plan = _plan(t.select("id", "vec"))
        # tokens are not dealt out: they are counted where their text is
        assert not re.search(r"hashpartitioning\(id#[^)]*token", plan)


def test_exact_sums_use_no_decimal_per_row(spark):
    values = [0.1, -0.1, 2.5e-12, -7.25, 1e6 + 1 / 3, 0.4999999999995, None]
    units = [int(v * 1e12) if v is not None else None for v in values]
    big = spark.createDataFrame([(v, u) for v, u in zip(values, units)] * 50, "s double, u bigint")
    got = big.agg(Mo.exact_sum("s").alias("s"), Mo.wide_sum(F.col("u")).alias("u"))
    r = got.first()
    assert r["u"] == 50 * sum(u for u in units if u is not None)
    assert abs(r["s"] - 50 * sum(v for v in values if v is not None)) < 1e-6
    partial = [line for line in _plan(got).splitlines() if "partial_sum" in line]
    assert partial and not any("round(" in line or "decimal" in line for line in partial)


def test_gradient_shuffles_no_token_list_and_counts_repeated_vectors(spark, monkeypatch):
    docs, wv, _ = _vector_docs(spark)
    docs = docs.withColumn("label", F.col("s"))
    twice = wv.unionByName(wv.where("token = 'alpha'"))  # a vector that is listed twice counts as a join counts it
    model = fx.LinearModel((0.5, -0.25, 0.125), 0.1)
    vecs = {}
    for r in twice.collect():
        vecs.setdefault(r["token"], []).append(np.array(r["vec"]))
    groups = {}
    for r in docs.select("id", "label", word_tokens("comment_text").alias("t")).collect():
        groups.setdefault((r["id"], r["label"]), []).extend(r["t"])
    g, bias = np.zeros(3), 0.0
    for (_, y), tokens in groups.items():
        known = [v for t in tokens for v in vecs.get(t, [])]
        x = np.mean(known, axis=0) if known else np.zeros(3)
        r = 1 / (1 + np.exp(-(x @ model.weights + model.bias))) - y
        bias += r
        for t in tokens:
            for _ in vecs.get(t, []):
                g += r / len(known) * np.sum(vecs[t], axis=0)
    w, n = np.array(model.weights), len(groups)
    want = [*(w - 0.1 * (g / n + Mo.L2 * w)), model.bias - 0.1 * bias / n]
    write, written = Mo.materialize, []
    monkeypatch.setattr(Mo, "materialize", lambda df, name: written.extend(df.dtypes) or write(df, name))
    for limit in (J.BROADCAST_BYTES, 0):
        monkeypatch.setattr(J, "BROADCAST_BYTES", limit)
        step = Mo.gradient_step(docs, twice, model, bound_rows=7)
        got = Mo.model_from_table(step)
        assert np.allclose([*got.weights, got.bias], want, atol=1e-9)
    assert written and not any(kind.startswith("array") for _, kind in written)
