"""Cases that once lost rows, hid errors or changed results silently."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from equitext import session
from equitext.operators import embed as E
from equitext.operators import metrics as M
from equitext.operators import model as Mo
from equitext.operators import profile as P
from equitext.operators import split as X
from equitext.sources import tables as T
from equitext.sources.fixtures import LinearModel
from equitext.streaming.incremental import latest_model


@pytest.mark.parametrize("fraction, want", [(0.25, 250), (0.333, 333), (0.3, 300), (0.001, 1)])
def test_split_fractions_are_exact(spark, fraction, want):
    df = spark.range(1000).select("id", F.lit("a").alias("g"))
    out = X.stratified_split(df, ["g"], F.col("g"), test_fraction=fraction)
    assert out.where("split = 'test'").count() == want and out.count() == 1000


def test_scores_of_long_documents_do_not_overflow(spark):
    df = spark.range(40).select(F.lit(1).alias("k"), (F.lit(1e6) + F.col("id") / 8).alias("s"))
    got = df.groupBy("k").agg(Mo.exact_sum("s").alias("z"), Mo.exact_mean("s").alias("m")).first()
    assert abs(got["z"] - (40e6 + 780 / 8)) < 1e-6 and abs(got["m"] - got["z"] / 40) < 1e-9
    neg = df.select("k", (-F.col("s")).alias("s")).groupBy("k").agg(Mo.exact_sum("s").alias("z")).first()["z"]
    assert abs(neg + got["z"]) < 1e-6


def test_missing_targets_and_predictions(spark):
    nan = float("nan")
    rows = [(0.9, 0.8), (None, 0.9), (nan, 0.2), (0.9, None), (0.1, nan), (0.2, 0.7), (0.8, 0.1)]
    df = P.binarise(spark.createDataFrame(rows, "target double, pred double"))
    assert [r["toxic"] for r in df.collect()] == [True, False, False, True, False, False, True]
    m = M.with_rates(M.confusion_counts(df)).first()
    assert (m["n"], m["tp"], m["fp"], m["fn"], m["tn"]) == (5, 1, 2, 1, 1)
    a = M.auc(df).first()
    assert (a["n_pos"], a["n_neg"]) == (2, 3)


def test_reuse_or_build_only_builds_what_is_not_there(spark):
    path = tempfile.mkdtemp(prefix="equitext-reuse-")
    bad = os.path.join(path, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):  # noqa: B017 - a broken table is an error, not a missing one
        X.reuse_or_build(spark, bad, lambda: spark.range(3)).count()
    assert os.listdir(bad) == ["part-0.parquet"]
    with pytest.raises(Exception):  # noqa: B017
        latest_model(spark, bad, LinearModel((0.0,), 0.0))
    assert X.reuse_or_build(spark, os.path.join(path, "new"), lambda: spark.range(3)).count() == 3


def test_words_without_a_vector_are_an_error(spark):
    v = spark.createDataFrame([("a", [1.0])], "token string, vec array<double>")
    w = spark.createDataFrame([("a",), ("zzz",)], "token string")
    with pytest.raises(KeyError, match="zzz"):
        E.mean_vector_long(v, w)


def test_retrain_stops_and_says_why(spark):
    rows = [(i, int(i % 2), [float(i % 2) * 2 - 1, 0.1]) for i in range(40)]
    clean = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    assert Mo.retrain_on_errors(clean, max_rounds=5) == [(1, 40, 0, True)]
    mixed = spark.createDataFrame([(i, int(i % 2), [0.0, 1.0]) for i in range(41)], clean.schema)
    out = Mo.retrain_on_errors(mixed, max_rounds=5)
    assert out[0][2] == 20 and out[-1] == (2, 20, None, False)


def test_folds_hold_every_class(spark):
    rows = spark.range(103).select("id", (F.col("id") < 6).cast("int").alias("label"))
    per = Mo.stratified_folds(rows, 5).groupBy("fold").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["p"] for r in per) == [1, 1, 1, 1, 2] and sum(r["n"] for r in per) == 103


def test_weights_json_in_both_layouts(spark):
    path = tempfile.mkdtemp(prefix="equitext-weights-")
    with open(os.path.join(path, "one.json"), "w") as f:
        f.write('{"a": {"add_pleasent": 0.5, "sub_unpleasent": 0.25}, "b": {}}\n')
    rows = {r["token"]: r for r in T.read_weights(spark, path).collect()}
    assert rows["a"]["add_pleasent"] == 0.5 and rows["a"]["sub_pleasent"] is None and rows["b"]["add_pleasent"] is None
    T.write_weights(T.read_weights(spark, path), path + "-again")
    again = {r["token"]: tuple(r)[1:] for r in T.read_weights(spark, path + "-again").collect()}
    assert again == {k: tuple(v)[1:] for k, v in rows.items()}


def test_release_deletes_intermediate_tables(spark):
    session.release(spark)
    df = session.materialize(spark.range(5), "gone")
    assert df.count() == 5 and session.release(spark) == 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0])


def test_exact_sum_keeps_ties(spark):
    vals = [0.1, -0.7, 1e-9, 3.3333333]
    df = spark.createDataFrame([(k, v) for k in range(2) for v in (vals if k else vals[::-1])], "k int, s double")
    a, b = (r["z"] for r in df.groupBy("k").agg(Mo.exact_sum("s").alias("z")).collect())
    assert a == b and math.isclose(a, sum(vals), abs_tol=1e-11)
