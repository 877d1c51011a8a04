"""Micro-fixtures: ties, one class, NULL / NaN scores, thresholds, empty
groups, unknown tokens, tokeniser, vocabulary, weights JSON, multi-group
rows, keyword substrings."""

import math

from pyspark.sql import functions as F

from equitext.constants import GROUPS
from equitext.functions.text import word_tokens
from equitext.operators import bow as B
from equitext.operators import metrics as M
from equitext.operators import model as Mo
from equitext.operators import profile as P
from equitext.sources.fixtures import LinearModel


def _auc(spark, rows):
    df = spark.createDataFrame(rows, "toxic boolean, pred double")
    return M.auc(df).first()["auc"]


def test_auc_with_ties(spark):
    rows = [(True, 0.9), (False, 0.5), (True, 0.5), (False, 0.1), (True, 0.1)]
    assert abs(_auc(spark, rows) - 4 / 6) < 1e-12


def test_auc_one_class_is_null(spark):
    assert _auc(spark, [(True, 0.9), (True, 0.2)]) is None


def _comment_rows(scores, toxic, pred):
    base = {g: 0.0 for g in GROUPS}
    base.update(scores)
    return (1, "x", 0.9 if toxic else 0.1, *[base[g] for g in GROUPS], pred)


def _frame(spark, rows):
    cols = "id long, comment_text string, target double, " + ", ".join(f"{g} double" for g in GROUPS) + ", pred double"
    df = spark.createDataFrame(rows, cols)
    return P.binarise(df)


def test_null_and_nan_scores_are_in_no_segment(spark):
    rows = [
        (1, "a", 0.9, *([None] + [0.0] * 8), 0.8),
        (2, "b", 0.1, *([float("nan")] + [0.0] * 8), 0.2),
        (3, "c", 0.9, *([0.9] + [0.0] * 8), 0.7),
        (4, "d", 0.1, *([0.9] + [0.0] * 8), 0.3),
    ]
    df = _frame(spark, rows)
    seg = M.group_memberships(df, ["black"], keep=["id"])
    assert sorted(r["id"] for r in seg.collect()) == [3, 4]


def test_threshold_edges(spark):
    rows = [(1, "a", 0.5, *([0.5] + [0.0] * 8), 0.5)]
    df = _frame(spark, rows)
    r = df.select("toxic", P.any_group().alias("g"), P.prediction_label().alias("p"),
                  M.background("black").alias("bg")).first()
    assert (r["toxic"], r["g"], r["p"], r["bg"]) == (False, False, False, True)


def test_empty_group_has_zero_size_and_null_fractions(spark):
    rows = [(i, "a", 0.9 if i % 2 else 0.1, *([0.0] * 9), 0.5) for i in range(4)]
    prev = {r["subgroup"]: r for r in P.group_prevalence(_frame(spark, rows)).collect()}
    assert prev["black"]["n"] == 0 and prev["black"]["pct_toxic_in_group"] is None
    assert prev["black"]["pct_of_all"] == 0.0


def test_unknown_tokens_score_sigmoid_bias_and_row_is_kept(spark):
    docs = spark.createDataFrame([(1, "zzzz qqqq"), (2, ""), (3, "hello")], "id long, comment_text string")
    scores = spark.createDataFrame([("hello", 2.0)], "token string, s double")
    out = {r["id"]: r for r in Mo.score_docs(docs, scores, -0.1, bound_rows=1).collect()}
    sig = 1 / (1 + math.exp(0.1))
    assert abs(out[1]["pred"] - sig) < 1e-12 and out[1]["n_known"] == 0
    assert abs(out[2]["pred"] - sig) < 1e-12
    assert abs(out[3]["pred"] - 1 / (1 + math.exp(-1.9))) < 1e-12


def test_tokeniser(spark):
    df = spark.createDataFrame([("Été _foo x 3abc don't ÉCOLE supercalifragilistic na1ve",)], "t string")
    assert df.select(word_tokens("t")).first()[0] == ["été", "abc", "don", "école", "na", "ve"]


def test_vocabulary_ranks_by_documents(spark):
    docs = spark.createDataFrame([(1, "aa " * 9 + "bb"), (2, "bb cc"), (3, "bb")], "id long, comment_text string")
    assert [r["token"] for r in B.fit_vocabulary(docs, k=1).collect()] == ["bb"]


def test_weights_json_partial_keys(spark):
    from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

    from equitext.constants import WEIGHT_COLUMNS

    js = '{"gay":{"add_pleasent":0.3,"sub_unpleasent":0.2,"sub_pleasent":{}}}'
    schema = MapType(StringType(), StructType([StructField(c, DoubleType()) for c in WEIGHT_COLUMNS]))
    df = spark.createDataFrame([(js,)], "value string")
    r = df.select(F.explode(F.from_json("value", schema)).alias("token", "w")).select("token", "w.*").first()
    assert (r["token"], r["add_pleasent"], r["sub_unpleasent"], r["sub_pleasent"], r["add_unpleasent"]) == (
        "gay", 0.3, 0.2, None, None)


def test_multi_group_row_in_bag_and_distinct_union(spark):
    rows = [(1, "a", 0.9, *([0.9, 0.8] + [0.0] * 7), 0.5)]
    df = _frame(spark, rows)
    assert P.bag_union(df).count() == 2
    assert P.distinct_union(P.bag_union(df).select("id")).count() == 1


def test_keyword_substring(spark):
    df = spark.createDataFrame([(1, "A Female voice")], "id long, comment_text string")
    assert P.keyword_filter(df, "male").count() == 1
    assert P.keyword_filter(df, ["gay", "MALE"]).count() == 1


def test_score_pushdown_equals_mean_vector(spark):
    vecs = spark.createDataFrame([("aa", [1.0, 2.0]), ("bb", [3.0, -1.0])], "token string, vec array<double>")
    model = LinearModel((0.5, -0.25), 0.1)
    docs = spark.createDataFrame([(1, "aa bb bb zz")], "id long, comment_text string")
    got = Mo.score_docs(docs, Mo.token_scores(vecs, model), model.bias, bound_rows=2).first()["pred"]
    x = [(1 + 3 + 3) / 3, (2 - 1 - 1) / 3]
    z = 0.5 * x[0] - 0.25 * x[1] + 0.1
    assert abs(got - 1 / (1 + math.exp(-z))) < 1e-12
