"""Queries: the bag-of-words model from split to bias report.

Models fitted by an optimiser are checked at their optimum; scoring and every
evaluation use a coefficient table given by rule over the stored vocabulary,
so SQL can state the results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.functions.text import bow_tokens
from equitext.operators import bow as B
from equitext.operators import metrics as M
from equitext.operators import model as Mo
from equitext.operators import probes as Pr
from equitext.operators import split as X
from equitext.operators.profile import encode_label
from equitext.plans.oracle import prelude
from equitext.plans.q_probes import TEMPLATES_SQL
from equitext.plans.q_profile import BIAS_AUC_SQL, MEMBERSHIPS, OVERALL_AUC_SQL, _r
from equitext.plans.q_split import EXTERNAL, SPLIT_SQL, _split
from equitext.plans.q_text import BOW_TOK, VOCAB_SQL, _train_test
from equitext.plans.registry import query
from equitext.session import derived_table, materialize, scratch_path
from equitext.sources import fixtures as fx
from equitext.sources import tables as T

BIAS = -0.2
_EXACT = "CAST(sum(CAST(round(({x}) * 1e12) AS HUGEINT)) AS DOUBLE) / 1e12"


def _head(*views: str, extra: list[tuple[str, str]] = ()) -> str:
    """CTEs up to ``coef`` (token, s): the vocabulary of the training rows and
    the coefficients given by rule."""
    head = prelude("labelled", *views, extra=[MEMBERSHIPS, *extra]).rstrip("\n")
    return (
        head + ",\n" + SPLIT_SQL + ",\n" + BOW_TOK[0] + " AS (\n" + BOW_TOK[1] + "\n)" + VOCAB_SQL
        + ", coef AS (SELECT token, CAST((idx * 37 + 11) % 41 - 20 AS DOUBLE) / 40 AS s FROM vocab)\n"
    )


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vocabulary of the training rows."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")]
    return derived_table(spark, "bow-vocabulary", inputs, lambda: B.fit_vocabulary(_train_test(spark, sf_dir)[0]))


def _coefficients(vocab: DataFrame) -> DataFrame:
    """(token, s): coefficients by rule, one per vocabulary token."""
    return vocab.select("token", (((F.col("idx") * 37 + 11) % 41 - 20).cast("double") / 40).alias("s"))


@query(
    "m01_bow_vectoriser",
    _head() + """SELECT l.id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_terms, CAST(coalesce(c.x, 0) AS BIGINT) AS index_sum
FROM (SELECT id FROM labelled SEMI JOIN (SELECT id FROM bsplit WHERE split = 'test') USING (id)) l LEFT JOIN (
  SELECT b.id, count(*) AS n, sum(v.idx) AS x FROM (SELECT DISTINCT id, token FROM btok) b JOIN vocab v ON v.token = b.token
  GROUP BY b.id) c ON c.id = l.id""",
)
def m01_bow_vectoriser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows as sparse binary vectors of the stored vocabulary."""
    test = X.split_rows(*_split(spark, sf_dir), "test")
    out = B.sparse_features(test, B.vectoriser(_vocab(spark, sf_dir)))
    return out.select("id", Mo.sparse_items().alias("p")).select(
        "id", F.size("p").cast("bigint").alias("n_terms"),
        F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["index"]).alias("index_sum"))


def _bow_fit(spark: SparkSession, sf_dir: str):
    train, test = _train_test(spark, sf_dir)
    vocab = _vocab(spark, sf_dir)
    rows = B.sparse_features(train.select("id", "comment_text", F.col("toxic").cast("int").alias("label")),
                             B.vectoriser(vocab)).select("id", "label", "features")
    rows = materialize(rows, "bow-features")
    return rows, test, vocab, Mo.train_sparse(rows)


@query(
    "m03_bow_train_optimum",
    _head() + """SELECT count(*) AS n_rows, count(*) FILTER (WHERE toxic) AS n_pos,
  (SELECT count(*) FROM vocab) AS n_features, true AS at_optimum
FROM labelled SEMI JOIN (SELECT id FROM bsplit WHERE split = 'train') USING (id)""",
)
def m03_bow_train_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag-of-words model's training rows and its slope where it was
    fitted."""
    rows, _, vocab, model = _bow_fit(spark, sf_dir)
    return Mo.sparse_optimum_check(rows, model, tolerance=1e-2)


@query("m18_bow_fitted_report")
def m18_bow_fitted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, vocabulary, fit, scores of the test rows and their bias report.
    The optimiser's coefficients have no SQL; ``m18_bow_bias_report`` is the
    same chain with given ones."""
    _, test, vocab, model = _bow_fit(spark, sf_dir)
    coef = B.coefficient_table(vocab, model)
    path = scratch_path(spark, f"bow-model-{uuid.uuid4().hex}")
    T.write_model(coef, path)
    scored = B.score_rows(test, spark.read.parquet(path), float(model.intercept), ["id"])
    return M.bias_report(test.drop("pred").join(scored, "id"))


def _scored(spark: SparkSession, sf_dir: str, rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return B.score_rows(rows, _coefficients(_vocab(spark, sf_dir)), BIAS, keys, text)


_TEST_SCORES = f""", bsc AS (SELECT b.id, {_EXACT.format(x='c.s')} AS z FROM (SELECT DISTINCT id, token FROM btok) b
  JOIN coef c ON c.token = b.token GROUP BY b.id),
bscored AS (SELECT l.id, 1 / (1 + exp(-(coalesce(bsc.z, 0.0) + {BIAS}))) AS pred FROM labelled l LEFT JOIN bsc ON bsc.id = l.id)
"""


@query("m06_bow_score", _head() + _TEST_SCORES + f"SELECT id, {_r('pred', 'pred')} FROM bscored")
def m06_bow_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment scored with a bag-of-words coefficient table."""
    return _scored(spark, sf_dir, fx.comments(spark, sf_dir), ["id"], "comment_text").select("id", "pred")


# the bias report of the test rows under the bag-of-words scores: the same
# SQL as for given predictions, over views of the same names
_REPORT_VIEWS = (
    _TEST_SCORES
    + """, labelled_all AS (SELECT * FROM labelled), memberships_all AS (SELECT * FROM memberships),
test_ids AS (SELECT id FROM bsplit WHERE split = 'test')
"""
)


def _report_sql() -> str:
    body = BIAS_AUC_SQL.replace("FROM memberships", "FROM memberships_t")
    return (
        _head() + _REPORT_VIEWS + """, memberships_t AS (SELECT m.id, m.toxic, s.pred, m.subgroup, m.gscore
  FROM memberships m JOIN bscored s ON s.id = m.id SEMI JOIN test_ids t ON t.id = m.id),
""" + body + f"""
SELECT subgroup, subgroup_size, {_r('subgroup_auc', 'subgroup_auc')}, {_r('bpsn_auc', 'bpsn_auc')}, {_r('bnsp_auc', 'bnsp_auc')}
FROM bias"""
    )


@query("m18_bow_bias_report", _report_sql())
def m18_bow_bias_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias AUCs of the test rows under the bag-of-words scores."""
    test = X.split_rows(*_split(spark, sf_dir), "test")
    scored = _scored(spark, sf_dir, test, ["id"], "comment_text").select("id", "pred")
    report = M.bias_report(test.drop("pred").join(scored, "id"))
    return report.select("subgroup", "subgroup_size", "subgroup_auc", "bpsn_auc", "bnsp_auc")


def _eval_sql(evalset: str, keys: str = "") -> str:
    """SQL tail: ``ev(id, variant, token array source)`` -> metrics per variant."""
    return f""",
ev AS ({evalset}),
etok AS (SELECT DISTINCT id, variant, token FROM (SELECT id, variant, unnest(tokens) AS token FROM ev)),
esc AS (SELECT e.id, e.variant, {_EXACT.format(x='c.s')} AS z FROM etok e JOIN coef c ON c.token = e.token GROUP BY e.id, e.variant),
scored AS (SELECT ev.id, ev.variant, ev.y, 1 / (1 + exp(-(coalesce(esc.z, 0.0) + {BIAS}))) AS pred
  FROM ev LEFT JOIN esc ON esc.id = ev.id AND esc.variant = ev.variant),
conf AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE pred > 0.5 AND y) AS tp,
  count(*) FILTER (WHERE pred > 0.5 AND NOT y) AS fp, count(*) FILTER (WHERE NOT pred > 0.5 AND y) AS fn,
  count(*) FILTER (WHERE NOT pred > 0.5 AND NOT y) AS tn FROM scored GROUP BY variant),
sagg AS (SELECT variant, pred AS score, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg
  FROM scored GROUP BY variant, pred),
scum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY variant ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM sagg),
eauc AS (SELECT variant, CASE WHEN sum(pos) * sum(neg) > 0 THEN
  CAST(sum(pos * (nb + neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc FROM scum GROUP BY variant)
SELECT {keys} n, tp, fp, fn, tn, {_r('(tp + tn) / n', 'accuracy')}, {_r('auc', 'auc')} FROM conf JOIN eauc USING (variant)"""


_TOKENS = r"regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"


@query(
    "m15_bow_template_eval",
    _head("identity_words", extra=[("templates", TEMPLATES_SQL)])
    + _eval_sql(f"SELECT id, 'all' AS variant, Label = 'BAD' AS y, {_TOKENS.format(t='Text')} AS tokens FROM templates"),
)
def m15_bow_template_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template sentences under the bag-of-words model."""
    t = fx.templates(spark, sf_dir, fx.word_vectors(spark, sf_dir))
    rows = t.select("id", "Text", (encode_label("Label") == 1).alias("y"))
    return Pr.evaluate(_scored(spark, sf_dir, rows, ["id", "y"], "Text"))


@query(
    "m17_bow_external_eval",
    _head(extra=[EXTERNAL])
    + _eval_sql(f"SELECT id, 'all' AS variant, is_toxic AS y, {_TOKENS.format(t='comment')} AS tokens FROM external"),
)
def m17_bow_external_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The external labelled set under the bag-of-words model."""
    rows = fx.external_set(spark, sf_dir).select("id", "comment", F.col("is_toxic").alias("y"))
    return Pr.evaluate(_scored(spark, sf_dir, rows, ["id", "y"], "comment"))


@query(
    "m16_bow_fuzzed_eval",
    _head("identity_words")
    + """, fmap AS (SELECT a.token AS src, b.token AS dst FROM identity_words a JOIN identity_words b ON b.k = (a.k + 1) % 10),
fm AS (SELECT map_from_entries(list((src, dst))) AS m FROM fmap),
base AS (SELECT id, toxic AS y, """ + _TOKENS.format(t="comment_text") + """ AS tokens FROM labelled),
fhit AS (SELECT base.*, fm.m FROM base, fm WHERE list_has_any(tokens, (SELECT list(src) FROM fmap)))"""
    + _eval_sql("""SELECT id, 'orig' AS variant, y, tokens FROM fhit
  UNION ALL SELECT id, 'fuzzed', y, list_transform(tokens, lambda t: coalesce(m[t], t)) FROM fhit""", "variant,"),
)
def m16_bow_fuzzed_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with identity words, as written and with every identity word
    swapped, under the bag-of-words model."""
    from equitext.plans.q_profile import labelled

    words = fx.word_list_values(fx.word_vectors(spark, sf_dir), "identity")  # ten words
    mapping = {w: words[(i + 1) % len(words)] for i, w in enumerate(words)}
    rows = Pr.fuzz(labelled(spark, sf_dir), mapping, keep=["toxic"], tokens=bow_tokens)
    scored = B.score_token_sets(rows.withColumnRenamed("toxic", "y"), _coefficients(_vocab(spark, sf_dir)), BIAS,
                                ["id", "variant", "y"], "tokens")
    return Pr.evaluate(scored, ["variant"])
