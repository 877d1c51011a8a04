"""Queries: model training, scoring, warm start, group model, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.operators import debias as D
from equitext.operators import embed as E
from equitext.operators import metrics as M
from equitext.operators import model as Mo
from equitext.operators import split as X
from equitext.operators.profile import any_group
from equitext.plans.oracle import prelude
from equitext.plans.q_debias import DIRS_SQL, apply_weights, setup
from equitext.plans.q_profile import _r, _with, labelled
from equitext.plans.q_split import _U, NOGROUP, SPLIT_SQL
from equitext.plans.registry import query
from equitext.session import literal_table, materialize
from equitext.sources import fixtures as fx


def _ctx(spark: SparkSession, sf_dir: str):
    df = labelled(spark, sf_dir)
    wv = fx.word_vectors(spark, sf_dir)
    k, dim = fx.embedding_shape(spark, sf_dir)
    return df, wv, k, dim, fx.fixture_model(dim)


SCORE_SQL = """ssc AS (SELECT t.id, count(*) AS n_known, (CAST(sum(CAST(round((ts.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 / count(ts.s)) AS z_mean, (CAST(sum(CAST(round((ts.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12) AS z_sum
  FROM tok t JOIN token_scores ts ON t.token = ts.token GROUP BY t.id),
scored AS (SELECT l.id, l.toxic, CAST(coalesce(ssc.n_known, 0) AS BIGINT) AS n_known,
  1 / (1 + exp(-(coalesce(ssc.z_mean, 0.0) + m.b))) AS pred,
  1 / (1 + exp(-(coalesce(ssc.z_sum, 0.0) + m.b))) AS pred_sum
  FROM labelled l LEFT JOIN ssc ON ssc.id = l.id, model m)"""

_SCORE_HEAD = prelude("labelled", "tok", "token_scores", "model").rstrip("\n") + ",\n" + SCORE_SQL


@query("m06_score_mean", _SCORE_HEAD + f"\nSELECT id, n_known, {_r('pred', 'pred')} FROM scored")
def m06_score_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring with a coefficient table: one score per vocabulary token,
    one average per comment (mean-vector features)."""
    df, wv, k, dim, model = _ctx(spark, sf_dir)
    return Mo.score_docs(df, Mo.token_scores(wv, model), model.bias, "mean", bound_rows=k).select(
        "id", "n_known", "pred"
    )


@query(
    "m06_score_auc",
    _SCORE_HEAD
    + """,
labelled2 AS (SELECT s.id, s.toxic, s.pred FROM scored s),
overall_sc AS (SELECT pred AS score, count(*) FILTER (WHERE toxic) AS pos,
  count(*) FILTER (WHERE NOT toxic) AS neg FROM labelled2 GROUP BY pred),
overall_cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM overall_sc)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  round(CAST(sum(pos * (nb + neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) + 0.0 AS auc
FROM overall_cum""",
)
def m06_score_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC AUC of the coefficient-table model on every comment."""
    df, wv, k, dim, model = _ctx(spark, sf_dir)
    scored = Mo.score_docs(df, Mo.token_scores(wv, model), model.bias, "mean", bound_rows=k, keep=["toxic"])
    return M.auc(scored)


@query(
    "m04_warm_start_step",
    _SCORE_HEAD
    + """,
resid AS (SELECT id, n_known, pred - CAST(toxic AS DOUBLE) AS r FROM scored),
tot AS (SELECT count(*) AS n, sum(r) AS sum_r FROM resid),
c AS (SELECT t.token, sum(r.r / r.n_known) AS c FROM tok t JOIN token_scores ts ON t.token = ts.token
  JOIN resid r ON r.id = t.id WHERE r.n_known > 0 GROUP BY t.token),
g AS (SELECT pos, sum(c.c * w.vec[pos + 1]) AS g FROM c JOIN word_vectors w ON c.token = w.token,
  range(64) p(pos) GROUP BY pos),
wts AS (SELECT pos, m.w[pos + 1] AS w FROM range(64) p(pos), model m)
SELECT CAST(wts.pos AS VARCHAR) AS feature,
  round(wts.w - 0.1 * (coalesce(g.g, 0.0) / tot.n + 0.0001 * wts.w), 6) + 0.0 AS weight
FROM wts LEFT JOIN g ON g.pos = wts.pos, tot
UNION ALL SELECT 'bias', round(m.b - 0.1 * tot.sum_r / tot.n, 6) + 0.0 FROM model m, tot""",
)
def m04_warm_start_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One warm-start gradient step from a saved coefficient table."""
    df, wv, k, dim, model = _ctx(spark, sf_dir)
    return Mo.gradient_step(df.withColumn("label", F.col("toxic")), wv, model, lr=0.1, bound_rows=k)


def _incremental_sql(batches: int = 4, lr: float = 0.1, reg: float = 1e-4, salt: str = "11:batch") -> str:
    """Warm-start steps over hash-ordered mini-batches, one CTE block per step."""
    mean = "(CAST(sum(CAST(round((ts.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 / count(ts.s))"
    parts = [
        "m0 AS (SELECT w, b FROM model)",
        f"""bt AS (SELECT id, toxic, CAST(floor(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':{salt}'), 1, 8))
  AS BIGINT) / 4294967296.0 * {batches}) AS INTEGER) AS batch FROM labelled)""",
    ]
    for i in range(batches):
        parts += [
            f"""ts{i} AS (SELECT w.token, list_sum(list_transform(range(1, 65), lambda j: w.vec[j] * m.w[j])) AS s
  FROM word_vectors w, m{i} m)""",
            f"""ssc{i} AS (SELECT t.id, count(*) AS n_known, {mean} AS z FROM tok t JOIN ts{i} ts ON t.token = ts.token
  JOIN bt ON bt.id = t.id WHERE bt.batch = {i} GROUP BY t.id)""",
            f"""sc{i} AS (SELECT bt.id, coalesce(ssc.n_known, 0) AS n_known,
  1 / (1 + exp(-(coalesce(ssc.z, 0.0) + m.b))) - CAST(bt.toxic AS DOUBLE) AS r
  FROM bt LEFT JOIN ssc{i} ssc ON ssc.id = bt.id, m{i} m WHERE bt.batch = {i})""",
            f"tot{i} AS (SELECT count(*) AS n, sum(r) AS sum_r FROM sc{i})",
            f"""c{i} AS (SELECT t.token, sum(r.r / r.n_known) AS c FROM tok t JOIN ts{i} ts ON t.token = ts.token
  JOIN sc{i} r ON r.id = t.id WHERE r.n_known > 0 GROUP BY t.token)""",
            f"""g{i} AS (SELECT pos, sum(c.c * w.vec[pos + 1]) AS g FROM c{i} c JOIN word_vectors w ON c.token = w.token,
  range(64) p(pos) GROUP BY pos)""",
            f"""m{i + 1} AS (SELECT list(m.w[p.pos + 1] - {lr} * (coalesce(g.g, 0.0) / t.n + {reg} * m.w[p.pos + 1])
  ORDER BY p.pos) AS w, any_value(m.b - {lr} * t.sum_r / t.n) AS b
  FROM range(64) p(pos) LEFT JOIN g{i} g ON g.pos = p.pos, m{i} m, tot{i} t)""",
        ]
    head = prelude("labelled", "tok", "word_vectors", "model").rstrip("\n")
    m = f"m{batches}"
    return head + ",\n" + ",\n".join(parts) + f"""
SELECT CAST(p.pos AS VARCHAR) AS feature, round(m.w[p.pos + 1], 6) + 0.0 AS weight FROM range(64) p(pos), {m} m
UNION ALL SELECT 'bias', round(b, 6) + 0.0 FROM {m}"""


@query("m05_incremental_fit", _incremental_sql())
def m05_incremental_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four warm-start steps over hash-ordered mini-batches."""
    df, wv, k, dim, model = _ctx(spark, sf_dir)
    m = Mo.incremental_fit(df.withColumn("label", F.col("toxic")), wv, model, batches=4, bound_rows=k)
    return Mo.coefficient_table(spark, m)


def _train_features(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None):
    df, wv, k, dim, model = _ctx(spark, sf_dir)
    rows = rows if rows is not None else df
    vecs = E.doc_vectors(rows, wv, "mean", dim=dim, bound_rows=k, chars=lambda: fx.text_chars(spark, sf_dir))
    # written once: iterative fits and folds read it instead of re-tokenising
    return materialize(vecs.join(rows.select("id", F.col("toxic").cast("int").alias("label")), "id"), "features")


@query("m03_train_logistic")
def m03_train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 logistic regression on mean word vectors of the training split;
    returns the coefficient table."""
    from equitext.plans.q_split import _split

    df, split = _split(spark, sf_dir)
    train = X.split_rows(df, split, "train")
    m = Mo.train_logistic(_train_features(spark, sf_dir, train))
    return Mo.coefficient_table(spark, m)


@query("m26_nongroup_baseline")
def m26_nongroup_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second baseline trained on training rows in no group (for the router)."""
    return Mo.coefficient_table(spark, Mo.train_logistic(_nongroup_features(spark, sf_dir)))


def _nongroup_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows in no group."""
    from equitext.plans.q_split import _split

    df, split = _split(spark, sf_dir)
    return _train_features(spark, sf_dir, X.split_rows(df, split, "train").where(~any_group()))


@query("m19_group_model_train")
def m19_group_model_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-membership model on the training rows: group rows (label 1,
    duplicates kept) and half of the other rows (label 0), sum-vector
    features."""
    return Mo.coefficient_table(spark, Mo.train_logistic(_group_features(spark, sf_dir)))


def _group_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vec): a vector is built once per row and joined by id to
    as many labels as the row has."""
    from equitext.plans.q_split import _split

    df, wv, k, dim, model = _ctx(spark, sf_dir)
    train = X.split_rows(df, _split(spark, sf_dir)[1], "train")
    rows = X.downsample(X.group_vs_rest(train), 0.5, 7, where=F.col("group_label") == 0)
    vecs = E.doc_vectors(train, wv, "sum", dim=dim, bound_rows=k, chars=lambda: fx.text_chars(spark, sf_dir))
    return materialize(rows.select("id", F.col("group_label").alias("label")).join(vecs, "id"), "group-features")


@query(
    "m20_group_model_auc",
    _with(SPLIT_SQL, "labelled", "tok", "token_scores", "model", memberships=True).rstrip("\n")
    + """,
test_ids AS (SELECT id FROM bsplit WHERE split = 'test'),
gm AS (SELECT id, true AS y FROM memberships SEMI JOIN test_ids USING (id) WHERE gscore > 0.5
  UNION ALL SELECT id, false FROM labelled SEMI JOIN test_ids USING (id) WHERE """ + NOGROUP + """),
ssum AS (SELECT t.id, (CAST(sum(CAST(round((ts.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12) AS z FROM tok t JOIN token_scores ts ON t.token = ts.token GROUP BY t.id),
sc AS (SELECT gm.y, 1 / (1 + exp(-(coalesce(ssum.z, 0.0) + m.b))) AS score
  FROM gm LEFT JOIN ssum ON ssum.id = gm.id, model m),
agg AS (SELECT score, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM sc GROUP BY score),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM agg)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  round(CAST(sum(pos * (nb + neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) + 0.0 AS auc FROM cum""",
)
def m20_group_model_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-membership scores (sum-vector features) on the test split and
    their AUC; a row in k groups counts k times as positive."""
    from equitext.plans.q_split import _split

    df, wv, k, dim, model = _ctx(spark, sf_dir)
    test = X.split_rows(df, _split(spark, sf_dir)[1], "test")
    gv = X.group_vs_rest(test)
    scores = Mo.score_docs(test, Mo.token_scores(wv, model), model.bias, "sum", bound_rows=k)
    rows = gv.join(scores.select("id", "pred"), "id").withColumn("y", F.col("group_label") == 1)
    return M.auc(rows, score="pred", label="y")


_ROUTER_SQL = (
    prelude("labelled", "tok", "word_vectors", "pleasant_words", "unpleasant_words", "model",
            "token_scores", "weights").rstrip("\n")
    + DIRS_SQL
    + """,
adj AS (SELECT ts.token, ts.s, ts.s
  + CASE WHEN w.add_pleasent IS NOT NULL AND w.sub_unpleasent IS NOT NULL
    THEN w.add_pleasent * k.zP - w.sub_unpleasent * k.zU ELSE 0.0 END
  + CASE WHEN w.sub_pleasent IS NOT NULL AND w.add_unpleasent IS NOT NULL
    THEN w.add_unpleasent * k.zU - w.sub_pleasent * k.zP ELSE 0.0 END AS s_adj
  FROM token_scores ts LEFT JOIN weights w ON ts.token = w.token, consts k),
per AS (SELECT t.id, (CAST(sum(CAST(round((a.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 / count(a.s)) AS zb, (CAST(sum(CAST(round((a.s_adj) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 / count(a.s_adj)) AS zd, (CAST(sum(CAST(round((a.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12) AS zg
  FROM tok t JOIN adj a ON t.token = a.token GROUP BY t.id),
p AS (SELECT l.id, 1 / (1 + exp(-(coalesce(zg, 0.0) + m.b))) AS p_group,
  1 / (1 + exp(-(coalesce(zd, 0.0) + m.b))) AS p_debias,
  1 / (1 + exp(-(coalesce(zb, 0.0) + m.b))) AS p_base
  FROM labelled l LEFT JOIN per ON per.id = l.id, model m)
SELECT id, CASE WHEN p_group > 0.5 THEN 'debiased' ELSE 'baseline' END AS route,
  round(CASE WHEN p_group > 0.5 THEN p_debias ELSE p_base END, 6) + 0.0 AS pred FROM p"""
)


@query("m24_router", _ROUTER_SQL)
def m24_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted group members go to the debiased model, others to the
    baseline (all three models given as coefficient tables)."""
    df, wv, model, dirs, k = setup(spark, sf_dir)
    adjusted = D.adjusted_scores(Mo.token_scores(wv, model), fx.fixture_weights(wv), model, dirs)
    return Mo.score_routes(df, adjusted, model.bias, bound_rows=k)


@query("m24_route_tables", _ROUTER_SQL)
def m24_route_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from three prediction tables, joined by id."""
    df, wv, k, dim, model = _ctx(spark, sf_dir)
    scores = Mo.token_scores(wv, model)
    p_group = Mo.score_docs(df, scores, model.bias, "sum", bound_rows=k)
    p_base = Mo.score_docs(df, scores, model.bias, "mean", bound_rows=k)
    return Mo.route(p_group, apply_weights(spark, sf_dir, "all"), p_base)


@query("m05_stream_incremental_fit", _incremental_sql(salt="13:file"))
def m05_stream_incremental_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-start training as a stream: the comments arrive in four rounds (by
    hash), each micro-batch takes one gradient step from the previous
    version."""
    import uuid

    from equitext.operators.split import hash_uniform
    from equitext.session import scratch_path
    from equitext.streaming.incremental import latest_model, train_stream

    df, wv, k, dim, model = _ctx(spark, sf_dir)
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    rows = df.select("id", "comment_text", F.col("toxic").alias("label"))
    part = F.floor(hash_uniform("id", 13, "file") * 4).cast("int")
    rows = materialize(rows.withColumn("part", part), "stream-rows")
    schema = rows.drop("part").schema
    for i in range(4):
        # what arrives in a round, in as many files as it has, is one batch
        rows.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        train_stream(stream, wv, model, f"{base}/model", f"{base}/ckpt", bound_rows=k).awaitTermination()
    _, final = latest_model(spark, f"{base}/model", model)
    return Mo.coefficient_table(spark, final)


# ---------------------------------------------------------------------------
# Fits checked at their optimum: training set sizes and whether the penalised
# loss is at its minimum there, which SQL can state without the optimiser
# ---------------------------------------------------------------------------

_OPT_HEAD = _with(SPLIT_SQL, "labelled", memberships=True)
_OPT_COLS = "count(*) AS n_rows, count(*) FILTER (WHERE y) AS n_pos, CAST(64 AS BIGINT) AS n_features, true AS at_optimum"
_TRAIN = "(SELECT id FROM bsplit WHERE split = 'train')"


def _optimum(features: DataFrame) -> DataFrame:
    # the fit that the training queries return
    return Mo.optimum_check(features, Mo.train_logistic(features))


@query("m03_train_optimum", _OPT_HEAD + f"SELECT {_OPT_COLS} FROM (SELECT toxic AS y FROM labelled SEMI JOIN {_TRAIN} USING (id))")
def m03_train_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity model's training rows and whether the fit is the optimum."""
    from equitext.plans.q_split import _split

    df, split = _split(spark, sf_dir)
    return _optimum(_train_features(spark, sf_dir, X.split_rows(df, split, "train")))


@query("m26_nongroup_optimum", _OPT_HEAD + f"SELECT {_OPT_COLS} FROM (SELECT toxic AS y FROM labelled SEMI JOIN {_TRAIN} USING (id) WHERE {NOGROUP})")
def m26_nongroup_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the model of rows in no group."""
    return _optimum(_nongroup_features(spark, sf_dir))


@query(
    "m19_group_model_optimum",
    _OPT_HEAD + f"""SELECT {_OPT_COLS} FROM (
  SELECT true AS y FROM memberships SEMI JOIN {_TRAIN} USING (id) WHERE gscore > 0.5
  UNION ALL SELECT false FROM labelled SEMI JOIN {_TRAIN} USING (id) WHERE {NOGROUP} AND {_U.format(seed=7)} < 0.5)""",
)
def m19_group_model_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the group-membership model."""
    return _optimum(_group_features(spark, sf_dir))


#: (id, toxic, fold): the five stratified folds of M22 and M23
FOLDS_SQL = """SELECT id, toxic, (row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(id AS VARCHAR) || ':5:fold')) - 1) % 5 + 1 AS fold
  FROM labelled"""


@query(
    "m22_cv_folds",
    prelude("labelled") + f"SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_test, count(*) FILTER (WHERE toxic) AS n_pos FROM ({FOLDS_SQL}) GROUP BY fold",
)
def m22_cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and positives of the five stratified folds of M22 and M23."""
    rows = labelled(spark, sf_dir).select("id", F.col("toxic").cast("int").alias("label"))
    f = Mo.stratified_folds(rows, 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("label") == 1).alias("n_pos"))
