"""Queries: probes, external evaluations, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.constants import GROUPS
from equitext.operators import metrics as M
from equitext.operators import model as Mo
from equitext.operators import probes as Pr
from equitext.operators.profile import encode_label, with_length
from equitext.plans.oracle import prelude
from equitext.plans.q_profile import BIAS_AUC_SQL, OVERALL_AUC_SQL, _r, _with, labelled
from equitext.plans.q_split import EXTERNAL
from equitext.plans.registry import query
from equitext.session import scratch_path
from equitext.sources import fixtures as fx
from equitext.sources import tables as T


def _ctx(spark: SparkSession, sf_dir: str):
    wv = fx.word_vectors(spark, sf_dir)
    k, dim = fx.embedding_shape(spark, sf_dir)
    model = fx.fixture_model(dim)
    return wv, k, model, Mo.token_scores(wv, model)


_SIG = "1 / (1 + exp(-({z})))"


@query(
    "m13_identity_word_probe",
    prelude("identity_words", "token_scores", "model")
    + f"""SELECT w.token, CAST(w.k AS BIGINT) AS k, {_r(_SIG.format(z='ts.s + m.b'), 'pred')}
FROM identity_words w JOIN token_scores ts ON ts.token = w.token, model m""",
)
def m13_identity_word_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p(toxic) of each identity word on its own."""
    wv, k, model, scores = _ctx(spark, sf_dir)
    words = fx.word_list(wv, "identity").select("token", F.col("k").cast("bigint").alias("k"))
    return Pr.word_probe(words, scores, model.bias)


@query(
    "m14_direction_word_probe",
    prelude("pleasant_words", "unpleasant_words", "token_scores", "model")
    + f"""SELECT l.list_name, l.token, {_r(_SIG.format(z='ts.s + m.b'), 'pred')}
FROM (SELECT 'pleasant' AS list_name, token FROM pleasant_words
      UNION ALL SELECT 'unpleasant', token FROM unpleasant_words) l
JOIN token_scores ts ON ts.token = l.token, model m""",
)
def m14_direction_word_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p(toxic) of each pleasant and unpleasant word."""
    wv, k, model, scores = _ctx(spark, sf_dir)
    words = (
        fx.word_list(wv, "pleasant").select("token", F.lit("pleasant").alias("list_name"))
        .unionByName(fx.word_list(wv, "unpleasant").select("token", F.lit("unpleasant").alias("list_name")))
    )
    return Pr.word_probe(words, scores, model.bias).select("list_name", "token", "pred")


def eval_sql(evalset: str) -> str:
    """SQL tail: ``evalset(id, text, y)`` -> one row of metrics."""
    return f""",
ev AS ({evalset}),
etok AS (SELECT id, t AS token FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')),
  '[\\p{{L}}\\p{{Nl}}\\p{{No}}_]+')) AS t FROM ev) WHERE length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_')),
esc AS (SELECT e.id, (CAST(sum(CAST(round((ts.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 / count(ts.s)) AS z FROM etok e JOIN token_scores ts ON ts.token = e.token GROUP BY e.id),
scored AS (SELECT ev.id, ev.y, {_SIG.format(z='coalesce(esc.z, 0.0) + m.b')} AS pred
  FROM ev LEFT JOIN esc ON esc.id = ev.id, model m),
conf AS (SELECT count(*) AS n, count(*) FILTER (WHERE pred > 0.5 AND y) AS tp,
  count(*) FILTER (WHERE pred > 0.5 AND NOT y) AS fp, count(*) FILTER (WHERE NOT pred > 0.5 AND y) AS fn,
  count(*) FILTER (WHERE NOT pred > 0.5 AND NOT y) AS tn FROM scored),
sagg AS (SELECT pred AS score, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg
  FROM scored GROUP BY pred),
scum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM sagg),
eauc AS (SELECT CASE WHEN sum(pos) * sum(neg) > 0 THEN
  CAST(sum(pos * (nb + neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc FROM scum)
SELECT n, tp, fp, fn, tn, {_r('(tp + tn) / n', 'accuracy')}, {_r('auc', 'auc')} FROM conf, eauc"""


TEMPLATES_SQL = """SELECT b.item_id AS id, 'I am a ' || w.token || '. ' || b.text AS Text,
  CASE WHEN b.item_id % 2 = 0 THEN 'BAD' ELSE 'NOT_BAD' END AS Label
  FROM benchmark b JOIN identity_words w ON w.k = b.item_id % 10"""


@query(
    "m15_template_eval",
    prelude("identity_words", "token_scores", "model", extra=[("templates", TEMPLATES_SQL)]).rstrip("\n")
    + eval_sql("SELECT id, Text AS text, Label = 'BAD' AS y FROM templates"),
)
def m15_template_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template sentences naming identity words (label BAD = 1): confusion,
    accuracy and AUC of the model."""
    wv, k, model, scores = _ctx(spark, sf_dir)
    t = fx.templates(spark, sf_dir, wv).select("id", F.col("Text").alias("text"), (encode_label("Label") == 1).alias("y"))
    scored = Pr.score_texts(t, scores, model.bias, ["id", "y"], bound_rows=k)
    return Pr.evaluate(scored)


@query(
    "m17_external_eval",
    prelude("token_scores", "model", extra=[EXTERNAL]).rstrip("\n")
    + eval_sql("SELECT id, comment AS text, is_toxic AS y FROM external"),
)
def m17_external_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External labelled set (conversation turns): confusion, accuracy, AUC."""
    wv, k, model, scores = _ctx(spark, sf_dir)
    ext = fx.external_set(spark, sf_dir).select("id", F.col("comment").alias("text"), F.col("is_toxic").alias("y"))
    scored = Pr.score_texts(ext, scores, model.bias, ["id", "y"], bound_rows=k)
    return Pr.evaluate(scored)


FUZZ_SQL = """fmap AS (SELECT a.token AS src, b.token AS dst FROM identity_words a
  JOIN identity_words b ON b.k = (a.k + 1) % 10),
hit AS (SELECT DISTINCT t.id FROM tok t JOIN fmap ON t.token = fmap.src),
ftok AS (SELECT t.id, 'orig' AS variant, t.token FROM tok t SEMI JOIN hit USING (id)
  UNION ALL SELECT t.id, 'fuzzed', coalesce(f.dst, t.token) FROM tok t SEMI JOIN hit USING (id)
  LEFT JOIN fmap f ON f.src = t.token),
fsc AS (SELECT f.id, f.variant, (CAST(sum(CAST(round((ts.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 / count(ts.s)) AS z FROM ftok f JOIN token_scores ts ON ts.token = f.token
  GROUP BY f.id, f.variant),
scored AS (SELECT v.id, v.variant, l.toxic AS y, 1 / (1 + exp(-(coalesce(fsc.z, 0.0) + m.b))) AS pred
  FROM (SELECT DISTINCT id, variant FROM ftok) v JOIN labelled l ON l.id = v.id
  LEFT JOIN fsc ON fsc.id = v.id AND fsc.variant = v.variant, model m),
conf AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE pred > 0.5 AND y) AS tp,
  count(*) FILTER (WHERE pred > 0.5 AND NOT y) AS fp, count(*) FILTER (WHERE NOT pred > 0.5 AND y) AS fn,
  count(*) FILTER (WHERE NOT pred > 0.5 AND NOT y) AS tn FROM scored GROUP BY variant),
sagg AS (SELECT variant, pred AS score, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg
  FROM scored GROUP BY variant, pred),
scum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY variant ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM sagg),
eauc AS (SELECT variant, CASE WHEN sum(pos) * sum(neg) > 0 THEN
  CAST(sum(pos * (nb + neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc
  FROM scum GROUP BY variant)"""


@query(
    "m16_fuzzed_eval",
    prelude("labelled", "tok", "identity_words", "token_scores", "model").rstrip("\n") + ",\n" + FUZZ_SQL
    + f"""
SELECT variant, n, tp, fp, fn, tn, {_r('(tp + tn) / n', 'accuracy')}, {_r('auc', 'auc')}
FROM conf JOIN eauc USING (variant)""",
)
def m16_fuzzed_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with identity words, original vs every identity word swapped
    for the next one: metrics per variant."""
    df = labelled(spark, sf_dir)
    wv, k, model, scores = _ctx(spark, sf_dir)
    words = fx.word_list_values(wv, "identity")  # ten words on the driver
    mapping = {w: words[(i + 1) % len(words)] for i, w in enumerate(words)}
    f = Pr.fuzz(df, mapping, keep=["toxic"])
    scored = Pr.score_token_arrays(f.withColumnRenamed("toxic", "y"), scores, model.bias,
                                   ["id", "variant", "y"], bound_rows=k)
    return Pr.evaluate(scored, ["variant"])


@query(
    "a23_fuzz_gap",
    prelude("labelled", "tok", "identity_words", "token_scores", "model").rstrip("\n") + ",\n" + FUZZ_SQL
    + f""",
m AS (SELECT variant, (tp + tn) / n AS accuracy, auc FROM conf JOIN eauc USING (variant))
SELECT {_r('o.auc - f.auc', 'auc_gap')}, {_r('o.accuracy - f.accuracy', 'accuracy_gap')}
FROM m o, m f WHERE o.variant = 'orig' AND f.variant = 'fuzzed'""",
)
def a23_fuzz_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original minus fuzzed AUC and accuracy (a pivot of the variant rows)."""
    ev = m16_fuzzed_eval(spark, sf_dir)
    p = ev.groupBy().pivot("variant", ["orig", "fuzzed"]).agg(F.first("auc").alias("auc"), F.first("accuracy").alias("acc"))
    return p.select(
        (F.col("orig_auc") - F.col("fuzzed_auc")).alias("auc_gap"),
        (F.col("orig_acc") - F.col("fuzzed_acc")).alias("accuracy_gap"),
    )


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------


@query(
    "s01_comment_csv_scan",
    prelude("comments")
    + f"""SELECT id, CAST(length(comment_text) AS BIGINT) AS length, {_r('target', 'target')},
  {', '.join(_r(g, g) for g in GROUPS)} FROM comments""",
)
def s01_comment_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments written as CSV (quoted multi-line text) and read back with
    the fixed comment schema."""
    path = scratch_path(spark, f"comments-{uuid.uuid4().hex}")
    c = fx.comments(spark, sf_dir).select("id", "target", "comment_text", *GROUPS)
    T.write_csv(c, path)
    back = with_length(T.read_comments(spark, path))
    return back.select("id", "length", "target", *GROUPS)


@query(
    "s05_template_csv_scan",
    prelude("identity_words", extra=[("templates", TEMPLATES_SQL)])
    + "SELECT Text, Label, CAST(CASE WHEN Label = 'BAD' THEN 1 ELSE 0 END AS BIGINT) AS y FROM templates",
)
def s05_template_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template set written as CSV, read with its schema, label encoded."""
    path = scratch_path(spark, f"templates-{uuid.uuid4().hex}")
    T.write_csv(fx.templates(spark, sf_dir, fx.word_vectors(spark, sf_dir)).select("Text", "Label"), path)
    return T.read_templates(spark, path).select("Text", "Label", encode_label("Label").alias("y"))


@query(
    "s07_external_csv_scan",
    prelude(extra=[EXTERNAL]) + "SELECT comment, is_toxic FROM external",
)
def s07_external_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External labelled set written as CSV and read with its schema."""
    path = scratch_path(spark, f"external-{uuid.uuid4().hex}")
    T.write_csv(fx.external_set(spark, sf_dir).select("comment", "is_toxic"), path)
    return T.read_external(spark, path)


@query(
    "s06_fuzzed_csv_scan",
    prelude("labelled", "tok", "identity_words").rstrip("\n")
    + """, fmap AS (SELECT a.token AS src FROM identity_words a),
hit AS (SELECT DISTINCT t.id FROM tok t JOIN fmap ON t.token = fmap.src)
SELECT id AS rev_id, comment_text AS comment, toxic FROM labelled SEMI JOIN hit USING (id)""",
)
def s06_fuzzed_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the fuzzed probe (rev_id, comment, toxic) written as CSV
    and read with the fuzzed-set schema."""
    df = labelled(spark, sf_dir)
    wv = fx.word_vectors(spark, sf_dir)
    words = fx.word_list(wv, "identity").select("token")
    hit = fx.token_occurrences(df).join(F.broadcast(words), "token", "left_semi").select("id").distinct()
    rows = df.join(hit, "id", "left_semi").select(
        F.col("id").alias("rev_id"), F.col("comment_text").alias("comment"), "toxic"
    )
    path = scratch_path(spark, f"fuzzed-{uuid.uuid4().hex}")
    T.write_csv(rows, path)
    return T.read_fuzzed(spark, path)


@query(
    "s09_prediction_sink",
    prelude("labelled") + f"SELECT id, {_r('pred', 'pred')} FROM labelled",
)
def s09_prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written keyed by id and read back."""
    path = scratch_path(spark, f"preds-{uuid.uuid4().hex}")
    T.write_predictions(labelled(spark, sf_dir).withColumn("pred", M.nan_to_null("pred")), path)
    return T.read_predictions(spark, path)


@query(
    "s12_model_sink",
    prelude("labelled", "tok", "token_scores", "model").rstrip("\n")
    + """, ssc AS (SELECT t.id, (CAST(sum(CAST(round((ts.s) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 / count(ts.s)) AS z FROM tok t JOIN token_scores ts ON t.token = ts.token GROUP BY t.id)
SELECT l.id, round(1 / (1 + exp(-(coalesce(ssc.z, 0.0) + m.b))), 6) + 0.0 AS pred
FROM labelled l LEFT JOIN ssc ON ssc.id = l.id, model m""",
)
def s12_model_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved as its coefficient table, loaded, and used to score."""
    wv, k, model, _ = _ctx(spark, sf_dir)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    T.write_model(Mo.coefficient_table(spark, model), path)
    loaded = T.read_model(spark, path)
    df = labelled(spark, sf_dir)
    return Mo.score_docs(df, Mo.token_scores(wv, loaded), loaded.bias, "mean", bound_rows=k).select("id", "pred")


_REPORT_METRICS = ["subgroup_size", "subgroup_auc", "bpsn_auc", "bnsp_auc", "tp", "fp", "fn", "tn"]


@query(
    "s13_metric_report",
    _with(OVERALL_AUC_SQL + ",\n" + BIAS_AUC_SQL, "labelled", memberships=True)
    + f""", conf AS (SELECT subgroup, count(*) FILTER (WHERE pred > 0.5 AND toxic) AS tp,
  count(*) FILTER (WHERE pred > 0.5 AND NOT toxic) AS fp, count(*) FILTER (WHERE NOT pred > 0.5 AND toxic) AS fn,
  count(*) FILTER (WHERE NOT pred > 0.5 AND NOT toxic) AS tn FROM memberships WHERE gscore > 0.5 AND pred IS NOT NULL GROUP BY subgroup),
oconf AS (SELECT count(*) FILTER (WHERE pred > 0.5 AND toxic) AS tp,
  count(*) FILTER (WHERE pred > 0.5 AND NOT toxic) AS fp, count(*) FILTER (WHERE NOT pred > 0.5 AND toxic) AS fn,
  count(*) FILTER (WHERE NOT pred > 0.5 AND NOT toxic) AS tn, count(*) AS n FROM labelled WHERE pred IS NOT NULL),
wide AS (SELECT 'overall' AS scope, CAST(n AS DOUBLE) AS subgroup_size, auc AS subgroup_auc,
    CAST(NULL AS DOUBLE) AS bpsn_auc, CAST(NULL AS DOUBLE) AS bnsp_auc,
    CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn
  FROM oconf, overall_auc
  UNION ALL SELECT b.subgroup, CAST(subgroup_size AS DOUBLE), subgroup_auc, bpsn_auc, bnsp_auc,
    CAST(tp AS DOUBLE), CAST(fp AS DOUBLE), CAST(fn AS DOUBLE), CAST(tn AS DOUBLE)
  FROM bias b LEFT JOIN conf c ON c.subgroup = b.subgroup)
SELECT scope, metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT wide ON {', '.join(_REPORT_METRICS)}
  INTO NAME metric VALUE value)""",
)
def s13_metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bias report as long (scope, metric, value) rows: overall and per group."""
    rep = T.metric_report(M.bias_summary(labelled(spark, sf_dir)))
    return rep.where(F.col("value").isNotNull())
