"""Queries: dataset profile and bias metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.constants import GROUPS
from equitext.operators import metrics as M
from equitext.operators import profile as P
from equitext.plans.oracle import prelude
from equitext.plans.registry import query
from equitext.sources import fixtures as fx

GCOLS = ", ".join(GROUPS)
GROUP_VALUES = "(VALUES " + ", ".join(f"('{g}')" for g in GROUPS) + ") gv(subgroup)"
MEMBERSHIPS = (
    "memberships",
    f"""SELECT id, toxic, pred, length(comment_text) AS length, subgroup, gscore FROM (
  UNPIVOT (SELECT id, toxic, pred, comment_text, {GCOLS} FROM labelled)
  ON {GCOLS} INTO NAME subgroup VALUE gscore)""",
)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment view with ``toxic``."""
    return P.binarise(fx.comments(spark, sf_dir))


def _with(extra_sql: str, *views: str, memberships: bool = False) -> str:
    """Prelude + raw CTE text (already 'name AS (...)' formatted)."""
    head = prelude(*views, extra=[MEMBERSHIPS] if memberships else None)
    return head.rstrip("\n") + ",\n" + extra_sql + "\n"


def _r(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {alias}"


# ---------------------------------------------------------------------------
# S1 / P1 / P2 / P3 / P8
# ---------------------------------------------------------------------------


@query(
    "s01_comment_scan",
    prelude("labelled")
    + f"""SELECT id, CAST(length(comment_text) AS BIGINT) AS length, toxic,
  {_r('target', 'target')}, coalesce(greatest({GCOLS}), 0) > 0.5 AS in_any_group,
  {_r('pred', 'pred')}
FROM labelled""",
)
def s01_comment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment scan with derived label, length and any-group flag."""
    df = P.with_length(labelled(spark, sf_dir))
    return df.select("id", "length", "toxic", "target", P.any_group().alias("in_any_group"),
                     M.nan_to_null("pred").alias("pred"))


# ---------------------------------------------------------------------------
# A1 / A24 class balance
# ---------------------------------------------------------------------------


@query(
    "a01_class_balance",
    prelude("labelled")
    + f"""SELECT count(*) AS n, count(*) FILTER (WHERE toxic) AS n_toxic,
  {_r('count(*) FILTER (WHERE toxic) / count(*)', 'fraction_toxic')}
FROM labelled""",
)
def a01_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.class_balance(labelled(spark, sf_dir))


# ---------------------------------------------------------------------------
# A2 group prevalence
# ---------------------------------------------------------------------------


@query(
    "a02_group_prevalence",
    prelude("labelled", extra=[MEMBERSHIPS])
    + f""", tot AS (SELECT count(*) AS total FROM labelled),
agg AS (SELECT subgroup, count(*) FILTER (WHERE gscore > 0.5) AS n,
  count(*) FILTER (WHERE gscore > 0.5 AND toxic) AS n_toxic FROM memberships GROUP BY subgroup)
SELECT gv.subgroup, coalesce(a.n, 0) AS n, coalesce(a.n_toxic, 0) AS n_toxic,
  {_r('100.0 * coalesce(a.n, 0) / tot.total', 'pct_of_all')},
  {_r('CASE WHEN coalesce(a.n, 0) > 0 THEN 100.0 * a.n_toxic / a.n END', 'pct_toxic_in_group')},
  {_r('100.0 * coalesce(a.n_toxic, 0) / tot.total', 'pct_toxic_of_all')}
FROM {GROUP_VALUES} LEFT JOIN agg a ON a.subgroup = gv.subgroup, tot""",
)
def a02_group_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each group is present and toxic (one scan)."""
    return P.group_prevalence(labelled(spark, sf_dir))


@query(
    "a03_group_toxic_counts",
    prelude("labelled", extra=[MEMBERSHIPS])
    + """SELECT subgroup, toxic, count(*) AS n FROM memberships WHERE gscore > 0.5
GROUP BY subgroup, toxic""",
)
def a03_group_toxic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.group_toxic_counts(labelled(spark, sf_dir))


_KW_ROWS = ", ".join(
    f"('{g}', {k})" for g, ks in fx.KEYWORD_POSITIONS.items() for k in ks
)


@query(
    "a04_keyword_class_balance",
    prelude("labelled", "identity_words")
    + f""", kwpos AS (SELECT * FROM (VALUES {_KW_ROWS}) t(subgroup, k)),
kw AS (SELECT p.subgroup, '(?i)' || string_agg(w.token, '|' ORDER BY p.k) AS pat
  FROM kwpos p JOIN identity_words w ON w.k = p.k GROUP BY p.subgroup)
SELECT kw.subgroup, count(l.id) AS n, count(l.id) FILTER (WHERE l.toxic) AS n_toxic,
  {_r('CASE WHEN count(l.id) > 0 THEN 100.0 * count(l.id) FILTER (WHERE l.toxic) / count(l.id) END', 'pct_toxic')}
FROM kw LEFT JOIN labelled l ON regexp_matches(l.comment_text, kw.pat)
GROUP BY kw.subgroup""",
)
def a04_keyword_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class balance of rows found by keyword search in the text."""
    df = labelled(spark, sf_dir)
    kmap = fx.keyword_map(fx.word_vectors(spark, sf_dir))
    return P.keyword_class_balance(df, kmap)


@query(
    "p05_length_filtered_balance",
    prelude("labelled", extra=[MEMBERSHIPS])
    + """SELECT subgroup, count(*) AS n, count(*) FILTER (WHERE toxic) AS n_toxic
FROM memberships WHERE gscore > 0.5 AND length <= 2000 GROUP BY subgroup""",
)
def p05_length_filtered_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + P5: group rows with text length <= 2000."""
    df = P.with_length(labelled(spark, sf_dir))
    long = M.group_memberships(df, keep=["id", "toxic", "length"]).where(F.col("gscore") > 0.5)
    parts = P.identity_filter(long, None, max_length=2000)
    return parts.groupBy("subgroup").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("n_toxic")
    )


@query(
    "p06_keyword_filter",
    prelude("labelled", "identity_words")
    + """, kw AS (SELECT '(?i)' || string_agg(token, '|' ORDER BY k) AS pat FROM identity_words WHERE k IN (3, 5, 7))
SELECT l.id, CAST(length(l.comment_text) AS BIGINT) AS length FROM labelled l, kw
WHERE regexp_matches(l.comment_text, kw.pat) """,
)
def p06_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-list filter (composite group's three words)."""
    df = P.with_length(labelled(spark, sf_dir))
    words = fx.keyword_map(fx.word_vectors(spark, sf_dir))[fx.GROUPS[3]]
    return P.keyword_filter(df, words).select("id", "length")


# ---------------------------------------------------------------------------
# U1 / U2 / U3 / P13 / P14
# ---------------------------------------------------------------------------


@query(
    "u02_bag_union",
    prelude("labelled", extra=[MEMBERSHIPS])
    + "SELECT id, subgroup FROM memberships WHERE gscore > 0.5",
)
def u02_bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every group; a row in k groups appears k times."""
    return P.bag_union(labelled(spark, sf_dir))


@query(
    "u01_distinct_union",
    prelude("labelled", extra=[MEMBERSHIPS])
    + "SELECT DISTINCT id FROM memberships WHERE gscore > 0.5",
)
def u01_distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union of the per-group row-id sets."""
    # One scan: the bag union's ids, de-duplicated (not nine filtered scans).
    return P.distinct_union(P.bag_union(labelled(spark, sf_dir)).select("id"))


@query(
    "u03_segments",
    prelude("labelled", extra=[MEMBERSHIPS])
    + """SELECT subgroup, CASE WHEN gscore > 0.5 AND toxic THEN 'sub_pos'
  WHEN gscore > 0.5 THEN 'sub_neg' WHEN toxic THEN 'bg_pos' ELSE 'bg_neg' END AS segment,
  count(*) AS n FROM memberships GROUP BY ALL""",
)
def u03_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the four disjoint segments per group (one scan)."""
    df = labelled(spark, sf_dir)
    long = M.group_memberships(df, keep=["id", "toxic"])
    seg = P.segment_flags(long.withColumnRenamed("gscore", "g"), "g")
    return seg.groupBy("subgroup", "segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_false_positives",
    prelude("labelled", extra=[MEMBERSHIPS])
    + "SELECT id, subgroup FROM memberships WHERE gscore > 0.5 AND pred > 0.5 AND NOT toxic",
)
def p13_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives listed per group."""
    return P.false_positives(labelled(spark, sf_dir))


@query(
    "p14_error_rows",
    prelude("labelled")
    + """SELECT id, CASE WHEN pred > 0.5 THEN 'fp' ELSE 'fn' END AS error FROM labelled
WHERE (pred > 0.5) <> toxic""",
)
def p14_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives and false negatives."""
    return P.error_rows(labelled(spark, sf_dir)).select("id", "error")


# ---------------------------------------------------------------------------
# A5-A8 confusion and rates
# ---------------------------------------------------------------------------

_RATES = f"""{_r('(tp + tn) / n', 'accuracy')}, {_r('100.0 * (tp + fp) / n', 'acceptance_rate')},
  {_r('CASE WHEN tp + fn > 0 THEN 100.0 * tp / (tp + fn) END', 'tpr')},
  {_r('CASE WHEN tn + fp > 0 THEN 100.0 * tn / (tn + fp) END', 'tnr')},
  {_r('CASE WHEN fn + tp > 0 THEN 100.0 * fn / (fn + tp) END', 'fnr')},
  {_r('CASE WHEN fp + tn > 0 THEN 100.0 * fp / (fp + tn) END', 'fpr')}"""

_COUNTS = """count(*) AS n,
  count(*) FILTER (WHERE pred > 0.5 AND toxic) AS tp,
  count(*) FILTER (WHERE pred > 0.5 AND NOT toxic) AS fp,
  count(*) FILTER (WHERE NOT pred > 0.5 AND toxic) AS fn,
  count(*) FILTER (WHERE NOT pred > 0.5 AND NOT toxic) AS tn"""


@query(
    "a05_overall_confusion",
    prelude("labelled")
    + f"SELECT n, tp, fp, fn, tn, {_RATES} FROM (SELECT {_COUNTS} FROM labelled WHERE pred IS NOT NULL)",
)
def a05_overall_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[[TP, FP], [FN, TN]], accuracy, acceptance rate, TPR, TNR, FNR, FPR."""
    return M.with_rates(M.confusion_counts(labelled(spark, sf_dir)))


@query(
    "a05_subgroup_confusion",
    prelude("labelled", extra=[MEMBERSHIPS])
    + f"""SELECT subgroup, n, tp, fp, fn, tn, {_RATES} FROM (SELECT subgroup, {_COUNTS}
FROM memberships WHERE gscore > 0.5 AND pred IS NOT NULL GROUP BY subgroup)""",
)
def a05_subgroup_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.subgroup_confusion(labelled(spark, sf_dir))


# ---------------------------------------------------------------------------
# A9-A15 AUCs, power mean, final metric, report
# ---------------------------------------------------------------------------

OVERALL_AUC_SQL = """overall_sc AS (SELECT pred AS score, count(*) FILTER (WHERE toxic) AS pos,
  count(*) FILTER (WHERE NOT toxic) AS neg FROM labelled WHERE pred IS NOT NULL GROUP BY pred),
overall_cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM overall_sc),
overall_auc AS (SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  CAST(sum(pos * (nb + neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auc
  FROM overall_cum)"""

BIAS_AUC_SQL = """gsc AS (SELECT subgroup, pred AS score,
  count(*) FILTER (WHERE gscore > 0.5 AND toxic) AS sub_pos,
  count(*) FILTER (WHERE gscore > 0.5 AND NOT toxic) AS sub_neg,
  count(*) FILTER (WHERE gscore <= 0.5 AND toxic) AS bg_pos,
  count(*) FILTER (WHERE gscore <= 0.5 AND NOT toxic) AS bg_neg
  FROM memberships WHERE pred IS NOT NULL GROUP BY subgroup, pred),
gcum AS (SELECT *,
  coalesce(sum(sub_neg) OVER w, 0) AS sub_nb, coalesce(sum(bg_neg) OVER w, 0) AS bg_nb
  FROM gsc WINDOW w AS (PARTITION BY subgroup ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gagg AS (SELECT subgroup, sum(sub_pos) AS sp, sum(sub_neg) AS sn, sum(bg_pos) AS bp, sum(bg_neg) AS bn,
  sum(sub_pos * (sub_nb + sub_neg / 2.0)) AS n_sub,
  sum(bg_pos * (sub_nb + sub_neg / 2.0)) AS n_bpsn,
  sum(sub_pos * (bg_nb + bg_neg / 2.0)) AS n_bnsp FROM gcum GROUP BY subgroup),
bias AS (SELECT gv.subgroup, CAST(coalesce(sp + sn, 0) AS BIGINT) AS subgroup_size,
  CASE WHEN sp * sn > 0 THEN CAST(n_sub AS DOUBLE) / CAST(sp * sn AS DOUBLE) END AS subgroup_auc,
  CASE WHEN bp * sn > 0 THEN CAST(n_bpsn AS DOUBLE) / CAST(bp * sn AS DOUBLE) END AS bpsn_auc,
  CASE WHEN sp * bn > 0 THEN CAST(n_bnsp AS DOUBLE) / CAST(sp * bn AS DOUBLE) END AS bnsp_auc
  FROM """ + GROUP_VALUES + """ LEFT JOIN gagg g ON g.subgroup = gv.subgroup)"""


@query(
    "a09_overall_auc",
    _with(OVERALL_AUC_SQL, "labelled") + f"SELECT n_pos, n_neg, {_r('auc', 'auc')} FROM overall_auc",
)
def a09_overall_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-aware ROC AUC of all rows."""
    return M.auc(labelled(spark, sf_dir))


_BIAS_COLS = f"""subgroup, subgroup_size, {_r('subgroup_auc', 'subgroup_auc')},
  {_r('bpsn_auc', 'bpsn_auc')}, {_r('bnsp_auc', 'bnsp_auc')}"""


@query(
    "a10_a12_bias_aucs",
    _with(BIAS_AUC_SQL, "labelled", memberships=True) + f"SELECT {_BIAS_COLS} FROM bias",
)
def a10_a12_bias_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgroup, BPSN and BNSP AUC and subgroup size per group (one scan)."""
    return M.bias_aucs(labelled(spark, sf_dir))


_PM = """pm AS (SELECT power(avg(power(subgroup_auc, -5.0)), -0.2) AS pm_subgroup_auc,
  power(avg(power(bpsn_auc, -5.0)), -0.2) AS pm_bpsn_auc,
  power(avg(power(bnsp_auc, -5.0)), -0.2) AS pm_bnsp_auc FROM bias)"""


@query(
    "a13_power_means",
    _with(BIAS_AUC_SQL + ",\n" + _PM, "labelled", memberships=True)
    + f"SELECT {_r('pm_subgroup_auc', 'pm_subgroup_auc')}, {_r('pm_bpsn_auc', 'pm_bpsn_auc')}, "
    f"{_r('pm_bnsp_auc', 'pm_bnsp_auc')} FROM pm",
)
def a13_power_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised power mean (p = -5) of each AUC column."""
    return M.power_means(M.bias_aucs(labelled(spark, sf_dir)))


@query(
    "a14_final_metric",
    _with(OVERALL_AUC_SQL + ",\n" + BIAS_AUC_SQL + ",\n" + _PM, "labelled", memberships=True)
    + f"""SELECT {_r('o.auc', 'overall_auc')}, {_r('pm_subgroup_auc', 'pm_subgroup_auc')},
  {_r('pm_bpsn_auc', 'pm_bpsn_auc')}, {_r('pm_bnsp_auc', 'pm_bnsp_auc')},
  {_r('0.25 * o.auc + 0.75 * (pm_subgroup_auc + pm_bpsn_auc + pm_bnsp_auc) / 3', 'final_metric')}
FROM overall_auc o, pm""",
)
def a14_final_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.25 x overall AUC + 0.75 x mean of the three power means."""
    return M.final_from_summary(M.bias_summary(labelled(spark, sf_dir)))


@query(
    "m18_bias_report",
    _with(BIAS_AUC_SQL, "labelled", memberships=True)
    + f""", conf AS (SELECT subgroup, n, tp, fp, fn, tn, {_RATES} FROM (SELECT subgroup, {_COUNTS}
FROM memberships WHERE gscore > 0.5 AND pred IS NOT NULL GROUP BY subgroup))
SELECT {_BIAS_COLS.replace('subgroup,', 'b.subgroup,', 1)}, tp, fp, fn, tn, accuracy, acceptance_rate, tpr, tnr, fnr, fpr
FROM bias b LEFT JOIN conf c ON b.subgroup = c.subgroup""",
)
def m18_bias_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full per-group bias report sorted by subgroup AUC."""
    return M.bias_report(labelled(spark, sf_dir))
