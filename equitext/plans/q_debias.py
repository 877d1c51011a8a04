"""Queries: debias weight search and application."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.constants import WEIGHT_COLUMNS
from equitext.operators import debias as D
from equitext.operators import embed as E
from equitext.operators import model as Mo
from equitext.operators.profile import any_group
from equitext.plans.oracle import prelude
from equitext.plans.q_profile import GCOLS, _r, labelled
from equitext.plans.registry import query
from equitext.session import scratch_path
from equitext.sources import fixtures as fx
from equitext.sources import tables as T

GATE_THRESHOLD = 0.25  # the published 0.70-0.85 select only the words themselves here


def setup(spark: SparkSession, sf_dir: str):
    """Comments, word vectors, model, directions and the vocabulary bound."""
    df = labelled(spark, sf_dir)
    wv = fx.word_vectors(spark, sf_dir)
    k, dim = fx.embedding_shape(spark, sf_dir)
    model = fx.fixture_model(dim)
    P = E.collect_vector(E.mean_vector_long(wv, fx.word_list(wv, "pleasant")))
    U = E.collect_vector(E.mean_vector_long(wv, fx.word_list(wv, "unpleasant")))
    return df, wv, model, D.Directions(tuple(P), tuple(U)), k


def search_tokens(df: DataFrame, wv: DataFrame) -> DataFrame:
    """Distinct tokens of toxic group rows, minus the direction word lists."""
    stop = fx.word_list(wv, "pleasant").unionByName(fx.word_list(wv, "unpleasant"))
    toks = fx.token_occurrences(df.where(F.col("toxic") & any_group())).select("token").distinct()
    return E.exclude_words(toks, stop, bound_rows=20)


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"


DIRS_SQL = f""", pvec AS (SELECT list(value ORDER BY pos) AS p FROM (SELECT pos, avg(x) AS value FROM (
  SELECT unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM pleasant_words) GROUP BY pos)),
uvec AS (SELECT list(value ORDER BY pos) AS u FROM (SELECT pos, avg(x) AS value FROM (
  SELECT unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM unpleasant_words) GROUP BY pos)),
consts AS (SELECT {_dot('m.w', 'pv.p')} AS zP, {_dot('m.w', 'uv.u')} AS zU,
  {_dot('pv.p', 'pv.p')} AS PP, {_dot('uv.u', 'uv.u')} AS UU, {_dot('pv.p', 'uv.u')} AS PU, pv.p, uv.u
  FROM model m, pvec pv, uvec uv)
"""

_SIG = "1 / (1 + exp(-({z})))"


def accepted_sql(draws: int, gate: bool, narrow: bool, head: str | None = None) -> tuple[str, str]:
    """WITH clause up to ``acc``, the accepted draws, and their order; ``head``
    may replace the views, e.g. by others with a fitted ``model``."""
    head = head or prelude("labelled", "tok", "word_vectors", "pleasant_words", "unpleasant_words",
                           "identity_words", "model").rstrip("\n")
    p0 = _SIG.format(z="z0")
    if narrow:
        toxic_kind = f"{p0} >= 0.9"
        t_band = f"p > 0.6 AND p < 0.8 AND p < {p0}"
        n_band = f"p > 0.00001 AND p <= 0.3 AND p > {p0}"
        key = "CASE WHEN kind = 'toxic' THEN -p ELSE p END"
    else:
        toxic_kind = f"{p0} > 0.9"
        t_band = "p > 0.5 AND p <= 0.9"
        n_band = f"p >= 0.0 AND p <= 0.3 AND p > {p0}"
        key = "p"
    gate_sql = ""
    if gate:
        gate_sql = f""",
iu AS (SELECT list_transform(vec, lambda x: x / n) AS u FROM (
  SELECT vec, sqrt({_dot('vec', 'vec')}) AS n FROM identity_words)),
wn AS (SELECT token, vec, sqrt({_dot('vec', 'vec')}) AS n FROM word_vectors),
sim_tokens AS (SELECT DISTINCT wn.token FROM wn, iu
  WHERE {_dot('list_transform(wn.vec, lambda x: x / wn.n)', 'iu.u')} > {GATE_THRESHOLD})"""
        toxic_kind = f"({toxic_kind}) AND token IN (SELECT token FROM sim_tokens)"
    return head + DIRS_SQL + gate_sql + f""",
toks AS (SELECT DISTINCT t.token FROM tok t SEMI JOIN (SELECT id FROM labelled
  WHERE toxic AND coalesce(greatest({GCOLS}), 0) > 0.5) l ON t.id = l.id
  WHERE t.token NOT IN (SELECT token FROM pleasant_words UNION ALL SELECT token FROM unpleasant_words)),
geo AS (SELECT w.token, {_dot('w.vec', 'm.w')} + m.b AS z0, {_dot('w.vec', 'w.vec')} AS vv,
  {_dot('w.vec', 'k.p')} AS vP, {_dot('w.vec', 'k.u')} AS vU
  FROM word_vectors w JOIN toks USING (token), model m, consts k),
cand AS (SELECT *, CASE WHEN {toxic_kind} THEN 'toxic' WHEN {p0} < 0.1 THEN 'nontoxic' END AS kind FROM geo),
dr AS (SELECT c.*, r.d,
  CAST(('0x' || substr(md5(c.token || ':' || r.d || ':add:666'), 1, 8)) AS BIGINT) / 4294967296.0 AS a,
  CAST(('0x' || substr(md5(c.token || ':' || r.d || ':sub:666'), 1, 8)) AS BIGINT) / 4294967296.0 AS s
  FROM cand c, range(1, {draws + 1}) r(d) WHERE c.kind IS NOT NULL),
coef AS (SELECT *, CASE WHEN kind = 'toxic' THEN a ELSE -s END AS cp,
  CASE WHEN kind = 'toxic' THEN -s ELSE a END AS cu FROM dr),
ev AS (SELECT coef.*, z0 + cp * k.zP + cu * k.zU AS z, {_SIG.format(z='z0 + cp * k.zP + cu * k.zU')} AS p,
  (vv + cp * vP + cu * vU) / (sqrt(vv + cp * cp * k.PP + cu * cu * k.UU + 2 * cp * vP + 2 * cu * vU
   + 2 * cp * cu * k.PU) * sqrt(vv)) AS cos FROM coef, consts k),
acc AS (SELECT * FROM ev WHERE cos >= 0.8 AND CASE WHEN kind = 'toxic' THEN {t_band} ELSE {n_band} END)""", key


def search_sql(draws: int, gate: bool, narrow: bool) -> str:
    head, key = accepted_sql(draws, gate, narrow)
    p0 = _SIG.format(z="z0")
    return head + f""",
best AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY {key} DESC, d) AS rn FROM acc)
SELECT token,
  {_r("CASE WHEN kind = 'toxic' THEN a END", 'add_pleasent')},
  {_r("CASE WHEN kind = 'toxic' THEN s END", 'sub_unpleasent')},
  {_r("CASE WHEN kind = 'nontoxic' THEN s END", 'sub_pleasent')},
  {_r("CASE WHEN kind = 'nontoxic' THEN a END", 'add_unpleasent')},
  {_r(p0, 'p_base')}, {_r('p', 'p_new')}
FROM best WHERE rn = 1"""


@query("m07_debias_search", search_sql(200, gate=False, narrow=False))
def m07_debias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity-gated weight search over the tokens of toxic group rows
    (10 tries x 20 draws per token, best accepted draw kept)."""
    df, wv, model, dirs, k = setup(spark, sf_dir)
    return D.search_weights(search_tokens(df, wv), wv, model, dirs, bound_rows=k)


@query("m08_debias_search_gated", search_sql(200, gate=True, narrow=False))
def m08_debias_search_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity-similarity gate (J7) on the toxic rule; the non-toxic rule
    applies to every very non-toxic token."""
    df, wv, model, dirs, k = setup(spark, sf_dir)
    anchors = [list(r["vec"]) for r in fx.word_list(wv, "identity").orderBy("k").select("vec").collect()]
    sim = D.similar_tokens(wv, anchors, GATE_THRESHOLD)
    return D.search_weights(search_tokens(df, wv), wv, model, dirs, similar=sim, bound_rows=k)


@query("m09_debias_search_narrow", search_sql(500, gate=False, narrow=True))
def m09_debias_search_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 draws, bands (0.6, 0.8) and (1e-5, 0.3], lowest p for toxic words."""
    df, wv, model, dirs, k = setup(spark, sf_dir)
    return D.search_weights(search_tokens(df, wv), wv, model, dirs, D.NARROW, bound_rows=k)


@query(
    "j07_similarity_gate",
    prelude("word_vectors", "identity_words").rstrip("\n")
    + f""", iu AS (SELECT list_transform(vec, lambda x: x / n) AS u FROM (
  SELECT vec, sqrt({_dot('vec', 'vec')}) AS n FROM identity_words)),
wn AS (SELECT token, vec, sqrt({_dot('vec', 'vec')}) AS n FROM word_vectors)
SELECT DISTINCT wn.token FROM wn, iu
WHERE {_dot('list_transform(wn.vec, lambda x: x / wn.n)', 'iu.u')} > {GATE_THRESHOLD}""",
)
def j07_similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary tokens whose cosine to any identity word exceeds 0.25."""
    wv = fx.word_vectors(spark, sf_dir)
    anchors = [list(r["vec"]) for r in fx.word_list(wv, "identity").orderBy("k").select("vec").collect()]
    return D.similar_tokens(wv, anchors, GATE_THRESHOLD)


def apply_tail(scope: str, with_scores: bool = False) -> str:
    """CTEs that apply the ``weights`` relation in ``scope``, and the query."""
    scores = ""
    if with_scores:
        scores = f""",
token_scores AS (SELECT token, {_dot('vec', 'm.w')} AS s FROM word_vectors, model m)"""
    return scores + f""",
adj AS (SELECT ts.token, ts.s, ts.s
  + CASE WHEN w.add_pleasent IS NOT NULL AND w.sub_unpleasent IS NOT NULL
    THEN w.add_pleasent * k.zP - w.sub_unpleasent * k.zU ELSE 0.0 END
  + CASE WHEN w.sub_pleasent IS NOT NULL AND w.add_unpleasent IS NOT NULL
    THEN w.add_unpleasent * k.zU - w.sub_pleasent * k.zP ELSE 0.0 END AS s_adj
  FROM token_scores ts LEFT JOIN weights w ON ts.token = w.token, consts k),
scope AS (SELECT id, ({scope}) AS sc FROM labelled),
per AS (SELECT t.id, count(*) AS n_known, (CAST(sum(CAST(round((CASE WHEN sc.sc THEN a.s_adj ELSE a.s END) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 / count(CASE WHEN sc.sc THEN a.s_adj ELSE a.s END)) AS z
  FROM tok t JOIN adj a ON t.token = a.token JOIN scope sc ON sc.id = t.id GROUP BY t.id)
SELECT l.id, CAST(coalesce(per.n_known, 0) AS BIGINT) AS n_known,
  {_r(_SIG.format(z='coalesce(per.z, 0.0) + m.b'), 'pred')}
FROM labelled l LEFT JOIN per ON per.id = l.id, model m"""


def apply_sql(scope: str) -> str:
    head = prelude("labelled", "tok", "word_vectors", "pleasant_words", "unpleasant_words", "model",
                   "token_scores", "weights").rstrip("\n")
    return head + DIRS_SQL + apply_tail(scope)


SCOPES_SQL = {
    "group_toxic": f"toxic AND coalesce(greatest({GCOLS}), 0) > 0.5",
    "toxic": "toxic",
    "all": "true",
    "nontoxic": "NOT toxic",
}


def scope_column(scope: str) -> Column:
    return {
        "group_toxic": F.col("toxic") & any_group(),
        "toxic": F.col("toxic"),
        "all": F.lit(True),
        "nontoxic": ~F.col("toxic"),
    }[scope]


def apply_weights(spark: SparkSession, sf_dir: str, scope: str, weights: DataFrame | None = None) -> DataFrame:
    df, wv, model, dirs, k = setup(spark, sf_dir)
    weights = weights if weights is not None else fx.fixture_weights(wv)
    adj = D.adjusted_scores(Mo.token_scores(wv, model), weights, model, dirs)
    return D.score_with_weights(df, adj, model.bias, scope_column(scope), bound_rows=k)


@query("m10_apply_weights_group_toxic", apply_sql(SCOPES_SQL["group_toxic"]))
def m10_apply_weights_group_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted features for toxic rows in some group (training features)."""
    return apply_weights(spark, sf_dir, "group_toxic")


@query("m11_apply_weights_toxic", apply_sql(SCOPES_SQL["toxic"]))
def m11_apply_weights_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted features for every toxic row."""
    return apply_weights(spark, sf_dir, "toxic")


@query("m12_apply_weights_all", apply_sql(SCOPES_SQL["all"]))
def m12_apply_weights_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted features for every row (test-time debias)."""
    return apply_weights(spark, sf_dir, "all")


@query("m25_apply_weights_nontoxic", apply_sql(SCOPES_SQL["nontoxic"]))
def m25_apply_weights_nontoxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted features for non-toxic rows."""
    return apply_weights(spark, sf_dir, "nontoxic")


@query(
    "s11_weights_json",
    prelude("weights")
    + f"SELECT token, {', '.join(_r(c, c) for c in WEIGHT_COLUMNS)} FROM weights",
)
def s11_weights_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights written as one JSON object per token (absent keys omitted)
    and read back."""
    path = scratch_path(spark, f"weights-{uuid.uuid4().hex}")
    T.write_weights(fx.fixture_weights(fx.word_vectors(spark, sf_dir)), path)
    return T.read_weights(spark, path)


@query(
    "m12_searched_weights_applied",
    search_sql(200, gate=True, narrow=False).rsplit("SELECT token,", 1)[0].rstrip()
    + """,
weights AS (SELECT token, CASE WHEN kind = 'toxic' THEN a END AS add_pleasent,
  CASE WHEN kind = 'toxic' THEN s END AS sub_unpleasent, CASE WHEN kind = 'nontoxic' THEN s END AS sub_pleasent,
  CASE WHEN kind = 'nontoxic' THEN a END AS add_unpleasent FROM best WHERE rn = 1)"""
    + apply_tail("true", with_scores=True),
)
def m12_searched_weights_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched weights (similarity-gated), written as JSON, read back and
    applied to every row."""
    path = scratch_path(spark, f"weights-{uuid.uuid4().hex}")
    T.write_weights(m08_debias_search_gated(spark, sf_dir), path)
    return apply_weights(spark, sf_dir, "all", T.read_weights(spark, path))
