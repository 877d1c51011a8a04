"""Queries: tries per document, carried weights, debiased training features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.constants import WEIGHT_COLUMNS
from equitext.operators import debias as D
from equitext.operators import tries as Tr
from equitext.operators.profile import any_group
from equitext.plans.q_debias import (
    _SIG,
    DIRS_SQL,
    SCOPES_SQL,
    _dot,
    accepted_sql,
    scope_column,
    search_tokens,
    setup,
)
from equitext.plans.oracle import prelude
from equitext.plans.q_profile import GCOLS, _r
from equitext.plans.registry import query
from equitext.sources import fixtures as fx

_DRAWS = D.SearchParams().draws
_PER_TRY = _DRAWS // Tr.TRIES

#: per token and try the chosen draw, the logits, and the searched documents
_TRIES_SQL = accepted_sql(_DRAWS, gate=False, narrow=False)[0] + f""",
bt AS (SELECT * FROM (SELECT *, (d - 1) // {_PER_TRY} + 1 AS t,
  row_number() OVER (PARTITION BY token, (d - 1) // {_PER_TRY} ORDER BY p DESC, d) AS rn FROM acc) WHERE rn = 1),
bb AS (SELECT * FROM (SELECT token, z, row_number() OVER (PARTITION BY token ORDER BY p DESC, d) AS rn FROM acc) WHERE rn = 1),
vz AS (SELECT token, {_dot('vec', 'm.w')} + m.b AS z0 FROM word_vectors, model m),
u AS (SELECT v.token, r.t, CAST(round(coalesce(bt.z, v.z0) * 1e12) AS BIGINT) AS u, bt.token IS NOT NULL AS ok,
  CAST(round(coalesce(bb.z, v.z0) * 1e12) AS BIGINT) AS ub, v.token IN (SELECT token FROM cand WHERE kind IS NOT NULL) AS open
  FROM vz v CROSS JOIN range(1, {Tr.TRIES + 1}) r(t) LEFT JOIN bt ON bt.token = v.token AND bt.t = r.t
  LEFT JOIN bb ON bb.token = v.token),
od AS (SELECT id FROM labelled WHERE {SCOPES_SQL['group_toxic']})"""

_WINNER_SQL = _TRIES_SQL + f""",
per AS (SELECT k.id, u.t, count(*) AS n, CAST(sum(u.u) AS DOUBLE) / 1e12 / count(*) AS z,
  CAST(sum(u.ub) AS DOUBLE) / 1e12 / count(*) AS zb FROM tok k JOIN od USING (id) JOIN u ON u.token = k.token GROUP BY k.id, u.t),
pr AS (SELECT id, t, n, {_SIG.format(z='z')} AS p, {_SIG.format(z='zb')} AS pb FROM per),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, t) AS rn FROM pr) WHERE rn = 1)"""


def _weights_sql(kind: str, a: str, s: str) -> str:
    cells = [("toxic", a), ("toxic", s), ("nontoxic", s), ("nontoxic", a)]
    return ", ".join(_r(f"CASE WHEN {kind} = '{k}' THEN {x} END", c) for (k, x), c in zip(cells, WEIGHT_COLUMNS))


def _searched(spark: SparkSession, sf_dir: str):
    """Toxic group rows, the try table over their tokens and the model."""
    df, wv, model, dirs, k = setup(spark, sf_dir)
    table = Tr.try_table(search_tokens(df, wv), wv, model, dirs, bound_rows=k)
    return df.where(F.col("toxic") & any_group()), table, model, k


@query(
    "o04_best_try",
    _WINNER_SQL + f"""
SELECT od.id, CAST(coalesce(win.n, 0) AS BIGINT) AS n_known, CAST(coalesce(win.t, 1) AS INTEGER) AS best_try,
  {_r(f"coalesce(win.p, {_SIG.format(z='m.b')})", 'pred')},
  {_r(f"coalesce(win.pb, {_SIG.format(z='m.b')})", 'pred_token_best')}
FROM od LEFT JOIN win USING (id), model m""",
)
def o04_best_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of ten tries of 20 draws per toxic group comment, with the
    probability that the best draw of every single token would give."""
    docs, table, model, k = _searched(spark, sf_dir)
    return Tr.best_try(docs, table, model.bias, bound_rows=k)


@query(
    "o04_try_weights",
    _WINNER_SQL + f"""
SELECT w.id, bt.token, CAST(w.t AS INTEGER) AS best_try, {_weights_sql('bt.kind', 'bt.a', 'bt.s')}
FROM win w JOIN (SELECT DISTINCT id, token FROM tok) k ON k.id = w.id JOIN bt ON bt.token = k.token AND bt.t = w.t""",
)
def o04_try_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the winning try, per comment and token."""
    docs, table, model, k = _searched(spark, sf_dir)
    winners = Tr.best_try(docs, table, model.bias, bound_rows=k)
    return Tr.try_weights(docs, winners, table, bound_rows=k)


_CARRIED_SQL = _TRIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ul AS (SELECT token, list(u ORDER BY t) AS us, list(ok ORDER BY t) AS oks, bool_or(open) AS open FROM u GROUP BY token),
pairs AS (SELECT id, token, count(*) AS cnt FROM tok JOIN od USING (id) GROUP BY id, token),
dd AS (SELECT id, row_number() OVER (ORDER BY id) AS k, sum(p.cnt) AS n,
  list(struct_pack(token := p.token, cnt := p.cnt, us := ul.us, oks := ul.oks, open := ul.open) ORDER BY p.token) AS toks
  FROM pairs p JOIN ul USING (token) GROUP BY id),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, 0 AS t, CAST([] AS VARCHAR[]) AS new,
    MAP(CAST([] AS VARCHAR[]), CAST([] AS INTEGER[])) AS st
  UNION ALL
  SELECT k, id, t, new, map_concat(st, map_from_entries(list_transform(new, lambda x: (x, t)))) FROM (
    SELECT k, id, t, st, list_transform(list_filter(toks, lambda x: x.oks[t] AND NOT map_contains(st, x.token)), lambda x: x.token) AS new
    FROM (SELECT k, id, st, toks, CAST(list_position(ps, list_max(ps)) AS INTEGER) AS t FROM (
      SELECT d.k, d.id, w.st, d.toks, list_transform(range(1, {Tr.TRIES + 1}), lambda t: 1 / (1 + exp(-(CAST(list_sum(
        list_transform(d.toks, lambda x: x.cnt * x.us[CASE WHEN map_contains(w.st, x.token)
          THEN map_extract(w.st, x.token)[1] ELSE t END])) AS DOUBLE) / 1e12 / d.n)))) AS ps
      FROM walk w JOIN dd d ON d.k = w.k + 1))))
SELECT f.token, f.id AS writer, f.t AS best_try, {_weights_sql('bt.kind', 'bt.a', 'bt.s')}
FROM (SELECT id, t, unnest(new) AS token FROM walk) f JOIN bt ON bt.token = f.token AND bt.t = f.t"""


@query("m07_carried_weights", _CARRIED_SQL)
def m07_carried_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight table carried through the toxic group comments in id order:
    the first comment whose winning try accepts a draw fixes a token's weights."""
    docs, table, model, k = _searched(spark, sf_dir)
    return Tr.carried_weights(docs, table, model.bias, bound_rows=k)


def _features_sql(scope: str) -> str:
    head = prelude("labelled", "tok", "word_vectors", "pleasant_words", "unpleasant_words", "model", "weights").rstrip("\n")
    return head + DIRS_SQL + f""",
sh AS (SELECT token, CASE WHEN add_pleasent IS NOT NULL AND sub_unpleasent IS NOT NULL THEN add_pleasent ELSE 0.0 END
    - CASE WHEN sub_pleasent IS NOT NULL AND add_unpleasent IS NOT NULL THEN sub_pleasent ELSE 0.0 END AS al,
  CASE WHEN sub_pleasent IS NOT NULL AND add_unpleasent IS NOT NULL THEN add_unpleasent ELSE 0.0 END
    - CASE WHEN add_pleasent IS NOT NULL AND sub_unpleasent IS NOT NULL THEN sub_unpleasent ELSE 0.0 END AS be FROM weights),
-- every occurrence's own vector: no rank-two update on this side
vv AS (SELECT w.token, w.vec, list_transform(range(1, 65), lambda i: w.vec[i] + coalesce(sh.al, 0.0) * k.p[i]
  + coalesce(sh.be, 0.0) * k.u[i]) AS moved, coalesce(sh.al, 0.0) AS al, coalesce(sh.be, 0.0) AS be
  FROM word_vectors w LEFT JOIN sh USING (token), consts k),
occ AS (SELECT t.id, CASE WHEN {scope} THEN moved ELSE vec END AS v, CASE WHEN {scope} THEN al ELSE 0.0 END AS al,
  CASE WHEN {scope} THEN be ELSE 0.0 END AS be FROM tok t JOIN labelled l USING (id) JOIN vv USING (token)),
f AS (SELECT id, pos, count(*) AS n, avg(al) AS al, avg(be) AS be, avg(v[pos]) AS x FROM occ, range(1, 65) r(pos) GROUP BY id, pos),
g AS (SELECT id, max(n) AS n, max(al) AS al, max(be) AS be, sum(x * pos) AS weighted, sqrt(sum(x * x)) AS norm FROM f GROUP BY id)
SELECT l.id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_known, {_r('coalesce(g.al * g.n, 0.0)', 'alpha_sum')}, {_r('coalesce(g.be * g.n, 0.0)', 'beta_sum')},
  {_r('coalesce(g.weighted, 0.0)', 'weighted_sum')}, {_r('coalesce(g.norm, 0.0)', 'norm')}
FROM labelled l LEFT JOIN g USING (id)"""


def features(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    """Training features with the given weights in ``scope``; a vector is shown
    by its norm and by the sum of its elements times their positions."""
    from equitext.functions import vectors as V

    df, wv, model, dirs, k = setup(spark, sf_dir)
    f = D.debiased_features(df, wv, fx.fixture_weights(wv), dirs, scope_column(scope), bound_rows=k, chars=lambda: fx.text_chars(spark, sf_dir))
    places = V.literal([float(i) for i in range(1, len(dirs.pleasant) + 1)])
    sums = [(F.col(c) * F.col("n_known")).alias(f"{c}_sum") for c in ("alpha", "beta")]
    return f.select("id", "n_known", *sums, V.dot("vec", places).alias("weighted_sum"), V.norm("vec").alias("norm"))


@query("m10_features_group_toxic", _features_sql(SCOPES_SQL["group_toxic"]))
def m10_features_group_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training features, weights on toxic rows in some group."""
    return features(spark, sf_dir, "group_toxic")


@query("m11_features_toxic", _features_sql(SCOPES_SQL["toxic"]))
def m11_features_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training features, weights on every toxic row."""
    return features(spark, sf_dir, "toxic")


@query("m25_features_nontoxic", _features_sql(SCOPES_SQL["nontoxic"]))
def m25_features_nontoxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training features, weights on non-toxic rows."""
    return features(spark, sf_dir, "nontoxic")
