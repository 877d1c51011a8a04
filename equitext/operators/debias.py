"""Word-level debias weights: search (M7-M9, J7, J8, W3) and application
(M10-M12, M25, J6).

A candidate replacement of token vector v is v + a*A + c*B for the
"pleasant" direction P and the "unpleasant" direction U.  The model is
linear, so for every random draw only scalars are needed:

    z(cand)   = w.v + b + a*(w.A) + c*(w.B)
    cand . v  = v.v + a*(v.A) + c*(v.B)
    |cand|^2  = v.v + a^2 A.A + c^2 B.B + 2a v.A + 2c v.B + 2ac A.B

Each token needs six dot products (v.v, v.P, v.U and the constant P.P,
U.U, P.U); draws are elements of an array in the token's row with md5-seeded
uniforms, so results do not depend on partitioning or row order; the best
accepted draw per token is an ``array_max`` over structs (no window, no sort,
no shuffle).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitext.constants import (
    NARROW_DRAWS,
    NARROW_NONTOXIC_BAND,
    NARROW_TOXIC_BAND,
    SEARCH_DRAWS,
    SEARCH_HIGH,
    SEARCH_LOW,
    SEARCH_MIN_COS,
    SEARCH_NONTOXIC_BAND,
    SEARCH_TOXIC_BAND,
    WEIGHT_COLUMNS,
)
from equitext.functions import vectors as V
from equitext.functions.text import word_tokens
from equitext.operators.joins import fits, lookup_join
from equitext.operators.model import exact_mean
from equitext.sources.fixtures import LinearModel


@dataclass(frozen=True)
class Directions:
    """The two directions (driver-side, bounded by the dimension)."""

    pleasant: tuple[float, ...]
    unpleasant: tuple[float, ...]


@dataclass(frozen=True)
class SearchParams:
    draws: int = SEARCH_DRAWS
    high: float = SEARCH_HIGH
    low: float = SEARCH_LOW
    toxic_band: tuple[float, float] = SEARCH_TOXIC_BAND      # (lo, hi]
    nontoxic_band: tuple[float, float] = SEARCH_NONTOXIC_BAND  # [lo, hi]
    min_cos: float = SEARCH_MIN_COS
    toxic_pick: str = "highest"      # or "lowest" (narrow variant)
    toxic_below_base: bool = False   # narrow variant: accepted p < base p
    high_inclusive: bool = False     # narrow variant: base p >= high
    toxic_band_closed_hi: bool = True
    nontoxic_band_open_lo: bool = False
    seed: int = 666


NARROW = SearchParams(
    draws=NARROW_DRAWS,
    toxic_band=NARROW_TOXIC_BAND,
    nontoxic_band=NARROW_NONTOXIC_BAND,
    toxic_pick="lowest",
    toxic_below_base=True,
    high_inclusive=True,
    toxic_band_closed_hi=False,
    nontoxic_band_open_lo=True,
)


def draw(token: Column, d: Column, which: str, seed: int) -> Column:
    """Uniform [0, 1) from md5(token:draw:which:seed)."""
    h = F.md5(F.concat_ws(":", token, d.cast("string"), F.lit(which), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def token_geometry(vectors: DataFrame, model: LinearModel, dirs: Directions) -> DataFrame:
    """(token, z0, vv, vP, vU): base logit and dot products per token."""
    P, U = V.literal(dirs.pleasant), V.literal(dirs.unpleasant)
    return vectors.select(
        "token",
        (V.dot("vec", V.literal(model.weights)) + F.lit(model.bias)).alias("z0"),
        V.dot("vec", "vec").alias("vv"),
        V.dot("vec", P).alias("vP"),
        V.dot("vec", U).alias("vU"),
    )


def _consts(model: LinearModel, dirs: Directions) -> dict[str, float]:
    P, U, w = dirs.pleasant, dirs.unpleasant, model.weights
    dot = lambda a, b: float(sum(x * y for x, y in zip(a, b)))
    return {"zP": dot(w, P), "zU": dot(w, U), "PP": dot(P, P), "UU": dot(U, U), "PU": dot(P, U)}


def search_candidates(
    tokens: DataFrame,
    vectors: DataFrame,
    model: LinearModel,
    dirs: Directions,
    params: SearchParams,
    similar: DataFrame | None = None,
    bound_rows: int | None = None,
) -> DataFrame:
    """(token, z0, vv, vP, vU, p0, kind) for the tokens that a rule applies to;
    ``kind`` is "toxic" or "nontoxic"."""
    geo = lookup_join(tokens.select("token").distinct(), token_geometry(vectors, model, dirs), "token",
                      bound_rows=bound_rows)
    gate = F.lit(True)
    if similar is not None:
        geo = geo.join(similar.select("token", F.lit(True).alias("_sim")), "token", "left")
        gate = F.coalesce("_sim", F.lit(False))
    p0 = F.col("p0")
    hi = (p0 >= params.high) if params.high_inclusive else (p0 > params.high)
    kind = F.when(hi & gate, F.lit("toxic")).when(p0 < params.low, F.lit("nontoxic"))
    geo = geo.withColumn("p0", V.sigmoid(F.col("z0"))).withColumn("kind", kind)
    return geo.where(F.col("kind").isNotNull()).select("token", "z0", "vv", "vP", "vU", "p0", "kind")


def best_draws(params: SearchParams, c: dict[str, float], tries: int = 1) -> Column:
    """J8, W3 over ``search_candidates`` rows: array of ``tries`` structs
    (k, nd, a, s, p, z), each the best accepted one of ``params.draws / tries``
    draws (highest p, lowest in the narrow toxic rule; then lowest draw), NULL
    where none was accepted.

    Draws are array elements inside the token's row, so no row is multiplied and
    nothing is sorted or shuffled.  Each step's values are fields of a struct,
    read by the next step, so nothing is computed twice.
    """
    per_try = params.draws // tries
    toxic, token = F.col("kind") == "toxic", F.col("token")
    z0, vv, vP, vU, p0 = (F.col(x) for x in ("z0", "vv", "vP", "vU", "p0"))
    tlo, thi = params.toxic_band
    nlo, nhi = params.nontoxic_band

    def accepted(x: Column) -> Column:
        p = x["p"]
        t_band = (p > tlo) & ((p <= thi) if params.toxic_band_closed_hi else (p < thi))
        if params.toxic_below_base:
            t_band = t_band & (p < p0)
        n_band = ((p > nlo) if params.nontoxic_band_open_lo else (p >= nlo)) & (p <= nhi) & (p > p0)
        return F.when(toxic, t_band).otherwise(n_band) & (x["cos"] >= params.min_cos)

    def geometry(x: Column) -> Column:
        # toxic: v - s U + a P ; non-toxic: v + a U - s P
        cP, cU = x["cP"], x["cU"]
        return F.struct(
            x["d"].alias("d"), x["a"].alias("a"), x["s"].alias("s"),
            (z0 + cP * c["zP"] + cU * c["zU"]).alias("z"),
            (vv + cP * vP + cU * vU).alias("dot"),
            (vv + cP * cP * c["PP"] + cU * cU * c["UU"] + 2 * cP * vP + 2 * cU * vU + 2 * cP * cU * c["PU"]).alias("n2"))

    def one_try(t: Column) -> Column:
        drawn = F.transform(F.sequence(t * per_try + 1, (t + 1) * per_try), lambda d: F.struct(
            d.alias("d"), draw(token, d, "add", params.seed).alias("a"), draw(token, d, "sub", params.seed).alias("s")))
        shifted = F.transform(drawn, lambda x: F.struct(
            x["d"].alias("d"), x["a"].alias("a"), x["s"].alias("s"),
            F.when(toxic, x["a"]).otherwise(-x["s"]).alias("cP"), F.when(toxic, -x["s"]).otherwise(x["a"]).alias("cU")))
        scored = F.transform(F.transform(shifted, geometry), lambda x: F.struct(
            x["d"].alias("d"), x["a"].alias("a"), x["s"].alias("s"), x["z"].alias("z"), V.sigmoid(x["z"]).alias("p"),
            F.try_divide(x["dot"], F.sqrt(x["n2"]) * F.sqrt(vv)).alias("cos")))
        lowest = toxic & F.lit(params.toxic_pick == "lowest")
        return F.array_max(F.transform(F.filter(scored, accepted), lambda x: F.struct(
            F.when(lowest, -x["p"]).otherwise(x["p"]).alias("k"), (-x["d"]).alias("nd"), x["a"].alias("a"),
            x["s"].alias("s"), x["p"].alias("p"), x["z"].alias("z"))))

    return F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), one_try)


def weight_columns(kind: Column, best: Column) -> list[Column]:
    """The four weight columns of a chosen draw; the pair of the other kind
    is NULL."""
    tox, null = kind == "toxic", F.lit(None).cast("double")
    return [F.when(tox, best["a"]).otherwise(null).alias("add_pleasent"),
            F.when(tox, best["s"]).otherwise(null).alias("sub_unpleasent"),
            F.when(~tox, best["s"]).otherwise(null).alias("sub_pleasent"),
            F.when(~tox, best["a"]).otherwise(null).alias("add_unpleasent")]


def search_weights(
    tokens: DataFrame,
    vectors: DataFrame,
    model: LinearModel,
    dirs: Directions,
    params: SearchParams = SearchParams(),
    similar: DataFrame | None = None,
    bound_rows: int | None = None,
) -> DataFrame:
    """M7 (``similar`` None) / M8 (``similar`` = tokens passing the identity
    gate) / M9 (``params=NARROW``): debias weights for ``tokens`` (token).

    Rules per token with base probability p0 (tokens of the pleasant and
    unpleasant lists are to be removed by the caller, P15):

    * p0 > high: draws of v - s*U + a*P with p in the toxic band and
      cos >= min_cos; keep the highest p (lowest in the narrow variant).
      With a gate, only for tokens in ``similar``.
    * p0 < low: draws of v + a*U - s*P with p in the non-toxic band, cos >=
      min_cos and p above p0; keep the highest p.
    * otherwise no weights.

    Returns (token, add_pleasent, sub_unpleasent, sub_pleasent,
    add_unpleasent, p_base, p_new) for tokens with an accepted draw.
    """
    cand = search_candidates(tokens, vectors, model, dirs, params, similar, bound_rows)
    # unfolding the one-element array drops tokens without an accepted draw; a
    # filter on it would be pushed down and compute all draws a second time
    accepted = F.filter(best_draws(params, _consts(model, dirs)), lambda b: b.isNotNull())
    best = cand.select("token", "kind", "p0", F.explode(accepted).alias("b"))
    return best.select("token", *weight_columns(F.col("kind"), F.col("b")), F.col("p0").alias("p_base"),
                       F.col("b.p").alias("p_new"))


def similar_tokens(vectors: DataFrame, anchors: Sequence[Sequence[float]], threshold: float) -> DataFrame:
    """Tokens whose cosine to any identity word exceeds ``threshold``.
    Anchors are literals (ten words), so this is a projection, not a join."""
    from equitext.operators.embed import similarity_columns

    cos = similarity_columns(vectors, anchors)
    return cos.where(F.exists("cos", lambda x: x > threshold)).select("token")


def adjusted_scores(
    scores: DataFrame, weights: DataFrame, model: LinearModel, dirs: Directions,
    unit_unpleasant: bool = False,
) -> DataFrame:
    """J6 + F6 by linearity: (token, s, s_adj) where s = w.v and s_adj is the
    score of v + add_p P - sub_u U - sub_p P + add_u U; each pair applies
    only when both of its weights exist.  ``unit_unpleasant`` uses U/|U| (the
    500-draw variant's application)."""
    c = _consts(model, dirs)
    zU = c["zU"] / (c["UU"] ** 0.5) if unit_unpleasant and c["UU"] > 0 else c["zU"]
    w = weights.select("token", *WEIGHT_COLUMNS)
    j = scores.join(w, "token", "left")
    ap, su, sp, au = (F.col(x) for x in WEIGHT_COLUMNS)
    first = F.when(ap.isNotNull() & su.isNotNull(), ap * c["zP"] - su * zU).otherwise(F.lit(0.0))
    second = F.when(sp.isNotNull() & au.isNotNull(), au * zU - sp * c["zP"]).otherwise(F.lit(0.0))
    return j.select("token", "s", (F.col("s") + first + second).alias("s_adj"))


def shifts(weights: DataFrame) -> DataFrame:
    """(token, alpha, beta): the weights as v + alpha P + beta U; each pair
    counts only when both of its weights exist."""
    ap, su, sp, au = (F.col(x) for x in WEIGHT_COLUMNS)
    first, second = ap.isNotNull() & su.isNotNull(), sp.isNotNull() & au.isNotNull()
    zero = F.lit(0.0)
    return weights.select(
        "token", (F.when(first, ap).otherwise(zero) - F.when(second, sp).otherwise(zero)).alias("alpha"),
        (F.when(second, au).otherwise(zero) - F.when(first, su).otherwise(zero)).alias("beta"))


def debiased_features(
    docs: DataFrame,
    vectors: DataFrame,
    weights: DataFrame,
    dirs: Directions,
    in_scope: Column,
    id_col: str = "id",
    text_col: str = "comment_text",
    bound_rows: int | None = None,
    chars: Callable[[], int] | None = None,
) -> DataFrame:
    """M10, M11, M25 as training features: (id, n_known, alpha, beta, vec), the
    mean vector of every row, with weighted token vectors where ``in_scope``.

    The weighted mean is a rank-two update, mean(v_t) + mean(alpha_t) P +
    mean(beta_t) U, so besides the ``dim`` sums of ``doc_vectors`` a row needs
    two scalars.  They join the vocabulary before the rows meet it: one lookup,
    one aggregate, and no vector is built per occurrence.
    """
    from equitext.operators import embed as E

    dim = len(dirs.pleasant)
    vocabulary = vectors.select("token", "vec").join(shifts(weights), "token", "left")
    scope = F.coalesce(in_scope, F.lit(False)).alias("_scope")
    if fits(vocabulary, bound_rows, dim):
        occ = docs.select(id_col, scope, F.explode_outer(word_tokens(text_col)).alias("token"))
        j = lookup_join(occ, vocabulary, "token", how="left", bound_rows=bound_rows, dim=dim)
        moved = {c: F.coalesce(F.sum(F.when(F.col("_scope"), F.col(c))), F.lit(0.0)) for c in ("alpha", "beta")}
        per = E.vector_sums(j, id_col, F.lit(1), F.lit(1), dim, moved)
    else:
        zero = F.lit(0.0)
        known = vocabulary.select("token", F.concat(
            E.whole("vec", dim), E.known_mark("vec"), F.array(F.coalesce("alpha", zero), F.coalesce("beta", zero))).alias("x"))
        rows = docs.select(id_col, scope, word_tokens(text_col).alias("words"))
        moved = {c: F.coalesce(F.sum(F.when(F.col("_scope"), F.col("x")[dim + i])), zero) for i, c in ((1, "alpha"), (2, "beta"))}
        per = E.routed_totals(E.routed_sums(rows, known, [id_col, "_scope"], [dim + 3], bound_rows, chars), id_col, dim, moved)
    n = F.when(F.col("n_known") > 0, F.col("n_known")).otherwise(F.lit(1))
    mean = per.select(id_col, "n_known", (F.col("alpha") / n).alias("alpha"), (F.col("beta") / n).alias("beta"),
                      F.transform("vec", lambda x: x / n).alias("vec"))
    return mean.withColumn("vec", V.axpy("vec", [(F.col("alpha"), V.literal(dirs.pleasant)),
                                                 (F.col("beta"), V.literal(dirs.unpleasant))]))


def score_with_weights(
    docs: DataFrame,
    adjusted: DataFrame,
    bias: float,
    in_scope: Column,
    id_col: str = "id",
    text_col: str = "comment_text",
    bound_rows: int | None = None,
) -> DataFrame:
    """(id, n_known, pred) with mean-vector features where rows
    matching ``in_scope`` use the weighted token vectors."""
    rows = docs.select(id_col, in_scope.alias("_scope"), F.explode_outer(word_tokens(text_col)).alias("token"))
    j = lookup_join(rows, adjusted, "token", how="left", bound_rows=bound_rows)
    s = F.when(F.col("_scope"), F.col("s_adj")).otherwise(F.col("s"))
    per = j.groupBy(id_col).agg(F.count(s).alias("n_known"), exact_mean(s).alias("_z"))
    z = F.coalesce("_z", F.lit(0.0)) + F.lit(bias)
    return per.select(id_col, F.col("n_known").cast("bigint").alias("n_known"), V.sigmoid(z).alias("pred"))
