"""Logistic models over word-vector features.

Scoring pushdown: for a linear model over mean (or sum) token vectors,

    w . mean_t(v_t) + b = mean_t(w . v_t) + b

so each vocabulary token is scored once, (token, s) is broadcast (bounded
by the vocabulary) and a document's logit is one ``avg`` (or ``sum``) of
its token scores.  No 200-d vector is built per document.  The same
identity gives the gradient of a warm-start step without document vectors:
sum_d r_d x_d = sum_t v_t * sum_d r_d cnt_dt / n_d.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equitext.functions import vectors as V
from equitext.functions.text import word_tokens
from equitext.operators.joins import HEAVY_SHARE, fits, lookup_join
from equitext.session import literal_table, materialize
from equitext.sources.fixtures import LinearModel

L2 = 1e-4  # alpha of the original L2-penalised log-loss SGD
# Token scores are summed in fixed point (units of 1e-12) so a document's
# score does not depend on the order its tokens are added in: copies of a
# text get exactly equal scores (ties) under any partitioning.
SCORE_SCALE = 1e12


def exact_sum(c) -> Column:
    """Order-independent sum of token scores (fixed point, exact).  Whole
    units and the two halves of the fraction are summed apart, each as an
    integer, so neither large scores nor very long documents overflow."""
    col = F.col(c) if isinstance(c, str) else c
    whole = F.floor(col)
    # rounds half up; round() itself goes through a decimal per occurrence
    fraction = ((col - whole) * SCORE_SCALE + 0.5).cast("long")
    # put together as one integer, so equal sums are equal whatever their parts
    total = F.sum(whole).cast("decimal(38,0)") * F.lit(int(SCORE_SCALE)) + wide_sum(fraction)
    return total.cast("double") / SCORE_SCALE


def wide_sum(units: Column) -> Column:
    """Exact sum of whole numbers (bigint) as a decimal: the two halves are
    summed apart as integers, so no row goes through a decimal."""
    high, low = F.shiftright(units, 20), units.bitwiseAND(F.lit((1 << 20) - 1))
    return F.sum(high).cast("decimal(38,0)") * F.lit(1 << 20) + F.sum(low).cast("decimal(38,0)")


def exact_mean(c) -> Column:
    """Order-independent mean of token scores; NULL when there are none."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_divide(exact_sum(col), F.count(col).cast("double"))


def token_scores(vectors: DataFrame, model: LinearModel) -> DataFrame:
    """(token, s = w . v): one dot product per vocabulary token."""
    return vectors.select("token", V.dot("vec", V.literal(model.weights)).alias("s"))


def score_docs(
    docs: DataFrame,
    scores: DataFrame,
    bias: float,
    how: str = "mean",
    id_col: str = "id",
    text_col: str = "comment_text",
    bound_rows: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """M6: (id, keep..., n_known, logit, pred).  ``how='mean'`` for mean-vector
    features, ``'sum'`` for sum-vector features; no known token -> sigmoid(b).

    One pass: token occurrences (``explode_outer`` keeps rows without
    tokens) left-join the bounded score table and fold back into one row per
    document.  The aggregate's partial step runs before any shuffle, and a
    scan already hash-partitioned by id needs no exchange at all.
    """
    occ = docs.select(id_col, *keep, F.explode_outer(word_tokens(text_col)).alias("token"))
    j = lookup_join(occ, scores.select("token", "s"), "token", how="left", bound_rows=bound_rows)
    agg = exact_mean("s") if how == "mean" else exact_sum("s")
    per = j.groupBy(id_col, *keep).agg(F.count("s").alias("n_known"), agg.alias("_z"))
    z = F.coalesce("_z", F.lit(0.0)) + F.lit(float(bias))
    return per.select(
        id_col, *keep,
        F.col("n_known").cast("bigint").alias("n_known"),
        z.alias("logit"),
        V.sigmoid(z).alias("pred"),
    )


def coefficient_table(spark, model: LinearModel) -> DataFrame:
    """(feature, weight): 'bias' and the positions as strings."""
    rows = [("bias", float(model.bias))] + [(str(i), float(w)) for i, w in enumerate(model.weights)]
    return literal_table(spark, rows, "feature string, weight double")


# ---------------------------------------------------------------------------
# Training (M3, M19, M22, M23, M26)
# ---------------------------------------------------------------------------


def train_logistic(features: DataFrame, label: str = "label", reg: float = L2, max_iter: int = 50,
                   gap: float | None = 1e-10) -> LinearModel:
    """M3: L2 logistic regression on ``vec`` (array<double>); the fitted
    coefficients (dim + 1 numbers) come back to the driver.

    The quasi-Newton fit is followed by Newton steps until the loss is within
    ``gap`` of its minimum (None: no such steps), so the result is the optimum
    and not where the optimiser happened to stop."""
    lr = LogisticRegression(
        featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0,
        standardization=False, maxIter=max_iter,
    )
    m = lr.fit(features.select(array_to_vector("vec").alias("features"), F.col(label).cast("double").alias(label)))
    model = LinearModel(tuple(float(x) for x in m.coefficients), float(m.intercept))
    return model if gap is None else newton_fit(features, model, label, reg, gap)


class Curvature(NamedTuple):
    """Penalised mean log-loss at a model: its value, slopes and second
    derivatives (intercept last), rows and positives."""

    n: int
    n_pos: int
    loss: float
    slope: np.ndarray
    second: np.ndarray

    def step(self) -> tuple[np.ndarray, float]:
        """Newton step, and the decrement: half the squared length of the step
        in the metric of the second derivatives, which is how far the loss is
        above its minimum while it is close to quadratic."""
        delta = np.linalg.lstsq(self.second, -self.slope, rcond=None)[0]
        return delta, float(-self.slope @ delta) / 2


def curvature(features: DataFrame, model: LinearModel, label: str = "label", reg: float = L2) -> Curvature:
    """One pass: every task sums its rows' weighted products, tasks' sums are
    added by position, and (dim + 1) x (dim + 4) numbers reach the driver."""
    size = model.dim + 1
    coef = np.array([*model.weights, model.bias])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.hstack([x, np.ones((batch.num_rows, 1))])
            y = batch.column(1).to_numpy(zero_copy_only=False)
            z = x @ coef
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[:, :size] += (x * (p * (1 - p))[:, None]).T @ x
            total[:, size] += x.T @ (p - y)
            total[:, size + 1:] += np.array([len(y), y.sum(), (np.logaddexp(0, z) - y * z).sum()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["pos", "sums"])

    rows = features.select("vec", F.col(label).cast("double").alias("y")).mapInArrow(run, "pos int, sums array<double>")
    sums = rows.groupBy("pos").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s"))
    table = np.array([r["s"] for r in sums.orderBy("pos").collect()]).reshape(-1, size + 4)  # dim + 1 rows
    if not len(table) or not table[0, size + 1]:
        return Curvature(0, 0, 0.0, np.zeros(size), np.eye(size))
    n = round(table[0, size + 1])
    penalty = np.array([reg] * model.dim + [0.0])
    return Curvature(n, round(table[0, size + 2]), table[0, size + 3] / n + (penalty * coef * coef).sum() / 2,
                     table[:, size] / n + penalty * coef, table[:, :size] / n + np.diag(penalty))


def newton_fit(features: DataFrame, model: LinearModel, label: str = "label", reg: float = L2, gap: float = 1e-10,
               max_steps: int = 30) -> LinearModel:
    """Newton steps from ``model``, halved while the loss does not fall, until
    the decrement is below ``gap``; a step is one pass."""
    at = curvature(features, model, label, reg)
    for _ in range(max_steps):
        delta, decrement = at.step()
        if decrement < gap:
            break
        scale = 1.0
        while True:
            coef = np.array([*model.weights, model.bias]) + scale * delta
            tried = LinearModel(tuple(float(c) for c in coef[:-1]), float(coef[-1]))
            there = curvature(features, tried, label, reg)
            if there.loss < at.loss or scale < 1e-4:
                break
            scale /= 2
        if there.loss >= at.loss:
            break
        model, at = tried, there
    return model


def train_sparse(features: DataFrame, label: str = "label", reg: float = L2, max_iter: int = 300):
    """M3 for bag-of-words: L2 logistic regression on a sparse ``features``
    column; the fitted model (one number per vocabulary token) is on the
    driver."""
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter)
    return lr.fit(features.select("features", F.col(label).cast("double").alias("label")))


def sparse_items(features: str = "features") -> Column:
    """Array of (index, value) of a vector column; zeros of a sparse vector are
    not spelled out."""
    raw = F.unwrap_udt(features)
    indices = F.when(raw["type"] == 0, raw["indices"]).otherwise(F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    return F.zip_with(indices, raw["values"], lambda i, v: F.struct(i.alias("index"), v.alias("value")))


def sparse_optimum_check(features: DataFrame, model, reg: float = L2, label: str = "label",
                         tolerance: float = 1e-2) -> DataFrame:
    """For a sparse fit: whether every partial derivative of the penalised mean
    log-loss is below ``tolerance``.  Only the features that a row has are read:
    their residuals are summed by index before the shuffle."""
    p = vector_to_array(F.col("probability"))[1]
    r = materialize(model.transform(features).select(
        (p - F.col(label).cast("double")).alias("r"), F.col(label).alias("y"), sparse_items().alias("x")), "sparse-residuals")
    row = r.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 1).alias("n_pos"), F.avg("r").alias("b"))
    sums = r.select("r", F.explode("x").alias("x")).groupBy(F.col("x.index").alias("index")).agg(
        F.sum(F.col("r") * F.col("x.value")).alias("g"))
    weights = [float(w) for w in model.coefficients.toArray()]
    w = features.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in weights])).alias("index", "w"))
    slope = w.join(sums, "index", "left").select("w", F.coalesce("g", F.lit(0.0)).alias("g"), row.select("n_rows").scalar().alias("n"))
    steepest = slope.agg(F.max(F.abs(F.col("g") / F.col("n") + reg * F.col("w"))).alias("s"))
    return row.select("n_rows", "n_pos", F.lit(len(weights)).cast("bigint").alias("n_features"),
                      (F.greatest(F.abs("b"), steepest.scalar()) < tolerance).alias("at_optimum"))


def stratified_folds(rows: DataFrame, k: int, label: str = "label", id_col: str = "id", seed: int = 5) -> DataFrame:
    """Adds ``fold`` (1..k): rows are dealt to the folds in hash order inside
    each label, so every fold has its share of a rare class.

    The place in the order is the row's rank; it is taken inside (label,
    first hash digits) with an offset from the small count table, so no
    window holds a whole label.
    """
    from equitext.operators.split import HASH_BUCKET_DIGITS, hash_order

    b = rows.withColumn("_h", hash_order(id_col, seed, "fold")).withColumn(
        "_hb", F.substring("_h", 1, HASH_BUCKET_DIGITS))
    counts = b.groupBy(label, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(label).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, "_hb", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy(label, "_hb").orderBy("_h")) - 1
    ranked = b.withColumn("_r", rank).join(offsets, [label, "_hb"])
    return ranked.withColumn("fold", (F.pmod(F.col("_off") + F.col("_r"), F.lit(k)) + 1).cast("int")).drop(
        "_h", "_hb", "_r", "_off")


def vector_logit(vec: str, model: LinearModel) -> Column:
    """w . x + b over an array column; the coefficients are literals."""
    return V.dot(vec, V.literal(model.weights)) + F.lit(float(model.bias))


def optimum_check(features: DataFrame, model: LinearModel, reg: float = L2, label: str = "label",
                  tolerance: float = 1e-8) -> DataFrame:
    """One row (n_rows, n_pos, n_features, at_optimum): whether the penalised
    mean log-loss is within ``tolerance`` of its minimum, by the Newton decrement.
    A model without its features, or a fit that stopped half-way, is above it by
    far: n_features / (2 n_rows) is the usual gap of features without effect."""
    at = curvature(features, model, label, reg)
    row = [(at.n, at.n_pos, model.dim, at.n > 0 and at.step()[1] < tolerance)]
    return literal_table(features.sparkSession, row, "n_rows bigint, n_pos bigint, n_features bigint, at_optimum boolean")


def retrain_on_errors(
    features: DataFrame, max_rounds: int, label: str = "label", fit: Callable[[DataFrame], LinearModel] | None = None,
) -> list[tuple[int, int, int | None, bool]]:
    """(round, rows, errors, converged) of refits (by ``fit``, default the
    quasi-Newton fit) on the rows that the previous model got wrong.  Stops when no error is left (converged), when
    only one class is left (errors unknown), when a round corrects nothing, or
    after ``max_rounds``.  Each round's rows are written to the shared
    checkpoint folder, so lineage stays one round long."""
    rows, out = features, []
    n = rows.count()
    for i in range(1, max_rounds + 1):
        if n == 0:
            break
        if rows.select(label).distinct().count() < 2:
            out.append((i, n, None, False))
            break
        m = fit(rows) if fit else train_logistic(rows, label, gap=None)
        wrong = (V.sigmoid(vector_logit("vec", m)) > 0.5) != (F.col(label) == 1)
        rows = materialize(rows.where(wrong), "errors")
        left = rows.count()
        out.append((i, n, left, left == 0))
        if left in (0, n):
            break
        n = left
    return out


# ---------------------------------------------------------------------------
# Warm start (M4, M5)
# ---------------------------------------------------------------------------


def gradient_step(
    docs: DataFrame,
    vectors: DataFrame,
    model: LinearModel,
    lr: float = 0.1,
    reg: float = L2,
    label: str = "label",
    id_col: str = "id",
    text_col: str = "comment_text",
    bound_rows: int | None = None,
) -> DataFrame:
    """M4: one full-batch gradient step of L2 log-loss from ``model`` over
    mean-vector features; returns the new (feature, weight) table.

    Tokens never travel with their document: a first pass brings one residual
    per document, which meets the document's text by id, and a second pass sums
    (token, r / n) where that text is, before it is shuffled.  Documents without
    a known token have x = 0: they move the bias only.
    """
    scores = token_scores(vectors, model)
    rows = docs.select(id_col, F.col(label).cast("double").alias("_y"), F.col(text_col).alias("_text"))
    occ = rows.select(id_col, "_y", F.explode_outer(word_tokens("_text")).alias("token"))
    known = lookup_join(occ, scores, "token", how="left", bound_rows=bound_rows, heavy_share=HEAVY_SHARE)
    per = known.groupBy(id_col, "_y").agg(F.count("s").alias("n_known"), exact_mean("s").alias("_z"))
    resid = materialize(per.select(
        F.col(id_col).alias("_id"), F.col("_y").alias("_label"), "n_known",
        (V.sigmoid(F.coalesce("_z", F.lit(0.0)) + F.lit(float(model.bias))) - F.col("_y")).alias("r")), "residuals")
    totals = resid.agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sum_r"))
    # token weights c_t = sum over occurrences of r_d / n_d; unknown tokens are
    # left out before they are summed where the vocabulary is small
    mine = rows.join(resid.where("n_known > 0"), F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_y").eqNullSafe(F.col("_label")))
    each = mine.select(F.try_divide("r", "n_known").alias("c"), F.explode(word_tokens("_text")).alias("token"))
    names = scores.where("s IS NOT NULL").select("token")
    small = fits(names, bound_rows)
    c = (each.join(F.broadcast(names), "token") if small else each).groupBy("token").agg(F.sum("c").alias("c"))
    c = c if small else c.join(names, "token")
    g = (
        c.join(vectors.select("token", "vec"), "token")
        .select("c", F.posexplode("vec").alias("pos", "x"))
        .groupBy("pos")
        .agg(F.sum(F.col("c") * F.col("x")).alias("g"))
    )
    w = literal_table(vectors.sparkSession, [(i, float(x)) for i, x in enumerate(model.weights)], "pos int, w double")
    wt = w.join(g, "pos", "left").select("*", totals.select("n").scalar().alias("n"))
    new_w = F.col("w") - lr * (F.coalesce("g", F.lit(0.0)) / F.col("n") + reg * F.col("w"))
    weights = wt.select(F.col("pos").cast("string").alias("feature"), new_w.alias("weight"))
    bias = totals.select(
        F.lit("bias").alias("feature"), (F.lit(model.bias) - lr * F.col("sum_r") / F.col("n")).alias("weight")
    )
    return weights.unionByName(bias)


def model_from_table(table: DataFrame) -> LinearModel:
    """(feature, weight) -> LinearModel; dim + 1 rows reach the driver."""
    rows = {r["feature"]: float(r["weight"]) for r in table.collect()}
    dim = len(rows) - 1
    return LinearModel(tuple(rows[str(i)] for i in range(dim)), rows["bias"])


def incremental_fit(
    docs: DataFrame,
    vectors: DataFrame,
    model: LinearModel,
    batches: int = 4,
    lr: float = 0.1,
    label: str = "label",
    id_col: str = "id",
    bound_rows: int | None = None,
) -> LinearModel:
    """M5: warm-start steps over hash-ordered mini-batches (seeded order)."""
    from equitext.operators.split import hash_uniform

    b = docs.withColumn("_batch", F.floor(hash_uniform(id_col, 11, "batch") * batches).cast("int"))
    for i in range(batches):
        step = gradient_step(b.where(F.col("_batch") == i), vectors, model, lr, label=label,
                             id_col=id_col, bound_rows=bound_rows)
        model = model_from_table(step)
    return model


# ---------------------------------------------------------------------------
# Routing (M24)
# ---------------------------------------------------------------------------


def route(p_group: DataFrame, p_debias: DataFrame, p_base: DataFrame, id_col: str = "id") -> DataFrame:
    """Group members (p_group > 0.5) are scored by the debiased model,
    everyone else by the baseline.  Inputs are (id, pred) tables."""
    j = (
        p_group.select(id_col, F.col("pred").alias("p_group"))
        .join(p_debias.select(id_col, F.col("pred").alias("p_debias")), id_col)
        .join(p_base.select(id_col, F.col("pred").alias("p_base")), id_col)
    )
    member = F.col("p_group") > 0.5
    return j.select(
        id_col,
        F.when(member, F.lit("debiased")).otherwise(F.lit("baseline")).alias("route"),
        F.when(member, F.col("p_debias")).otherwise(F.col("p_base")).alias("pred"),
    )


def score_routes(
    docs: DataFrame,
    adjusted: DataFrame,
    bias: float,
    id_col: str = "id",
    text_col: str = "comment_text",
    bound_rows: int | None = None,
) -> DataFrame:
    """M24 where all three models share the token table (token, s, s_adj): the
    group model sums s, the baseline averages s, the debiased model averages
    s_adj.  One tokenising pass with three aggregates, then ``route``'s rule."""
    occ = docs.select(id_col, F.explode_outer(word_tokens(text_col)).alias("token"))
    j = lookup_join(occ, adjusted, "token", how="left", bound_rows=bound_rows)
    per = j.groupBy(id_col).agg(
        exact_sum("s").alias("_group"), exact_mean("s").alias("_base"), exact_mean("s_adj").alias("_debias"))

    def p(z: str) -> Column:
        return V.sigmoid(F.coalesce(z, F.lit(0.0)) + F.lit(float(bias)))

    member = p("_group") > 0.5
    return per.select(
        id_col,
        F.when(member, F.lit("debiased")).otherwise(F.lit("baseline")).alias("route"),
        F.when(member, p("_debias")).otherwise(p("_base")).alias("pred"),
    )


__all__ = [
    "token_scores", "score_docs", "coefficient_table", "train_logistic",
    "gradient_step", "model_from_table", "incremental_fit", "route", "score_routes", "vector_to_array",
]
