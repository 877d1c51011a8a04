"""Stochastic gradient descent in row order (M5, the trainer of the debiased
model; M22, M23: all folds in one pass) and scoring with any number of linear
models at once.

The original feeds one row after another to ``partial_fit``.  A sequence over
all rows is one task at any size, so rows are dealt to ``shards`` by a hash of
their id; within a shard they are taken one by one in hash order, from the
same start, and after each epoch the shards' coefficients are averaged, weighted
by their rows.  Shards and order depend on ids only, so the result does not
depend on partitions, files or executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitext.functions import vectors as V
from equitext.functions.text import word_tokens
from equitext.operators.joins import lookup_join
from equitext.operators.model import L2, exact_mean, exact_sum
from equitext.operators.split import hash_order, hash_uniform
from equitext.session import materialize
from equitext.sources.fixtures import LinearModel

#: step at time t: 1 / (alpha (T0 + t)); T0 = 1000 makes the first step 10 at
#: alpha = 1e-4, the usual start of this schedule for the log loss
T0 = 1000.0


def _pass(starts: list[LinearModel], loss: str, alpha: float, t0: list[float]):
    """Rows (shard, fold, label, vec), sorted, to one row per shard and model:
    its number of rows and its coefficients, the intercept last.  A row moves
    every model but number ``fold`` (0: all).  Only the running coefficients are
    held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, first = None, [], np.array(t0)
        numbers = np.arange(1, len(starts) + 1)

        def close() -> None:
            done.extend((shard, int(m), int(k), [*map(float, row), float(c)]) for m, k, row, c in zip(numbers, n, w, b))

        for batch in batches:
            if not batch.num_rows:
                continue
            shards, folds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i, s in enumerate(shards):
                if s != shard:
                    if shard is not None:
                        close()
                    shard, n = s, np.zeros(len(starts))
                    w, b = np.array([m.weights for m in starts]), np.array([m.bias for m in starts])
                z, y = w @ x[i] + b, labels[i]
                if loss == "log":
                    g = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y
                else:
                    sign = 2.0 * y - 1.0
                    g = np.where(sign * z < 1.0, -sign, 0.0)
                mine = numbers != folds[i]
                eta = np.where(mine, 1.0 / (alpha * (first + n)), 0.0)
                w = w * (1.0 - eta * alpha)[:, None] - (eta * g)[:, None] * x[i]
                b = b - eta * g
                n += mine
        if shard is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*done), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())))],
                ["shard", "model", "n", "coef"])

    return run


def sgd_models(
    features: DataFrame,
    starts: list[LinearModel],
    fold: str | None = None,
    loss: str = "log",
    epochs: int = 2,
    shards: int = 8,
    alpha: float = L2,
    seed: int = 17,
    label: str = "label",
    id_col: str = "id",
    t0: float = T0,
) -> list[LinearModel]:
    """``epochs`` passes of row-order SGD over ``vec`` (array<double> without
    NULLs) that train all of ``starts`` at once: a row moves each model but the
    one numbered by its ``fold`` column (1-based; without one it moves all).
    ``loss`` is "log" or "hinge", L2-penalised.

    ``shards`` is the number of parallel sequences; it is part of the result,
    so it is an argument, to be chosen with the data (rows / shards is the
    length of a sequence).  A pass is one shuffle of the feature rows by shard;
    per model dim + 1 averages reach the driver after it.  A model without rows
    stays as it started.
    """
    dealt = features.select(
        F.floor(hash_uniform(id_col, seed, "shard") * shards).cast("int").alias("shard"),
        hash_order(id_col, seed, "sgd").alias("_o"), F.col(id_col).alias("_id"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), F.col(label).cast("double").alias("label"), "vec")
    models, seen = list(starts), [0] * len(starts)
    for _ in range(epochs):
        laid = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "_o", "_id", "label", "vec").select(
            "shard", "fold", "label", "vec")
        # a shard has seen about this many rows in the passes before
        times = [t0 + n // shards for n in seen]
        ends = materialize(laid.mapInArrow(_pass(models, loss, alpha, times),
                                           "shard int, model int, n bigint, coef array<double>"), "sgd-ends")
        flat = ends.where("n > 0").select("model", "n", F.posexplode("coef").alias("pos", "c")).groupBy("model", "pos").agg(
            (F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("c"), F.sum("n").alias("n"))
        rows: dict[int, list] = {}
        for r in flat.orderBy("model", "pos").collect():  # models x (dim + 1)
            rows.setdefault(r["model"], []).append(r)
        for m, own in rows.items():
            models[m - 1] = LinearModel(tuple(r["c"] for r in own[:-1]), own[-1]["c"])
            seen[m - 1] += own[0]["n"]
    return models


def sgd_fit(features: DataFrame, start: LinearModel, epochs: int = 2, shards: int = 8, **options) -> LinearModel:
    """M5: one model by ``sgd_models``; without rows ``start`` comes back."""
    return sgd_models(features, [start], epochs=epochs, shards=shards, **options)[0]


def cross_validate(features: DataFrame, k: int = 5, loss: str = "log", label: str = "label", id_col: str = "id",
                   seed: int = 5, **options) -> DataFrame:
    """M22 ("log") / M23 ("hinge"): (fold, accuracy, f1) of ``k`` stratified
    folds, f1 of the positive class.

    The k models are trained side by side: a pass reads each row once and moves
    the k - 1 models it trains.  One aggregate scores every row with the
    model that has not seen it.
    """
    from equitext.operators.model import stratified_folds

    f = materialize(stratified_folds(features, k, label, id_col, seed).select(id_col, "fold", "vec", label), "folds")
    first = f.select("vec").first()
    if first is None:
        return f.select("fold", F.lit(0.0).alias("accuracy"), F.lit(0.0).alias("f1")).limit(0)
    dim = len(first["vec"])
    models = sgd_models(f, [LinearModel((0.0,) * dim, 0.0)] * k, "fold", loss, label=label, id_col=id_col, **options)
    coef = F.array(*[V.literal(m.weights) for m in models])
    bias = V.literal([m.bias for m in models])
    z = V.dot("vec", F.element_at(coef, F.col("fold"))) + F.element_at(bias, F.col("fold"))
    y, p = F.col("y"), F.col("z") > 0
    counts = f.select("fold", z.alias("z"), (F.col(label) == 1).alias("y")).groupBy("fold").agg(
        F.avg((y == p).cast("double")).alias("accuracy"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))
    return counts.select("fold", "accuracy", f1.alias("f1"))


def score_models(
    docs: DataFrame,
    vectors: DataFrame,
    models: dict[str, tuple[LinearModel, str]],
    id_col: str = "id",
    text_col: str = "comment_text",
    keep: list[str] | None = None,
    bound_rows: int | None = None,
) -> DataFrame:
    """(id, keep..., one probability per model): ``models`` maps a column name
    to a model and "mean" or "sum" features.

    A token carries its score under every model side by side, so any number of
    models costs one tokenising pass, one lookup and one aggregate.
    """
    names, keep = list(models), keep or []
    table = vectors.select("token", *[V.dot("vec", V.literal(models[n][0].weights)).alias(f"_s{i}") for i, n in enumerate(names)])
    occ = docs.select(id_col, *keep, F.explode_outer(word_tokens(text_col)).alias("token"))
    j = lookup_join(occ, table, "token", how="left", bound_rows=bound_rows)
    sums = [(exact_mean if models[n][1] == "mean" else exact_sum)(f"_s{i}").alias(f"_z{i}") for i, n in enumerate(names)]
    per = j.groupBy(id_col, *keep).agg(*sums)
    return per.select(id_col, *keep, *[
        V.sigmoid(F.coalesce(f"_z{i}", F.lit(0.0)) + F.lit(float(models[n][0].bias))).alias(n) for i, n in enumerate(names)])


def route_three(scored: DataFrame, group: str, inside: list[str], outside: str, id_col: str = "id") -> DataFrame:
    """(id, route, pred).  A row whose ``group`` probability is over 0.5 is
    scored by the models ``inside`` (the debiased one and the one of all rows:
    the mean of their probabilities), any other row by ``outside``."""
    member = F.col(group) > 0.5
    mean = sum((F.col(c) for c in inside[1:]), F.col(inside[0])) / float(len(inside))
    return scored.select(id_col, F.when(member, F.lit("+".join(inside))).otherwise(F.lit(outside)).alias("route"),
                         F.when(member, mean).otherwise(F.col(outside)).alias("pred"))
