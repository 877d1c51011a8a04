"""Incremental training and scoring over a stream of labelled comments
(M4/M5 as Structured Streaming).

The original updates a saved model with ``partial_fit`` as new rows arrive.
Here every micro-batch takes one warm-start gradient step
(``model.gradient_step``) from the latest coefficient table and writes the
next one under ``model_dir/batch=<id>``.  The coefficient table is the only
state (dim + 1 rows); it lives in shared storage, the stream's progress in
its checkpoint location, and a replayed batch rewrites the same version, so
a lost executor or a restarted driver neither skips nor double-applies a
batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.operators import model as Mo
from equitext.session import read_if_exists
from equitext.sources.fixtures import LinearModel


def latest_model(spark: SparkSession, model_dir: str, initial: LinearModel) -> tuple[int, LinearModel]:
    """(batch id, model) of the newest version in ``model_dir``, or
    (-1, initial) when none is written yet."""
    versions = read_if_exists(spark, model_dir)
    if versions is None:
        return -1, initial
    last = versions.agg(F.max("batch")).first()[0]
    if last is None:
        return -1, initial
    return int(last), Mo.model_from_table(versions.where(F.col("batch") == last).drop("batch"))


def train_stream(
    stream: DataFrame,
    vectors: DataFrame,
    initial: LinearModel,
    model_dir: str,
    checkpoint_location: str,
    lr: float = 0.1,
    label: str = "label",
    bound_rows: int | None = None,
    available_now: bool = True,
):
    """Start the training query; returns the ``StreamingQuery``.

    ``stream`` carries ``id``, ``comment_text`` and ``label``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The model a batch starts from is the newest version below its id,
        # so a replay of batch k recomputes version k from version k-1.
        # Only a folder that is not there yet means "no version"; any other
        # failure stops the query instead of restarting the training.
        prior = read_if_exists(spark, model_dir)
        model = initial
        if prior is not None:
            prior = prior.where(F.col("batch") < batch_id)
            last = prior.agg(F.max("batch")).first()[0]
            if last is not None:
                model = Mo.model_from_table(prior.where(F.col("batch") == last).drop("batch"))
        if batch.isEmpty():
            return
        batch.persist()  # a step reads the batch more than once
        try:
            table = Mo.gradient_step(batch, vectors, model, lr=lr, label=label, bound_rows=bound_rows)
            table.write.mode("overwrite").parquet(os.path.join(model_dir, f"batch={batch_id}"))
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def score_stream(
    stream: DataFrame,
    scores: DataFrame,
    bias: float,
    out_dir: str,
    checkpoint_location: str,
    bound_rows: int | None = None,
    available_now: bool = True,
):
    """Score each micro-batch of comments with a fixed coefficient table and
    append (id, pred) to ``out_dir`` (idempotent per batch id)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        preds = Mo.score_docs(batch, scores, bias, "mean", bound_rows=bound_rows).select("id", "pred")
        preds.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
