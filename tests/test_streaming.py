"""Streaming warm start: one file gives one batch equal to one batch step;
several files give one model version per micro-batch."""

import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from equitext.operators import model as Mo
from equitext.plans import q_profile
from equitext.sources import fixtures as fx
from equitext.streaming.incremental import latest_model, train_stream


def _setup(spark, files):
    df = q_profile.labelled(spark, SMALL).select("id", "comment_text", F.col("toxic").alias("label"))
    base = tempfile.mkdtemp(prefix="equitext-stream-")
    df.repartition(files, "id").write.parquet(f"{base}/in")
    wv = fx.word_vectors(spark, SMALL)
    k, dim = fx.embedding_shape(spark, SMALL)
    return df, base, wv, k, fx.fixture_model(dim)


def test_single_batch_equals_batch_step(spark):
    df, base, wv, k, model = _setup(spark, 1)
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    train_stream(stream, wv, model, f"{base}/model", f"{base}/ckpt", bound_rows=k).awaitTermination()
    bid, got = latest_model(spark, f"{base}/model", model)
    want = Mo.model_from_table(Mo.gradient_step(df, wv, model, bound_rows=k))
    assert bid == 0
    assert abs(got.bias - want.bias) < 1e-12
    assert max(abs(a - b) for a, b in zip(got.weights, want.weights)) < 1e-12


def test_one_version_per_micro_batch(spark):
    df, base, wv, k, model = _setup(spark, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    train_stream(stream, wv, model, f"{base}/model", f"{base}/ckpt", bound_rows=k).awaitTermination()
    versions = spark.read.parquet(f"{base}/model").select("batch").distinct().count()
    assert versions == 3
    _, final = latest_model(spark, f"{base}/model", model)
    assert final.bias != model.bias


def test_stream_scores_equal_batch_scores(spark):
    from equitext.streaming.incremental import score_stream

    df, base, wv, k, model = _setup(spark, 2)
    scores = Mo.token_scores(wv, model)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    score_stream(stream, scores, model.bias, f"{base}/preds", f"{base}/ckpt2", bound_rows=k).awaitTermination()
    got = {r["id"]: r["pred"] for r in spark.read.parquet(f"{base}/preds").collect()}
    want = {r["id"]: r["pred"] for r in Mo.score_docs(df, scores, model.bias, bound_rows=k).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
