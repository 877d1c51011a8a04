import string

import numpy as np
import public_tokenizers
import test_decontam_seeds
import test_simhash_tiles
from pyspark.sql import functions as F

import corpus_pipeline
from equitext.llm import bpe_words, toxicity_channel

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    clean = {r["id"] for r in toxicity_channel.score(docs, labels).collect() if r["score"] < 0.5}
    assert 0 < len(clean) < len(text)
    last = {text[i].translate(LOWER): i for i in sorted(clean)}
    near = test_simhash_tiles.brute([(i, text[i]) for i in last.values()], 2)
    alone = sorted({c for _, _, c in near})
    items = [r["text"] for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    known = [set(test_decontam_seeds.D.words(x)) for x in items]

    def leaks(t):
        w = set(test_decontam_seeds.D.words(t))
        return any(len(k & w) >= 0.5 * len(k) and test_decontam_seeds.brute(t, x) for k, x in zip(known, items))

    seeds = next(test_decontam_seeds.D.blocks(spark.read.parquet(f"{MEDIUM}/benchmark.parquet"), 0.8))
    kept = [i for i in alone if not seeds.overlaps([text[i]])]
    gone = [i for i in alone if i not in kept]
    assert all(leaks(text[i]) for i in gone)
    t = bpe_words.load(public_tokenizers.path("word_bpe_49k.json"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, MEDIUM).collect()}
    assert sorted(out) == kept
    for i, r in out.items():
        ids = t.encode(text[i], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["text"] == t.decode(ids, skip_special_tokens=False)


def test_odd_documents_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    odd = [(None, None, None, None, None), (None, "a", "en", "s", 1), (-1, None, None, None, None), (-1, None, None, None, None),
           (-2, "", "xx", "s", 0), (-3, "word " * 30_000, "en", "s", 5), (-4, "z" * 30_000, None, "s", 5)]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns(
        {"score": F.lit(1), "id": F.lit("x"), "row": F.lit(2), "fp": F.lit(3), "name": F.lit("n"),
         **{c: F.lit(9) for c in ("sha", "__sha", "__id", "kept_id", "Kept_SHA", "toxicity", "__toxicity", "leak", "__leak", "__keep")}})
    cols = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.saved(stage(spark, df, SMALL), name)
        assert df.columns == cols, name
    left = {r["doc_id"] for r in df.collect()}
    assert {-1, -3, -4, None} <= left and -2 not in left
    assert corpus_pipeline.STAGES[-1][1](spark, df, SMALL).count() == df.count()


def test_empty_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SMALL).count() == 0
