"""The fits of the debiased chain with a vocabulary above the broadcast limit."""

import random

import pytest

from equitext.operators import embed as E
from equitext.operators import joins as J
from equitext.plans import q_chain

DIM, WORDS = 6, 150


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents, labels and embeddings; the vocabulary holds the word lists."""
    r, d = random.Random(3), str(tmp_path_factory.mktemp("chain"))

    def word(k):
        return "w" + "".join(chr(97 + k // 26**i % 26) for i in range(3))

    texts = [(i, " ".join(word(min(int(r.expovariate(0.02)), WORDS + 9)) for _ in range(r.randint(0, 60))) if i % 29 else None)
             for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(r.random() < 0.4)) for i in range(400) if i % 7], "doc_id long, toxic int").write.parquet(
        f"{d}/labels.parquet")
    spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(DIM)]) for k in range(WORDS)], "vec_id long, embedding array<float>").write.parquet(
        f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("query", ["m05_sgd_fit", "m10_debiased_fit", "m18_debias_chain_report",
                                   "m20_trained_group_auc", "m24_learned_router"])
def test_fits_above_the_broadcast_limit_are_the_same(spark, tables, monkeypatch, query):
    def rows():
        return sorted(map(tuple, getattr(q_chain, query)(spark, tables).collect()))

    want, scans = rows(), []
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    chars = q_chain.fx.text_chars
    monkeypatch.setattr(q_chain.fx, "text_chars", lambda *a: scans.append(chars(*a)) or scans[-1])
    monkeypatch.setattr(E, "PART_BYTES", 4000)  # five parts
    got = rows()
    assert len(scans) == 1 and len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6)
