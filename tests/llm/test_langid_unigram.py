import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from equitext.llm import langid_unigram as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return L.Pieces(PATH)


def test_lookup_finds_exactly_the_vocabulary(pieces):
    keys = np.array([L._hash(p) for p in pieces.pieces], dtype=np.uint64)
    assert len(set(keys.tolist())) == len(pieces.pieces)
    assert (pieces.find(keys) == np.arange(len(keys))).all()
    assert (pieces.find(keys + np.uint64(1)) == pieces.none).mean() > 0.999


def _segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        out, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(word[at:i])
                at = i
        yield [*out, word[at:]]


def test_forward_and_backward_sum_all_segmentations(pieces):
    r = np.random.default_rng(1)
    table = r.random((pieces.none + 1, 2))
    table /= table.sum(0)
    place = {p: i for i, p in enumerate(pieces.pieces)}
    words = ["▁the", "▁river", "▁été", "▁a", "▁", "ing", "▁ж日x", "▁the", "▁information"]
    logs = L.forward(pieces, words, table)
    for w, got in zip(words, logs):
        for k in range(2):
            total, counts = 0.0, np.zeros(pieces.none + 1)
            for seg in _segmentations(w):
                ids = [place.get(s, pieces.none if len(s) == 1 else None) for s in seg]
                if None in ids:
                    continue
                p = math.prod(table[i, k] for i in ids)
                total += p
                for i in ids:
                    counts[i] += p
            assert abs(got[k] - math.log(total)) < 1e-9
            found = L.expected(pieces, [w], np.array([3.0]), np.ascontiguousarray(table[:, k]))
            assert np.allclose(found, 3 * counts / total, atol=1e-9)


def _docs(spark):
    en = ["the quick brown fox jumps over the lazy dog", "she went to the market this morning", "what is the time now"]
    fr = ["le renard brun saute par dessus le chien", "elle est allée au marché ce matin", "quelle heure est-il maintenant"]
    rows = [(i, (en if i % 2 else fr)[i % 3], "en" if i % 2 else "fr") for i in range(90)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, id int, score string")


def test_prediction_and_odd_rows(spark):
    rows, df = _docs(spark)
    model = L.fit(df, PATH)
    assert model.langs == ["en", "fr"] and model.table.shape == (L.Pieces(PATH).none + 1, 2)
    got = {r["id"]: r for r in L.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1 for i, _, lang in rows)
    odd = [(None, "the dog"), (1, None), (1, None), (2, ""), (3, "42 !! ..."), (4, "the " * 50_000), (5, "é" * 5000),
           (6, "日本語"), (7, "THE MARKET")]
    out = L.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    by = {r["id"]: r for r in out}
    assert len(out) == len(odd)
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    assert by[4]["lang_pred"] == by[7]["lang_pred"] == by[None]["lang_pred"] == "en" and by[5]["lang_pred"] == "fr"
    assert by[6]["lang_pred"] in ("en", "fr")
    assert L.predict(df.limit(0), model).count() == 0


def test_only_training_rows_are_learned(spark):
    rows, df = _docs(spark)
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = df.selectExpr("doc_id", "text", f"IF(doc_id IN ({','.join(map(str, held))}), 'xx', lang) AS lang")
    a, b = L.fit(df, PATH), L.fit(wrong, PATH)
    assert a.langs == b.langs and np.allclose(a.table, b.table)
    none = L.fit(df.filter("doc_id < 0"), PATH)
    assert {(r["lang_pred"], r["score"]) for r in L.predict(df, none).collect()} == {("und", 0.0)}


def test_small_caches_give_the_same(spark, monkeypatch):
    _, df = _docs(spark)
    want = L.fit(df, PATH).table
    model = L.fit(df, PATH)
    scorer = L._Scorer(model)
    big = scorer.totals([["the", "dog"], ["chien"], []])
    monkeypatch.setattr(L, "CACHE", 2)
    small = L._Scorer(model)
    parts = [small.totals([x])[0] for x in (["the", "dog"], ["chien"], [])]
    assert np.allclose(big, parts) and np.allclose(want, model.table)


def test_held_out_accuracy(spark):
    from equitext.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    out = QUERIES["op5_langid_unigram"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = [r for r in out.collect() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_signs_are_no_letters(spark, pieces):
    assert L.words_of("½ ² ① Ⅷ a½b été x²") == ["a", "b", "été", "x"]
    docs = spark.createDataFrame([(i, "the and of" if i % 2 else "der die und", "en" if i % 2 else "de") for i in range(30)]
                                 + [(100, "½ ²", None), (101, "① Ⅷ 3", None)], "doc_id long, text string, lang string")
    out = {r["id"]: (r["lang_pred"], r["score"]) for r in L.predict(docs, L.fit(docs, PATH)).collect()}
    assert out[100] == out[101] == ("und", 0.0) and out[1][0] == "en"


def test_whole_vocabulary_and_long_words(pieces, monkeypatch):
    assert pieces.longest > 8 and {"▁different", "▁information"} <= set(pieces.pieces)
    r = np.random.default_rng(3)
    table = r.random((pieces.none + 1, 3)) ** 4
    table /= table.sum(0)
    words = ["▁information", "▁unbelievablestories", "▁ж日xthe", "▁" + "theriver" * 3, "▁a"]
    counts = np.arange(1.0, 6.0)
    want = L.forward(pieces, words, table), L.expected(pieces, words, counts, np.ascontiguousarray(table[:, 1]))
    monkeypatch.setattr(L, "TOGETHER", 0)  # all words one by one
    got = L.forward(pieces, words, table), L.expected(pieces, words, counts, np.ascontiguousarray(table[:, 1]))
    assert np.allclose(got[0], want[0], atol=1e-9) and np.allclose(got[1], want[1], atol=1e-9)
    # far below the smallest double, and in time that follows the length
    long = L.forward(pieces, ["▁" + "informationж" * 3000], table)
    assert np.isfinite(long).all() and (long < -5000).all()
    found = L.expected(pieces, ["▁" + "theж" * 500], np.array([2.0]), np.ascontiguousarray(table[:, 0]))
    assert np.isfinite(found).all()
    covered = found @ np.array([*map(len, pieces.pieces), 1])  # every letter lies in one piece
    assert abs(covered - 2 * 2001) < 1e-6
