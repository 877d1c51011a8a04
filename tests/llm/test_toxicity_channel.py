import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from equitext.llm import toxicity_channel as T


def _tables(spark, n=400):
    r = random.Random(4)
    vocab = ["house", "river", "quiet", "stone", "window", "garden", "train", "paper", "light", "winter", "bridge", "coffee"]
    bad = ["grobnik", "vultrash", "snarfel"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            for w in r.sample(bad, r.randint(1, 3)):
                words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = _tables(spark)
    return docs, labels, T.fit(docs, labels)


def test_held_out_rows_and_hidden_words(spark, fitted):
    docs, labels, model = fitted
    out = T.score(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in out if r["held_out"]]
    assert {r["id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == truth[r["id"]] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    cache = T._cache(model.chars)
    for hidden, plain in (("gr0bnik", "grobnik"), ("g r o b n i k", "grobnik"), ("snaaarfel", "snarfel"),
                          ("vultr4$h", "vultrash"), ("$NARFEL", "snarfel")):
        assert plain in T.words_of(f"the quiet {hidden} house", model.chars, cache), hidden
    for plain in ("a quiet house", "stone!! window?", "costs 400 at 10:30", "(paper) light."):
        assert T.restore(plain, model.chars, cache) == plain


@pytest.mark.parametrize("hidden", [
    "g r o b n i k", "g r 0 b n 1 k", "g.r.0.b.n.1.k", "g_r_0_b_n_1_k", "g  r  o  b  n  i  k", "g -r -0 -b -n -1 -k", "g r  0 b n  1 k",
    "ggg r ooo b nnn i k", "g r 000 b n 1 k", "gr000bnik", "grrr0bn111k", "grobnik!", "gr0bnik!!.", "g r 0 b n 1 k!", "$n4rf3l", "$ n 4 r f 3 l",
    "5 n 4 r f 3 l", "vultra$h", "vultr@$h", "v u l t r 4 $ h", "v  u  l  t  r  4  $$$  h", "vvvultr444$h"])
def test_spacing_leetspeak_and_repetition_together(fitted, hidden):
    model = fitted[2]
    cache = T._cache(model.chars)
    for text in (hidden, f"the quiet {hidden} house", f"the quiet {hidden.upper()}"):
        words = T.words_of(text, model.chars, cache)
        assert words & {"grobnik", "snarfel", "vultrash"}, (text, words)


@pytest.mark.parametrize("text", ["m 0 r 0 n", "1 d 1 0 t", "h 4 t 3", "l 0 s 3 r", "1.d.1.0.t", "m  o  r  o  n", "a$$", "as+", "x@", "a$", "7 0 7"])
def test_gate_lets_every_sign_through(fitted, text):
    cache = T._cache(fitted[2].chars)
    for t in (text, f"so {text} it is", f"({text})"):
        assert T.suspicious(t, T.symbols(t)), t
    assert not any(T.suspicious(t, T.symbols(t)) for t in ("a quiet house", "stone!! window?", "costs 400 at 10:30", "(paper) light."))


def test_gate_is_no_narrower_than_the_channel(fitted):
    cache = T._cache(fitted[2].chars)
    r = random.Random(8)
    for _ in range(4000):
        t = "".join(r.choice("aab4$!0+2 .-_ *,é") for _ in range(r.randint(1, 9)))
        assert T.suspicious(t, T.symbols(t)) or T.restore(t, fitted[2].chars, cache) == t, t


def test_trailing_signs_are_letters(fitted):
    model = fitted[2].chars
    assert T.lattice("a$$", False)[1:] == [[("s", T.AS_LETTER), ("$", T.AS_SIGN)]] * 2
    flat = np.zeros_like(model)
    for text, word in (("a$$", "ass"), ("a$$!", "ass"), ("grea+", "great"), ("m o r o n  y o u", "moron"), ("m  o r  o n", "moron")):
        assert word in T.words_of(text, flat, T._cache(flat)), text


def test_viterbi_is_the_cheapest_path(fitted):
    model = fitted[2].chars
    import itertools

    def cost(path):
        text, total = "".join(p for p, _ in path) + " ", sum(c for _, c in path)
        a = b = 0
        for ch in text:
            s = T.symbol(ch)
            total -= float(model[a, b, s])
            a, b = b, s
        return total

    for word, spaced in (("h0u5e", False), ("rrrivver", False), ("w 1 n", True), ("1337", False)):
        cells = T.lattice(word, spaced)
        best = min(itertools.product(*cells), key=cost)
        assert T.viterbi(cells, model) == "".join(p for p, _ in best)


def test_odd_rows(spark, fitted):
    docs, labels, model = fitted
    rows = [(None, "a grobnik"), (1, None), (1, None), (2, ""), (3, "  \n"), (4, "9 " * 5000), (5, "snarfel " * 20_000),
            (6, "k" * 50_000), (7, "日本 \x00 \x1f $$$ 000")]
    odd = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")
    out = odd.select("doc_id", model.score()(F.col("text")).alias("s")).collect()
    base = 1 / (1 + np.exp(-model.bias))
    by = {r["doc_id"]: r["s"] for r in out}
    assert len(out) == len(rows) and by[None] > 0.5 and by[5] > 0.5
    assert all(abs(by[i] - base) < 1e-12 for i in (1, 2, 3, 4, 6))
    left = T.drop_toxic(docs.withColumn("score", F.lit(1)), labels)
    truth = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
    assert left.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in left.collect()} == truth


def test_empty_and_unlabelled_tables(spark):
    docs, labels = _tables(spark, 12)
    assert T.score(docs.limit(0), labels).count() == 0
    assert [r["score"] for r in T.score(docs, labels.limit(0)).collect()] == [0.5] * 12
    only = labels.select("doc_id", F.lit(0).alias("toxic"))
    assert all(r["score"] < 0.5 for r in T.score(docs, only).collect())


def test_held_out_accuracy_on_the_table(spark):
    from equitext.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op4_toxicity_channel"](spark, sf).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got]
    held = [(got[i]["score"], y) for i, y in labels if got[i]["held_out"]]
    pos, neg = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert auc > 0.9 and (neg >= 0.5).mean() < 0.02


@pytest.mark.parametrize("sign", list("!$|.a1 *-"))
def test_long_runs_take_linear_time(fitted, sign):
    import time

    cache = T._cache(fitted[2].chars)
    at = time.process_time()
    T.words_of("h4te " + sign * 100_000 + " m o r o n", fitted[2].chars, cache)
    assert time.process_time() - at < 1
    # a long run says what a shorter one says
    short, long = (T.words_of(f"h4te stu{'u' * n}pid", fitted[2].chars, cache) for n in (60, 5000))
    assert {w for w in short if w[:3] == "hat"} == {w for w in long if w[:3] == "hat"}


def test_cache_keeps_short_parts_only(fitted):
    cache = T._cache(fitted[2].chars, entries=2, longest=3)
    assert [cache(p, False) for p in ("h4t", "h4te", "4t", "h4", "h4t")] == [
        T.viterbi(T.lattice(p, False), fitted[2].chars) for p in ("h4t", "h4te", "4t", "h4", "h4t")]
