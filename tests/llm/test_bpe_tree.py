import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from equitext.llm import bpe_tree, bpe_words
from equitext.llm.bpe_tree import LEAF, Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def enc():
    return Encoder(PATH)


def _long(seed: int, n: int, alphabet: str) -> str:
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def test_joins_equal_whole_encoding(enc):
    for seed in range(60):
        word = _long(seed, 300, ["abcdet", "thea", "aaab", "éàa", "onrestin"][seed % 5])
        letters = bpe_words.spelled(word)
        for leaf in (3, 17, 64):
            leaves = bpe_tree.halves(letters, leaf)
            parts = [enc.tokenize(x, i + 1 == len(leaves)) for i, x in enumerate(leaves)]
            assert enc.tree(parts) == enc.tokenize(letters, True), (seed, leaf)


TEXTS = [
    None, "", " ", "a", "Hello, World!! it's they're 42nd", "naïve café́ é", "x\x1cy", "İstanbul ΣΑΣ",
    "日本語テキスト mixed 漢字", "<|endoftext|> end <|startoftext|>x", "a b c", "tab\tnew\nline\r\n",
    "😀 emoji 👨‍👩‍👧", _long(1, LEAF * 3 + 7, "theoansi") + " tail's", "x " + _long(2, LEAF + 5, "!?#$"),
    "é" * (LEAF * 2) + " ok", _long(4, 3 * LEAF, "abcd") + "<|endoftext|>" + _long(5, 2 * LEAF, "efg"), "字" * (LEAF + 100),
]


def test_matches_library(spark):
    t = bpe_words.load(PATH)
    df = spark.createDataFrame([(i, x, 7) for i, x in enumerate(TEXTS)] + [(None, "Twice", 7)] * 2,
                               "doc_id long, text string, ids int")
    rows = bpe_tree.decode(bpe_tree.encode(df, PATH), PATH).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "Twice" if r["id"] is None else TEXTS[r["id"]] or ""
        want = t.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert got == want, r["id"]
        assert r["text"] == t.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_tree.decode(bpe_tree.encode(df, PATH), PATH).count() == 0


def test_query_on_small_table(spark):
    from equitext.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    t = bpe_words.load(PATH)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op8_bpe_tree"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
