import heapq
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from equitext.llm import bpe_words, huffman_ids
from equitext.llm.huffman_ids import Decoder, canonical, code_lengths, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_lengths_and_round_trip(seed):
    r = np.random.default_rng(seed)
    counts = (r.pareto(0.6, 300) * 3).astype(np.int64)
    counts[r.integers(0, 300, 40)] = 0
    free = code_lengths(counts, 40)
    assert int((free * counts).sum()) == huffman_cost(counts)
    for limit in (9, 12, 18):
        lengths = code_lengths(counts, limit)
        assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
        assert (lengths * counts).sum() >= (free * counts).sum()
        ids = r.choice(300, 5000, p=counts / counts.sum())
        for n in (0, 1, 99, 100, 101, 5000):
            bits, checkpoints = pack(ids[:n], lengths, canonical(lengths), 100)
            assert (Decoder(lengths).unpack(bits, checkpoints, n, 100) == ids[:n]).all()


def test_one_symbol_and_too_many():
    counts = np.zeros(10, dtype=np.int64)
    counts[7] = 5
    lengths = code_lengths(counts)
    bits, checkpoints = pack(np.full(5, 7), lengths, canonical(lengths), 2)
    assert Decoder(lengths).unpack(bits, checkpoints, 5, 2).tolist() == [7] * 5
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, dtype=np.int64), 3)


TEXTS = [None, "", " ", "  two  spaces ", "a b\nc\n\n d \n e", "it's I'll 1234 5,6", "tab\t x\x1cy \x85 z\xa0 q", "é à ü",
         "日本 語", "<|endoftext|> x", "x<|endoftext|>", "\n", "end\n", "don't won't 'tis", "a\r\nb", " lead", "😀 ok"]


def check(spark, docs: dict, out) -> None:
    t = bpe_words.load(PATH)
    start = 0
    for (i, text), r in zip(sorted(docs.items(), key=lambda x: (x[0] is not None, x[0])), out, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (i, start, ids)
        start += len(ids)


def test_files_match_library(spark):
    docs = {i: x for i, x in enumerate(TEXTS)} | {None: "no id"}
    df = spark.createDataFrame([(i, x, 1) for i, x in docs.items()], "doc_id long, text string, ids int").repartition(5)
    target = huffman_ids.fresh_target(spark)
    huffman_ids.write_ids(df, PATH, target)
    check(spark, docs, huffman_ids.read_ids(spark, target).orderBy("start").collect())


ODD = ["\x85", "\xa0", "\x1c", "\u0130", "\u0250", "\u02bc", "日", "😀", "<|endoftext|>", "<|endof", "  "]


def mixed_texts(seed: int, n: int = 1500) -> list:
    r = random.Random(seed)
    signs = list("aabTsdlv09  ''\n\n\t\r.,;(-#\x00\x0b") + [
        "×", "÷", "²", "ª", "«", "\xad", "ė", "ķ", "é", "ß", "À", "ǅ", "ɏ", "'s", "'ll", " '", "the ", " and"]
    out: list = [None, ""]
    for _ in range(n):
        of = signs + ODD * (r.random() < 0.2)
        of = [x for x in of if x != " "] if r.random() < 0.3 else of
        out.append("".join(r.choice(of) for _ in range(r.choice((1, 2, 3, 8, 30)))))
    return out


@pytest.mark.parametrize("size", [1, 700, 1 << 20])
def test_mixed_texts_match_library(size):
    t = bpe_words.load(PATH)
    texts = mixed_texts(size)
    column = pa.array(["before", *texts]).slice(1)
    enc = huffman_ids.Ids(PATH, 20_000)  # a small store, emptied often
    got = [x for a, b in huffman_ids._slices(column, size) for x in enc.encode(column.slice(a, b - a), 2).to_pylist()]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text or "", add_special_tokens=False).ids + [2], text


def test_pieces_join_to_their_texts():
    texts = [x or "" for x in mixed_texts(5)]
    pieces, edges = huffman_ids.cut(pa.array(texts, pa.large_string()))
    pieces = pieces.to_pylist()
    assert ["".join(pieces[a:b]) for a, b in zip(edges, edges[1:])] == texts
    # a word is one piece whatever follows it
    pieces, _ = huffman_ids.cut(pa.array(["Ein wörd. Ein\nÄrd, wörd"], pa.large_string()))
    assert pieces.to_pylist() == ["Ein", " wörd", ".", " Ein", "\n", "Ärd", ",", " wörd"]


class Counted:
    """A model that counts its calls."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def encode_batch_fast(self, *a, **k):
        self.calls += 1
        return self.model.encode_batch_fast(*a, **k)


def test_new_words_are_encoded_many_in_a_call():
    enc = huffman_ids.Ids(PATH)
    enc.model = Counted(enc.model)
    words = ["".join(w) for w in itertools.product("bcdfgh", "aeiou", "lmnrst", "aeiou", "xyz")]
    texts = pa.array([" ".join(words[i:i + 50]) + "." for i in range(0, len(words), 50)])
    first = enc.encode(texts, 2)
    assert 0 < enc.model.calls <= len(words) // huffman_ids.LEARN + 2
    calls = enc.model.calls
    assert enc.encode(texts, 2) == first and enc.model.calls == calls
    t = bpe_words.load(PATH)
    assert [np.frombuffer(x, "<u2").tolist() for x in first.to_pylist()] == [
        t.encode(x, add_special_tokens=False).ids + [2] for x in texts.to_pylist()]


def test_empty_table(spark):
    target = huffman_ids.fresh_target(spark)
    huffman_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), PATH, target)
    assert huffman_ids.read_ids(spark, target).count() == 0


def test_query_on_small_table(spark):
    from equitext.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    t = bpe_words.load(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    out = QUERIES["op9_huffman_ids"](spark, sf).orderBy("doc_id").collect()
    start = 0
    for d, r in zip(docs, out, strict=True):
        ids = np.array(t.encode(d["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (
            d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
