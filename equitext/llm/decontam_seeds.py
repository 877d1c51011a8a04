"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; positions marked 0 are
ignored, so a substituted word there does not break the match.  The four
masks below together find every overlap of 13 words or more with 0.8 of the
words equal, whichever were substituted (checked in the tests by the best
pattern of each length that no mask fits; from 38 words on a pattern holds a
shorter one that qualifies).  Below 0.8 the seed is the longest run of equal
words that must be there.  Hashes of the benchmark's masked windows are
joined with those of every training window; around each hit the two texts are
laid side by side and the longest stretch with enough equal words is kept.

The benchmark is the stated query set.  It is read in blocks of bounded size;
each block is one scan over all documents, whose rows never leave their task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitext.llm.util import fresh, id_type, saved

#: fixed values: masks for items of at least MIN_WORDS words, and for shorter
MASKS = ("111100011", "1000101111", "1110101001", "1111011")
MASKS_FROM = 0.8
SHORT_MASKS = ("11111",)
MIN_WORDS = 13
#: characters of benchmark text in a block, on average
BLOCK_CHARS = 4_000_000
#: benchmark blocks that one plan holds, at most
AT_ONCE = 4

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOOM_BITS = 20


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def masked_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept positions of every window (empty if none fits)."""
    n = len(ids) - len(mask) + 1
    h = np.full(max(n, 0), len(mask), dtype=np.uint64)
    if n > 0:
        for p, c in enumerate(mask):
            if c == "1":
                h *= _MIX
                h += ids[p:p + n]
                h ^= h >> np.uint64(29)
    return h


def masks_for(similarity: float) -> tuple[str, ...]:
    """Masks that miss no overlap with that share of equal words."""
    if similarity >= MASKS_FROM:
        return MASKS
    s = round(similarity * 1000)
    # k substituted words leave k + 1 runs, the longest with their mean or more
    gone = [(n, n * (1000 - s) // 1000) for n in range(MIN_WORDS, 1000)]
    return ("1" * max(1, min(-((k - n) // (k + 1)) for n, k in gone)),)


class Seeds:
    """Masked windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, str | None]], similarity: float):
        self.similarity = similarity
        self.vocab: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in items:
            found = words(text)
            if len(found) >= len(SHORT_MASKS[0]):
                self.ids.append(item)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in found],
                                           dtype=np.uint64))
        self.tables = []
        for masks, chosen in ((masks_for(similarity), [i for i, w in enumerate(self.words) if len(w) >= MIN_WORDS]),
                              (SHORT_MASKS, [i for i, w in enumerate(self.words) if len(w) < MIN_WORDS])):
            for mask in masks if chosen else ():
                h = [masked_hashes(self.words[i], mask) for i in chosen]
                keys = np.concatenate(h)
                item = np.repeat(chosen, [len(x) for x in h])
                at = np.concatenate([np.arange(len(x)) for x in h])
                order = np.argsort(keys, kind="stable")
                bloom = np.zeros(1 << _BLOOM_BITS, dtype=bool)
                bloom[keys >> np.uint64(64 - _BLOOM_BITS)] = True
                self.tables.append((mask, keys[order], item[order], at[order], bloom))

    def lay(self, doc: np.ndarray, item: int, shift: int) -> tuple[int, int, int, int] | None:
        """Longest stretch of one alignment that begins and ends with an equal
        word and has the wanted share of them: (start in doc, start in item,
        words, equal words)."""
        own = self.words[item]
        lo, hi = max(0, -shift), min(len(own), len(doc) - shift)
        same = doc[lo + shift:hi + shift] == own[lo:hi]
        short = len(own) < MIN_WORDS
        if short:  # a short item counts only whole and word for word
            return (lo + shift, lo, len(own), len(own)) if hi - lo == len(own) and same.all() else None
        # equal words weigh (1 - s), others -s: sums >= 0 are stretches with share >= s
        s = round(self.similarity * 1000)
        run = np.concatenate([[0], np.cumsum(np.where(same, 1000 - s, -s))])
        at = np.flatnonzero(same)
        if not len(at):
            return None
        first = np.minimum.accumulate(run[at])
        # earliest start whose sum is no larger, for a stretch up to each equal word
        start = np.searchsorted(-first, -run[at + 1])
        length = at + 1 - at[start]
        n = int(length.max())
        if n < MIN_WORDS:
            return None
        equal = np.where(length == n, np.arange(1, len(at) + 1) - start, 0)
        end = int(equal.argmax())
        a = int(at[start[end]])
        return a + lo + shift, a + lo, n, int(equal[end])

    def overlaps(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, doc start, item start, words, equal words): the
        longest verified overlap of each text with each item."""
        if not self.words:
            return []
        gap = np.zeros(max(len(m) for m in MASKS + SHORT_MASKS), dtype=np.uint64)
        get = self.vocab.get
        parts, starts, at = [], [], 0
        for t in texts:
            found = words(t)
            ids = np.fromiter((get(w, 0) for w in found), dtype=np.uint64, count=len(found))
            starts.append(at)
            parts += [ids, gap]
            at += len(ids) + len(gap)
        flat, begins = np.concatenate(parts) if parts else gap, np.array(starts)
        seen: set[tuple[int, int, int]] = set()
        for mask, keys, item, pos, bloom in self.tables:
            h = masked_hashes(flat, mask)
            where = np.flatnonzero(bloom[h >> np.uint64(64 - _BLOOM_BITS)])
            left = np.searchsorted(keys, h[where], "left")
            right = np.searchsorted(keys, h[where], "right")
            for w, a, b in zip(where[right > left], left[right > left], right[right > left]):
                doc = int(np.searchsorted(begins, w, "right")) - 1
                for k in range(a, b):
                    seen.add((doc, int(item[k]), int(w - begins[doc] - pos[k])))
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for doc, item, shift in sorted(seen):
            got = self.lay(parts[2 * doc], item, shift)
            if got and ((doc, item) not in best or (got[2], got[3], -got[0]) > (
                    best[doc, item][2], best[doc, item][3], -best[doc, item][0])):
                best[doc, item] = got
        return [(d, i, *v) for (d, i), v in best.items()]


def blocks(bench: DataFrame, similarity: float, block_chars: int = BLOCK_CHARS) -> Iterator[Seeds]:
    """The benchmark in blocks of about ``block_chars``; one at a time is on
    the driver.  NULL items are skipped."""
    items = bench.select(F.col("item_id").alias("id"), F.col("text").cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    n = int(total // block_chars) + 1
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Seeds([(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()], similarity)


def _texts(column: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in groups of bounded characters."""
    first, group, n = 0, [], 0
    for k, x in enumerate(column):
        group.append(x.as_py())
        n += len(group[-1] or "")
        if n >= size:
            yield first, group
            first, group, n = k + 1, [], 0
    if group:
        yield first, group


def find_overlaps(docs: DataFrame, bench: DataFrame, similarity: float = 0.8, id_col: str = "doc_id",
                  text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, doc_word, item_word, n_words, n_equal, similarity): for
    each document and benchmark item the longest overlap of at least
    MIN_WORDS words with the wanted share of equal words.

    Words are lower-cased runs of letters and digits.  Items of 5 to 12 words
    count only whole and exact; shorter ones are not searched.  NULL and
    empty texts and items overlap nothing; repeated rows give rows each; an
    empty table gives an empty result; other columns are not read.
    """
    kinds = (id_type(docs, id_col), id_type(bench, "item_id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "item_id", "doc_word", "item_word", "n_words", "n_equal", "similarity"]
    schema = (f"id {kinds[0]}, item_id {kinds[1]}, doc_word bigint, item_word bigint, n_words bigint, "
              "n_equal bigint, similarity double")
    out, planned = None, 0
    for seeds in blocks(bench, similarity, block_chars):
        def run(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(first + d, *rest) for first, texts in _texts(batch.column(1))
                         for d, *rest in seeds.overlaps(texts)]
                if found:
                    row, item, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([seeds.ids[i] for i in item]),
                         *(pa.array(c, pa.int64()) for c in rest),
                         pa.array([e / n for n, e in zip(rest[2], rest[3])])], names)
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
        planned += 1
        if planned == AT_ONCE:
            # what is planned is run and let go, with the blocks that it holds
            out, planned = saved(out, "decontam-overlaps"), 0
    return out


def _flag(seeds: Seeds) -> Column:
    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            flags = np.zeros(len(part), dtype=bool)
            for first, texts in _texts(pa.array(part, pa.string())):
                for d, *_ in seeds.overlaps(texts):
                    flags[first + d] = True
            yield pd.Series(flags)

    return run


def drop_contaminated(docs: DataFrame, bench: DataFrame, similarity: float = 0.8,
                      text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that overlap any benchmark item; all columns
    as they are."""
    leak, planned = fresh(docs, "leak"), 0
    for seeds in blocks(bench, similarity, block_chars):
        docs = docs.withColumn(leak, _flag(seeds)(F.col(text_col).cast("string"))).filter(~F.col(leak)).drop(leak)
        planned += 1
        if planned == AT_ONCE:
            docs, planned = saved(docs, "decontam-kept"), 0
    return docs
