"""Toxicity by noisy-channel deobfuscation.

A text may hide words behind leetspeak (``1d10t``), stretched letters
(``stuuupid``) or spacing (``m o r o n``).  Where a text shows such signs, a
lattice of what each character may stand for is decoded by Viterbi under a
character trigram model counted over the whole corpus.  The restored text is
then scored by a short list of word and word-beginning features with a
logistic link, both fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitext.llm.util import fold, fresh, saved

#: fixed values: characters that stand for letters
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: channel costs (negative log probabilities): a sign means a letter, a sign
#: means itself, letters were stretched, a space inside a word is noise
AS_LETTER, AS_SIGN, STRETCHED, SPACED = 0.7, 6.0, 0.7, 0.4

#: symbols of the character model: 0 for all that is no letter, a-z, the
#: letters U+00DF-U+00FF, one for every other letter
FIRST_ACCENT, LAST_ACCENT = 0xDF, 0xFF
OTHER = 27 + LAST_ACCENT - FIRST_ACCENT + 1
SYMBOLS = OTHER + 1

#: rows of the classifier's sample, at most
FIT_ROWS = 20_000
MIN_HITS = 5
MIN_WEIGHT = 2.5
PREFIXES = (7, 6, 5, 4)

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = "".join(LEET)
_TOKEN = re.compile(r"\S+")
_LEET_TOKEN = re.compile(rf"[^\W\d_][{re.escape(_SIGNS)}]|[{re.escape(_SIGNS)}][^\W\d_]")
_RUN = re.compile(r"([^\W\d_])\1\1+")
_MARK = rf"(?:([^\W\d_{re.escape(_SIGNS)}])(?:\1\1+)?|([{re.escape(_SIGNS)}])(?:\2\2+)?)"
_LAST = _MARK.replace(r"\1", r"\3").replace(r"\2", r"\4")
_SPACED = re.compile(rf"(?<!\w)(?:{_MARK}[ .\-_*]+){{2,}}{_LAST}(?!\w)")
_GAP = re.compile(r"[ .\-_*]+")
#: a longer run of one character says no more than one of this length, and costs
#: the patterns above its square
LONG_RUN = 40
_LONG_RUN = re.compile(rf"(.)\1{{{LONG_RUN},}}", re.S)
#: punctuation around a word; of the signs only ! and | where they trail it
_AROUND, _TRAIL = ".,;:?*%&#\"'", "!|"
_INSIDE = re.compile(rf"[^\W\d_][{_TRAIL}][{re.escape(_AROUND + _TRAIL)}]*[^\s{re.escape(_AROUND + _TRAIL)}]")


def _symbol_table() -> np.ndarray:
    t = np.zeros(0x250, dtype=np.int64)
    t[ord("a"):ord("z") + 1] = np.arange(1, 27)
    for c in range(FIRST_ACCENT, LAST_ACCENT + 1):
        t[c] = 27 + c - FIRST_ACCENT if chr(c).isalpha() else 0
    for c in range(0x100, 0x250):
        t[c] = OTHER
    return t


_TABLE = _symbol_table()
_SIGN_TABLE = np.zeros(0x250, dtype=np.int8)  # 1 for a sign, 2 for one that may end a word
for _c in LEET:
    if ord(_c) < 0x24F:
        _SIGN_TABLE[ord(_c)] = 1 + (_c not in _TRAIL)


def symbol(c: str) -> int:
    o = ord(c)
    return int(_TABLE[o]) if o < 0x250 else OTHER if c.isalpha() else 0


def symbols(text: str) -> np.ndarray:
    """Model symbols of lower-cased text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _TABLE[np.minimum(points, 0x24F)]
    far = points >= 0x250
    if far.any():
        out[far] = [symbol(chr(p)) for p in points[far]]
    return out


def suspicious(text: str, syms: np.ndarray) -> bool:
    """Whether lower-cased text shows any sign of the channel: three equal
    letters in a row, a letter beside a sign, or single letters or signs in a
    row.  True for all that ``restore`` would change."""
    letter = syms > 0
    if len(syms) < 3:  # a letter and a sign
        return len(syms) == 2 and _LEET_TOKEN.search(text) is not None
    if (letter[2:] & (syms[2:] == syms[1:-1]) & (syms[1:-1] == syms[:-2])).any():
        return True
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sign = _SIGN_TABLE[np.minimum(points, 0x24F)]
    # a sign before a letter, or one that may end a word after it; ! and | that
    # only trail a word are punctuation
    if ((sign[:-1] > 0) & letter[1:]).any() or ((sign[1:] > 1) & letter[:-1]).any():
        return True
    if ((sign[1:] == 1) & letter[:-1]).any() and _INSIDE.search(text):
        return True
    # three letters or signs, stretched or not, with gaps between, the outer
    # ones at no word
    new = np.concatenate([[True], points[1:] != points[:-1]])
    more = np.concatenate([~new[1:], [False]])[new]  # a run may begin or end inside
    points, letter, sign = points[new], letter[new], sign[new]
    at = np.flatnonzero(letter | (sign > 0))
    if len(at) < 3:
        return False
    word = np.concatenate([[False], letter | (points >= 48) & (points <= 57), [False]])
    gap = np.diff(at) > 1
    first, last = at[:-2], at[2:]
    return bool((gap[:-1] & gap[1:] & (more[first] | ~word[first]) & (more[last] | ~word[last + 2])).any())


# --- character model ----------------------------------------------------

def char_counts(docs: DataFrame, text_col: str = "text", block: int = 1 << 20) -> DataFrame:
    """(code, n): trigrams of model symbols over all rows; code holds the
    three symbols in base SYMBOLS.  NULL and empty texts add nothing."""

    def count(text: str, total: np.ndarray) -> None:
        s = symbols(text)
        if len(s) > 2:
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            short, size = [], 0
            for x in batch.column(0):
                text = f" {x.as_py().lower()} "
                if len(text) > block:  # in overlapping pieces: each trigram counts once
                    for at in range(0, len(text), block):
                        count(text[max(0, at - 2):at + block], total)
                    continue
                short.append(text)
                size += len(text)
                if size > block:
                    count("".join(short), total)
                    short, size = [], 0
            count("".join(short), total)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], ["code", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(counts: DataFrame) -> np.ndarray:
    """log P(third | first two), at most SYMBOLS ** 3 numbers on the driver
    whatever the input; smoothed by the bigram and unigram shares."""
    n = np.zeros(SYMBOLS**3)
    table = counts.toArrow()
    n[table["code"].to_numpy()] = table["n"].to_numpy()
    tri = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    uni = tri.sum((0, 1)) + 1.0
    uni /= uni.sum()
    two = tri.sum(0)
    two = (two + 20 * uni) / (two.sum(-1, keepdims=True) + 20)
    tri = (tri + 20 * two[None]) / (tri.sum(-1, keepdims=True) + 20)
    return np.log(tri).astype(np.float32)


# --- the channel ----------------------------------------------------------

def lattice(text: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """What each position may stand for: [(restored, channel cost), ...]."""
    cells: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(text):
        c = text[i]
        j = i
        while j < len(text) and text[j] == c:
            j += 1
        if c in LEET and j - i > 2:
            cells.append([(x * n, AS_LETTER + STRETCHED) for x in LEET[c] for n in (1, 2)] + [(c * (j - i), AS_SIGN)])
        elif c in LEET:
            for _ in range(i, j):
                cells.append([(x, AS_LETTER) for x in LEET[c]] + [(c, AS_SIGN)])
        elif c.isalpha() and j - i > 2:
            cells.append([(c, STRETCHED), (c + c, STRETCHED)])
        elif spaced and not c.isalnum():
            cells.append([("", SPACED), (c, AS_SIGN)])
        else:
            cells.extend([[(c, 0.0)]] * (j - i))
        i = j
    return cells


def viterbi(cells: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """Cheapest path through the lattice under the character model."""
    best = {(0, 0): (0.0, None)}
    for options in [*cells, [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (p, q), (cost, out) in best.items():
            for piece, price in options:
                a, b, total = p, q, cost + price
                for ch in piece:
                    s = symbol(ch)
                    total -= float(model[a, b, s])
                    a, b = b, s
                if (a, b) not in new or total < new[a, b][0]:
                    new[a, b] = (total, (out, piece))
        best = new
    out, pieces = min(best.values(), key=lambda x: x[0])[1], []
    while out:
        out, piece = out
        pieces.append(piece)
    return "".join(pieces[:0:-1])


def restore(text: str, model: np.ndarray, cache) -> str:
    """Lower-cased text with every suspicious part decoded."""

    def joined(m: re.Match) -> str:
        part = m[0]
        gaps = {len(g) for g in _GAP.findall(part)}
        if len(gaps) == 1:
            return cache(part, True)
        # uneven gaps: the wider ones may part words or be noise as well
        words = [w for w in re.split(rf"[ .\-_*]{{{min(gaps) + 1},}}", part) if w]
        return f"{' '.join(cache(w, True) for w in words)} {cache(part, True)}"

    text = _SPACED.sub(joined, _LONG_RUN.sub(r"\1" * LONG_RUN, text))

    def token(m: re.Match) -> str:
        t = m[0]
        # ! and | that only trail a word are punctuation, not letters
        core = t.strip(_AROUND).rstrip(_AROUND + _TRAIL)
        if _RUN.search(core) or _LEET_TOKEN.search(core):
            return t.replace(core, cache(core, False), 1)
        return t

    return _TOKEN.sub(token, text)


def words_of(text: str | None, model: np.ndarray, cache) -> set[str]:
    """Distinct restored words; NULL and empty texts have none."""
    low = (text or "").lower()
    if low and suspicious(low, symbols(low)):
        plain, low = low, restore(low, model, cache)
        return set(_WORD.findall(low)) | set(_WORD.findall(plain))
    return set(_WORD.findall(low))


def _cache(model: np.ndarray, entries: int = 50_000, longest: int = 64):
    """Decoder of parts that remembers at most ``entries`` short ones."""
    held = lru_cache(maxsize=entries)(lambda part, spaced: viterbi(lattice(part, spaced), model))
    return lambda part, spaced: (held if len(part) <= longest else held.__wrapped__)(part, spaced)


# --- the classifier -------------------------------------------------------

def word_features(word: str) -> list[str]:
    return [word[:n] + "*" for n in PREFIXES if len(word) >= n] + ([word] if len(word) > 1 else [])


@dataclass
class Toxicity:
    """Fitted model: feature weights, logistic link, character model."""

    chars: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    bias: float = 0.0

    def raw(self, words: set[str]) -> float:
        heads = {f[:4].rstrip("*") for f in self.weights}
        return self._raw(words, heads)

    def _raw(self, words: set[str], heads: set[str]) -> float:
        hit = {f for w in words if w[:4] in heads for f in word_features(w) if f in self.weights}
        return sum(self.weights[f] for f in hit)

    def score(self) -> Column:
        """Column function text -> score in 0..1."""
        model = self

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache = _cache(model.chars)
            heads = {f[:4].rstrip("*") for f in model.weights}
            for part in parts:
                x = np.array([model._raw(words_of(t, model.chars, cache), heads) for t in part])
                yield pd.Series(1 / (1 + np.exp(-(model.bias + model.slope * x))), dtype="float64")

        return run


def _sample(docs: DataFrame, labels: DataFrame, rows: int, folds: int) -> DataFrame:
    """At most ``rows`` labelled rows (text, toxic) outside the held-out fold,
    in the order of a hash of the id; repeated texts count once."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & (fold("id", folds) != 0))
    picked = known.orderBy(F.xxhash64("id"), "id", "toxic").limit(rows).dropDuplicates(["id"])
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    # at most ``rows`` narrow rows: safe to broadcast
    return texts.join(F.broadcast(picked), "id").select(
        F.xxhash64("text").alias("key"), "text", "toxic").dropDuplicates(["key"]).select("text", "toxic")


def _features(sample: DataFrame, chars: np.ndarray) -> DataFrame:
    """(f): the distinct features of each sampled row, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(chars)
        for batch in batches:
            out = [f for x in batch.column(0)
                   for f in {f for w in words_of(x.as_py(), chars, cache) for f in word_features(w)}]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["f"])

    return sample.select("text").mapInArrow(run, "f string")


def _hits(sample: DataFrame, chars: np.ndarray, only: list[str]) -> DataFrame:
    """(toxic, hits): which features of ``only`` each sampled row has."""
    place = {f: i for i, f in enumerate(only)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(chars)
        for batch in batches:
            out = []
            for x in batch.column(0):
                found = {f for w in words_of(x.as_py(), chars, cache) for f in word_features(w)}
                out.append([place[f] for f in found & place.keys()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["toxic", "hits"])

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, hits array<int>")


def _unlike(rows: list[np.ndarray], hashes: int = 16, same: int = 11) -> list[np.ndarray]:
    """Rows that are no near copies of an earlier one (``same`` equal
    min-hashes of ``hashes``), so that a copied text counts once.  The rows
    are those of the bounded sample."""
    seen: dict[tuple[int, int], list[int]] = {}
    out: list[np.ndarray] = []
    odd = np.uint64(0x9E3779B97F4A7C15)
    for row in rows:
        if not len(row):
            continue
        base = (row.astype(np.uint64) + np.uint64(1)) * odd
        marks = [int(((base ^ (base >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                      >> np.uint64(20)).min()) for k in range(hashes)]
        shared = Counter(i for k, m in enumerate(marks) for i in seen.get((k, m), ()))
        if shared and shared.most_common(1)[0][1] >= same:
            continue
        for k, m in enumerate(marks):
            seen.setdefault((k, m), []).append(len(out))
        out.append(row)
    return out


def _choose(names: list[str], pos: list[np.ndarray], neg: np.ndarray, n_neg: int) -> dict[str, float]:
    """Features by their toxic rows less twice their clean rows; of features
    that begin alike, the first in that order."""
    hits = np.bincount(np.concatenate([*pos, np.zeros(0, dtype=np.int32)]).astype(np.int64), minlength=len(names))
    gain = hits - 2 * neg
    order = sorted(np.flatnonzero(gain >= MIN_HITS).tolist(),
                   key=lambda i: (-gain[i], not names[i].endswith("*"), -len(names[i]), names[i]))
    weights: dict[str, float] = {}
    stems: list[str] = []
    for i in order:
        stem = names[i].rstrip("*")
        w = float(np.log((hits[i] + 0.5) / (len(pos) + 1)) - np.log((neg[i] + 0.5) / (n_neg + 1)))
        if w >= MIN_WEIGHT and not any(stem.startswith(x) or x.startswith(stem) for x in stems):
            weights[names[i]] = w
            stems.append(stem)
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, bias) by Newton steps on the standardised sum."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5) -> Toxicity:
    """Character model from all texts of ``docs``; classifier from at most
    ``fit_rows`` labelled rows whose crc32(id) mod ``folds`` is not 0.

    Without labelled rows, or with one class only, the score is constant."""
    chars = char_model(char_counts(docs))
    sample = saved(_sample(docs, labels, fit_rows, folds), "tox-sample")
    toxic, clean = sample.filter("toxic = 1"), sample.filter("toxic = 0")
    common = _features(toxic, chars).groupBy("f").count().filter(F.col("count") >= MIN_HITS).select("f")
    names = sorted(common.toArrow()["f"].to_pylist())
    rows = _hits(toxic, chars, names).select("hits").toArrow()["hits"]
    pos = _unlike([np.sort(x.values.to_numpy()) for x in rows])
    n_pos, n_neg = len(rows), clean.count()
    neg = np.zeros(len(names), dtype=np.int64)
    found = _hits(clean, chars, names).select(F.explode("hits").alias("f")).groupBy("f").count().toArrow()
    neg[found["f"].to_numpy()] = found["count"].to_numpy()
    weights = _choose(names, pos, neg, n_neg)
    model = Toxicity(chars, weights)
    if not n_pos or not n_neg:
        model.bias = 0.0 if not n_pos and not n_neg else -3.0 if not n_pos else 3.0
        return model
    chosen = list(weights)
    found = _hits(sample, chars, chosen).toArrow()
    value = np.array([weights[f] for f in chosen])
    x = np.array([value[h.values.to_numpy()].sum() for h in found["hits"]])
    y = found["toxic"].to_numpy().astype(float)
    model.slope, model.bias = _logistic(x, y)
    return model


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``.

    NULL and empty texts have no words and get the score of a text without
    any feature; a NULL id has a NULL held_out; repeated rows are scored
    each; other columns are not read; an empty table gives an empty result.
    """
    model = fit(docs, labels, fit_rows, folds)
    return docs.select(
        F.col("doc_id").alias("id"), (fold("doc_id", folds) == 0).alias("held_out"),
        model.score()(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; all columns as they are."""
    model = fit(docs, labels, fit_rows, folds)
    mark = fresh(docs, "toxicity")
    marked = docs.withColumn(mark, model.score()(F.col("text").cast("string")))
    return marked.filter(F.col(mark) < 0.5).drop(mark)
