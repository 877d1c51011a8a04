"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public
vocabulary.  A word's probability is the sum over all its segmentations into
pieces, which a forward pass over its letters gives exactly; a text's score
for a language is the sum of the logarithms over its words.  Piece
probabilities are expected counts of forward-backward passes over the
training texts: one round of EM from a prior by the vocabulary's order.  Words are
handled many at a time: those of equal length form a matrix, and one numpy step
advances all of them by one piece length; very long ones are walked one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitext.llm.util import fold, id_type

#: letters of words that are handled many at a time; longer words are walked
#: one by one with rescaled values, so no probability underflows
TOGETHER = 32
#: letters of a piece that are tried at every place; longer pieces only where
#: the first so many letters of one stand
TRIED = 8
#: probability of a letter that the vocabulary does not hold
UNSEEN = 1e-9
#: distinct pieces of text kept by a worker, and gathered before a pass
CACHE = 300_000
#: characters of text handled at once
BLOCK = 2_000_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Lower-case letter pieces of a public vocabulary, found by hash."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            body = p.removeprefix(_START)
            if p and p == p.lower() and (body == "" or body.isalpha()):
                found.append(p)
        self.pieces = found
        self.longest = max(map(len, found), default=1)
        self.prior = 1.0 / (np.arange(len(found)) + 10.0)  # pieces come in order of frequency
        self.prior /= self.prior.sum()
        keys = np.array([_hash(p) for p in found], dtype=np.uint64)
        self.keys = np.append(keys, np.uint64(0))
        self.none = len(found)
        # two direct tables; those that collide in the first are in the second
        self.first = np.full(1 << 21, self.none, dtype=np.int32)
        slots = (keys * _MIX) >> np.uint64(43)
        ids = np.arange(len(found))
        self.first[slots[::-1]] = ids[::-1]
        left = ids[self.first[slots] != ids]
        self.shift = 48
        while True:
            size = 1 << (64 - self.shift)
            other = (keys[left] * (_MIX | np.uint64(1 << 40))) >> np.uint64(self.shift)
            if len(np.unique(other)) == len(left):
                break
            self.shift -= 1
        self.second = np.full(size, self.none, dtype=np.int32)
        self.second[other] = left

        self.more = np.zeros(1 << 21, dtype=bool)
        heads = np.array([_hash(h) for h in {p[:TRIED] for p in found if len(p) > TRIED}], dtype=np.uint64)
        self.more[(heads * _MIX) >> np.uint64(43)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        a = self.first[(h * _MIX) >> np.uint64(43)]
        miss = self.keys[a] != h
        if miss.any():
            g = h[miss]
            b = self.second[(g * (_MIX | np.uint64(1 << 40))) >> np.uint64(self.shift)]
            a[miss] = np.where(self.keys[b] == g, b, self.none)
        return a

    def lattice(self, parts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | slice, np.ndarray]]:
        """(start, length, rows, their piece ids or ``none``) over a matrix of
        letters; rows that are left out have no piece there."""
        width = parts.shape[1]
        for j in range(width):
            h, rows = np.zeros(len(parts), dtype=np.uint64), slice(None)
            for n in range(1, min(self.longest, width - j) + 1):
                h = (h + parts[rows, j + n - 1] + np.uint64(1)) * _BASE
                yield j, n, rows, self.find(h)
                if n == TRIED:
                    rows = np.flatnonzero(self.more[(h * _MIX) >> np.uint64(43)])
                    if not len(rows):
                        break
                    h = h[rows]


def words_of(text: str) -> list[str]:
    """Runs of letters; signs such as fractions, which Python's ``\\w`` takes
    for word characters, are none."""
    found = _LETTERS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h + ord(c) + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF
    return h


def marked(word: str) -> str:
    """A word with the word-start mark."""
    return _START + word


def _ids(pieces: Pieces, word: str) -> np.ndarray:
    """(start, length - 1) to the piece there, ``none`` where there is none or
    the word ends before."""
    letters = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    width = len(letters)
    out = np.full((width, pieces.longest), pieces.none, dtype=np.int64)
    h = np.zeros(width, dtype=np.uint64)
    for n in range(1, min(pieces.longest, width) + 1):
        h = (h[:width - n + 1] + letters[n - 1:] + np.uint64(1)) * _BASE
        out[:width - n + 1, n - 1] = pieces.find(h)
    return out


def _walk(ids: np.ndarray, known: np.ndarray, unseen: np.ndarray, none: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward (or backward) values of one word and the logarithms that they
    are scaled by: the true value at j is ``value[j] * exp(scale[j])``.
    ``known`` is (pieces + 1, languages) with a last row of 0, ``unseen`` the
    probability of a letter without a piece."""
    width, longest = ids.shape
    value = np.zeros((width + 1, known.shape[1]))
    scale = np.zeros((width + 1, known.shape[1]))
    value[width if backward else 0] = 1.0
    so_far = np.zeros(known.shape[1])
    for j in range(width, 0, -1) if backward else range(width):
        # what lies ahead was added up under the scale so far
        top = np.where(value[j] > 0, value[j], 1.0)
        so_far = so_far + np.log(top)
        m = min(longest, j if backward else width - j)
        ahead = value[j - m:j + 1] if backward else value[j:j + m + 1]
        ahead /= top
        scale[j] = so_far
        lengths = np.arange(1, m + 1)
        at = ids[j - lengths, lengths - 1] if backward else ids[j, :m]
        step = known[at]
        if at[0] == none:
            step[0] = unseen
        if backward:
            value[j - m:j] += (value[j] * step)[::-1]
        else:
            value[j + 1:j + m + 1] += value[j] * step
    scale[0 if backward else width] = so_far
    return value, scale


def _matrices(parts: list[str], cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, letter matrix) of words of equal length up to TOGETHER, in
    blocks."""
    lengths = np.array([len(p) for p in parts])
    for n in np.unique(lengths[lengths <= TOGETHER]):
        where = np.flatnonzero(lengths == n)
        step = max(1, cells // int(n))
        for at in range(0, len(where), step):
            pick = where[at:at + step]
            text = "".join([parts[i] for i in pick]).encode("utf-32-le", "surrogatepass")
            yield pick, np.frombuffer(text, dtype=np.uint32).reshape(len(pick), n).astype(np.uint64)


def forward(pieces: Pieces, parts: list[str], table: np.ndarray) -> np.ndarray:
    """log P(part | language) for each part; ``table`` is (pieces + 1,
    languages), its last row for letters without a piece."""
    out = np.empty((len(parts), table.shape[1]))
    absent = np.zeros_like(table[:1])
    known = np.concatenate([table[:-1], absent])
    for pick, letters in _matrices(parts):
        alpha = np.zeros((letters.shape[1] + 1, len(letters), table.shape[1]))
        alpha[0] = 1.0
        for j, n, rows, ids in pieces.lattice(letters):
            step = known[ids]
            if n == 1:
                step = np.where((ids == pieces.none)[:, None], table[-1], step)
            alpha[j + n, rows] += alpha[j, rows] * step
        out[pick] = np.log(alpha[-1])
    for i, part in enumerate(parts):
        if len(part) > TOGETHER:
            value, scale = _walk(_ids(pieces, part), known, table[-1], pieces.none)
            out[i] = np.log(value[-1]) + scale[-1]
    return out


def expected(pieces: Pieces, parts: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted parts under probabilities ``p``
    (one language): forward-backward over all segmentations."""
    total = np.zeros(len(p))
    known = np.append(p[:-1], 0.0)
    for pick, letters in _matrices(parts, 200_000):
        many, width = letters.shape
        alpha = np.zeros((width + 1, many))
        beta = np.zeros((width + 1, many))
        alpha[0] = beta[width] = 1.0
        steps = []
        for j, n, rows, ids in pieces.lattice(letters):
            step = known[ids]
            if n == 1:
                step = np.where(ids == pieces.none, p[-1], step)
            alpha[j + n, rows] += alpha[j, rows] * step
            steps.append((j, n, rows, ids, step))
        weight = counts[pick] / alpha[width]
        for j, n, rows, ids, step in reversed(steps):
            beta[j, rows] += step * beta[j + n, rows]
        for j, n, rows, ids, step in steps:
            total += np.bincount(ids, weights=alpha[j, rows] * step * beta[j + n, rows] * weight[rows], minlength=len(total))
    for part, count in zip(parts, counts):
        if len(part) > TOGETHER:
            ids = _ids(pieces, part)
            one = known[:, None], p[-1:], pieces.none
            (a, la), (b, lb) = (tuple(x[:, 0] for x in _walk(ids, *one, backward=back)) for back in (False, True))
            whole = np.log(a[-1]) + la[-1]
            for n in range(1, min(pieces.longest, len(part)) + 1):
                at = ids[:len(part) - n + 1, n - 1]
                step = np.where(at == pieces.none, p[-1] if n == 1 else 0.0, known[at])
                share = a[:len(part) - n + 1] * step * b[n:] * np.exp(np.minimum(la[:len(part) - n + 1] + lb[n:] - whole, 700))
                total += np.bincount(at, weights=share * count, minlength=len(total))
    return total


class Model:
    """Languages and their piece probabilities (pieces + 1 rows)."""

    def __init__(self, path: str, langs: list[str], table: np.ndarray):
        self.path, self.langs, self.table = path, langs, table


def _start(pieces: Pieces) -> np.ndarray:
    return np.append(pieces.prior, UNSEEN)


def _learn(rows: DataFrame, path: str, langs: list[str], probs: np.ndarray | None) -> DataFrame:
    """(lang, piece, n): expected counts over (text, lang index) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        total = np.zeros((len(langs), pieces.none + 1))
        gathered: dict[int, Counter] = {}

        def flush() -> None:
            for k, chunks in gathered.items():
                parts: Counter = Counter()
                for chunk, n in chunks.items():
                    for w in words_of(chunk):
                        parts[marked(w)] += n
                if parts:
                    p = _start(pieces) if probs is None else probs[k]
                    total[k] += expected(pieces, list(parts), np.array(list(parts.values()), dtype=float), p)
            gathered.clear()

        for batch in batches:
            for x, k in zip(batch.column(0), batch.column(1)):
                gathered.setdefault(k.as_py(), Counter()).update(x.as_py().lower().split())
                if sum(map(len, gathered.values())) > CACHE:
                    flush()
        flush()
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[k, i])], ["lang", "piece", "n"])

    return rows.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str, folds: int = 3, held_out: int = 1, rounds: int = 1) -> Model:
    """Piece probabilities from all rows with a language and a text whose
    crc32(doc_id) mod ``folds`` is not ``held_out``.  The driver gets one
    number per language and piece."""
    train = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", folds) != held_out))
    langs = sorted(r["lang"] for r in train.select("lang").distinct().collect())
    pieces = Pieces(path)
    if not langs:
        return Model(path, [], np.zeros((pieces.none + 1, 0)))
    index = F.element_at(F.create_map(*[x for k, v in enumerate(langs) for x in (F.lit(v), F.lit(k))]), F.col("lang"))
    rows = train.select("text", index.alias("k"))
    probs = None
    for _ in range(rounds):
        counts = np.zeros((len(langs), pieces.none + 1))
        found = _learn(rows, path, langs, probs).toArrow()
        counts[found["lang"].to_numpy(), found["piece"].to_numpy()] = found["n"].to_numpy()
        counts = counts[:, :-1]
        pooled = counts.sum(0) + pieces.prior
        pooled /= pooled.sum()
        smooth = counts + 100 * pooled + 0.01
        smooth /= smooth.sum(1, keepdims=True)
        probs = np.concatenate([smooth, np.full((len(langs), 1), UNSEEN)], axis=1)
    return Model(path, langs, np.ascontiguousarray(probs.T))


class _Scorer:
    """Log probabilities of white-space pieces of text, kept per worker."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.path)
        self.rows: dict[str, int] = {}
        k = len(model.langs)
        self.logs = np.zeros((0, k + 1))  # last column: number of words

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks - self.rows.keys())
        if not new:
            return
        if len(self.rows) + len(new) > CACHE:
            self.rows.clear()
            self.logs = self.logs[:0]
            new = list(chunks)
        owner, parts = [], []
        words = np.zeros(len(new))
        for i, c in enumerate(new):
            for w in words_of(c):
                words[i] += 1
                owner.append(i)
                parts.append(marked(w))
        logs = np.zeros((len(new), self.logs.shape[1]))
        if parts and self.model.langs:
            distinct = list(dict.fromkeys(parts))
            at = {q: i for i, q in enumerate(distinct)}
            got = forward(self.pieces, distinct, self.model.table)[[at[q] for q in parts]]
            for k in range(got.shape[1]):
                logs[:, k] = np.bincount(owner, weights=got[:, k], minlength=len(new))
        logs[:, -1] = words
        self.rows.update(zip(new, range(len(self.logs), len(self.logs) + len(new))))
        self.logs = np.concatenate([self.logs, logs])

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        self.learn(set().union(*texts))
        get = self.rows.__getitem__
        return np.array([self.logs[np.fromiter(map(get, t), dtype=np.int64, count=len(t))].sum(0) for t in texts])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language and its posterior share.

    A NULL text, one without a letter, or a model without languages gives
    ``und`` and score 0; repeated rows are scored each; other columns are not
    read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            langs, scores, group, size = [], [], [], 0

            def flush() -> None:
                for t in scorer.totals(group) if group else ():
                    if not t[-1] or not model.langs:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    e = np.exp(t[:-1] - t[:-1].max())
                    best = int(e.argmax())
                    langs.append(model.langs[best])
                    scores.append(float(e[best] / e.sum()))
                group.clear()

            for x in batch.column(1):
                text = (x.as_py() or "").lower()
                group.append(text.split())
                size += len(text)
                if size > BLOCK:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {id_type(docs, id_col)}, lang_pred string, score double")
