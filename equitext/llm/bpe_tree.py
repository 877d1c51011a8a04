"""BPE encoding and decoding with tree concatenation of long unsplit text.

Ordinary text falls apart into short pre-tokens that are encoded one by one.
A pre-token longer than LEAF letters (no white space, no change of letter
class) would be one long sequential job; it is halved down to leaves, which
Spark encodes in parallel rows, and the halves are concatenated up the tree.
At each join a window around the seam is encoded again and grown until its
outermost tokens equal those that both sides had: adjacent tokens that merge
back to themselves are then valid everywhere, and the result is exactly the
encoding of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitext.llm.bpe_words import WordCache, common, fragment_model, load
from equitext.llm.util import id_type, saved

#: letters in a leaf; pre-tokens up to this size are encoded whole
LEAF = 4096
#: characters of ordinary text encoded as one piece of a long document
PLAIN = 65_536
#: bytes of a worker's word cache
CACHE_BYTES = 48 << 20

#: fixed value: the tokenizer's pre-token pattern, white space dropped
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def token_table(tokenizer) -> np.ndarray:
    """Token of each id."""
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return np.array([tokenizer.id_to_token(i) or "" for i in range(size)], dtype=object)


def decode_ids(tokens: np.ndarray, ids: bytes) -> str:
    """As decode(ids, skip_special_tokens=False): the tokenizer has no
    decoder, so tokens are joined by single spaces."""
    return " ".join(tokens[np.frombuffer(ids, dtype="<u4")].tolist())


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Batches in small slices, so a worker holds the results of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Encoder:
    """One tokenizer in one Python worker."""

    _held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.cache = WordCache(self.model, _PATTERN, CACHE_BYTES)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._fragments = None
        self.tokens = token_table(self.tokenizer)

    def unsplit(self, text: str) -> bool:
        """Whether a run without white space exceeds a leaf."""
        return len(text) > LEAF and max(map(len, text.split()), default=0) > LEAF

    def encode(self, text: str) -> bytes:
        """ids of a text whose pre-tokens are short."""
        if not common(text) or any(a in text for a in self.added):
            # rare characters: the library's own normalizer and splitter
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        cache = self.cache
        return b"".join([cache[w] for w in text.lower().split()])

    # --- long unsplit pre-tokens, in byte-level letters ---------------------

    def tokenize(self, letters: str, ends: bool) -> list[int]:
        """ids of a run; ``ends``: it reaches the end of its word."""
        if ends:
            return [t.id for t in self.model.tokenize(letters)]
        if self._fragments is None:
            self._fragments = fragment_model(self.path)
        return [t.id for t in self._fragments.tokenize(letters)]

    def letters(self, ids: list[int]) -> str:
        return "".join(self.tokens[i].removesuffix("</w>") for i in ids)

    def join(self, left: list[int], right: list[int], ends: bool, window: int = 4) -> list[int]:
        """Encoding of the concatenation of two encoded runs."""
        if not left or not right:
            return left + right
        k = window
        while True:
            a, b = left[-k:], right[:k]
            whole_left, whole_right = k >= len(left), k >= len(right)
            mid = self.tokenize(self.letters(a + b), ends and whole_right)
            fits_left = whole_left or mid[0] == a[0]
            fits_right = whole_right or mid[-1] == b[-1]
            if fits_left and fits_right:
                return left[:-k] + mid + right[k:] if not whole_left else mid + right[k:]
            k *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Concatenates encoded leaves in pairs, level by level; the last
        part reaches the word's end."""
        while len(parts) > 1:
            up = [self.join(parts[i], parts[i + 1], i + 2 == len(parts)) if i + 1 < len(parts) else parts[i]
                  for i in range(0, len(parts), 2)]
            parts = up
        return parts[0] if parts else []

    def pieces(self, text: str) -> Iterator[tuple[int, bool, bool, str]]:
        """Pieces of a long text: (run, unsplit, ends, letters).  Pieces of
        one unsplit run share its number; other pieces are whole pre-tokens
        in byte-level letters, joined by spaces."""
        run, plain, size = 0, [], 0
        for part in re.split("(" + "|".join(map(re.escape, self.added)) + ")", text):
            if part in self.added:
                if plain:
                    yield run, False, True, " ".join(plain)
                    plain, size = [], 0
                yield run + 1, False, False, part
                run += 2
                continue
            norm = self.tokenizer.normalizer.normalize_str(part)
            for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm):
                if len(letters) <= LEAF:
                    plain.append(letters)
                    size += len(letters)
                    if size < PLAIN:
                        continue
                if plain:
                    yield run, False, True, " ".join(plain)
                    run, plain, size = run + 1, [], 0
                if len(letters) > LEAF:
                    leaves = halves(letters)
                    for i, leaf in enumerate(leaves):
                        yield run, True, i + 1 == len(leaves), leaf
                    run += 1
        if plain:
            yield run, False, True, " ".join(plain)

    def piece_ids(self, unsplit: bool, ends: bool, letters: str) -> list[int]:
        if unsplit:
            return self.tokenize(letters, ends)
        if not ends:
            return [self.tokenizer.token_to_id(letters)]
        return [t.id for p in letters.split(" ") for t in self.model.tokenize(p)]


def halves(letters: str, leaf: int = LEAF) -> list[str]:
    """Leaves of the binary tree over a run, in order."""
    if len(letters) <= leaf:
        return [letters]
    mid = len(letters) // 2
    return halves(letters[:mid], leaf) + halves(letters[mid:], leaf)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row; ids is binary, little-endian unsigned 32-bit.

    NULL and empty texts have no ids; repeated rows are encoded each; other
    columns are not read; an empty table gives an empty result.
    """
    return _encoded(docs, path, id_col, text_col, False)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): ``decode(encode(docs))`` in one worker per task, with
    one tokenizer and without sending the ids to Spark and back."""
    return _encoded(docs, path, id_col, text_col, True)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    kind = id_type(docs, id_col)
    schema = f"id {kind}, ids binary" + ", text string" * decoded
    names = ["id", "ids"] + ["text"] * decoded
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for batch in _parts(batches):
            ids, texts = [], []
            for i, x in enumerate(batch.column(1)):
                text = x.as_py() or ""
                if not enc.unsplit(text):
                    ids.append(i)
                    texts.append(enc.encode(text))
            out = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(texts, pa.binary())]
            if decoded:
                out.append(pa.array([decode_ids(enc.tokens, t) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cells = Encoder.of(path), ["row", "id", "piece", "run", "unsplit", "ends", "letters"]
        row = (TaskContext.get().partitionId() + 1) << 33
        for batch in batches:
            for i, x in enumerate(batch.column(1)):
                if enc.unsplit(x.as_py()):
                    row += 1
                    for n, (run, unsplit, ends, letters) in enumerate(enc.pieces(x.as_py())):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row]), batch.column(0).slice(i, 1), pa.array([n]), pa.array([run]),
                             pa.array([unsplit]), pa.array([ends]), pa.array([letters])], cells)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for batch in batches:
            rows = batch.select(["unsplit", "ends", "letters"]).to_pylist()
            ids = [np.array(enc.piece_ids(**r), dtype="<u4").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("row", "id", "piece", "run", "unsplit")] + [pa.array(ids, pa.binary())],
                ["row", "id", "piece", "run", "unsplit", "ids"])

    def concatenate(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = Encoder.of(path)
        out = []
        for _, g in pdf.sort_values("piece").groupby("run", sort=True):
            parts = [np.frombuffer(b, dtype="<u4") for b in g["ids"]]
            if g["unsplit"].iloc[0]:
                parts = [np.array(enc.tree([p.tolist() for p in parts]), dtype="<u4")]
            out += [p.tobytes() for p in parts]
        ids = b"".join(out)
        found = {"id": pdf["id"].iloc[:1], "ids": [ids]}
        return pd.DataFrame(found | {"text": [decode_ids(enc.tokens, ids)]} if decoded else found)

    # only texts longer than a leaf can hold an unsplit run that is
    long = rows.filter(F.char_length("text") > LEAF).mapInArrow(
        cut, f"row bigint, id {kind}, piece bigint, run bigint, unsplit boolean, ends boolean, letters string")
    pieces = saved(long, "bpe-pieces")
    encoded = pieces.repartition("row", "piece").mapInArrow(
        leaves, f"row bigint, id {kind}, piece bigint, run bigint, unsplit boolean, ids binary")
    joined = encoded.groupBy("row").applyInPandas(concatenate, schema)
    return rows.mapInArrow(short, schema).union(joined)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text): ``text`` is the library's decoding of ``ids``, special
    tokens kept; NULL ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_table(load(path))
        for batch in _parts(batches):
            texts = [decode_ids(tokens, x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             ["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {id_type(encoded, 'id')}, ids binary, text string")
