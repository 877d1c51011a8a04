"""Token ids as canonical length-limited Huffman files.

Global counts of the ids give code lengths of at most LIMIT bits (package
merge); canonical codes follow from the lengths alone, so a file set needs
only the lengths to be read.  A file holds the ids of consecutive documents,
in ascending document order, cut into blocks of BLOCK ids; the bit offset of
each block is a checkpoint, and blocks are decoded on their own by table
lookup, all blocks of a file at once.

File set: ``lengths`` (token, bits: the length of its code) and ``files``, a
Parquet table with one row per file: its number, its ids' number, the ids and
sizes of its documents, checkpoints and code bits.  Spark's committers write
it, so a lost executor leaves no half file.  ``encoded`` holds the ids between
counting and coding.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from equitext.llm.bpe_words import ENTRY_BYTES, byte_letters, load, spelled
from equitext.llm.util import id_type
from equitext.session import scratch_path

#: longest code in bits; ids in a block; ids in a file, about
LIMIT = 18
BLOCK = 1024
FILE_IDS = 1_000_000
#: bytes of the pre-tokens that a worker holds; pre-tokens encoded in a call;
#: bytes of texts encoded together; files whose offsets may be broadcast
CACHE_BYTES = 128 << 20
LEARN = 1000
SLICE_BYTES = 4 << 20
BROADCAST_FILES = 1_000_000
END = 2

#: fixed value: the tokenizer's pre-token pattern
_PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: what the pieces of a common text have not: characters from U+0250 on, those
#: that Python and the library treat differently, white space behind a space
_ODD = r"[\x1c-\x1f\x{130}\x{250}-\x{10ffff}]|^ [\t\n\x0b\x0c\r\x{85}\x{a0}]"


# --- code construction ----------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (0 for a
    count of 0), by package-merge over the sorted counts."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels: list[np.ndarray] = []  # per level: whether an item is a leaf
    items = leaves
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        items = merged[by]
    take = 2 * n - 2
    out = np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        out[:chosen] += 1
        take = 2 * (take - chosen)
    out[:take] += 1
    lengths[order] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes, as integers of ``length`` bits, in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code, before = 0, 0
    for size in np.unique(lengths[order]):
        same = order[lengths[order] == size]
        code <<= int(size) - before
        codes[same] = code + np.arange(len(same), dtype=np.uint64)
        code, before = code + len(same), int(size)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """(bits, checkpoints): codes one after another, first bit highest, and
    the bit offset of every block of ids."""
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 3, dtype=np.uint64)
    word, shift = starts >> 5, starts & 31
    # a code of up to 32 bits touches two words: its left-aligned 64-bit form
    high = codes[ids] << (64 - shift - size).astype(np.uint64)
    # codes that share a word touch disjoint bits, so their sum is their union
    first = np.concatenate([[True], word[1:] != word[:-1]]) if len(ids) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(first)
    if len(at):
        words[word[at]] += np.add.reduceat(high >> np.uint64(32), at)
        words[word[at] + 1] += np.add.reduceat(high & np.uint64(0xFFFFFFFF), at)
    return words.astype(">u4").tobytes(), starts[::block].astype(np.int64)


class Decoder:
    """Table of ``LIMIT`` bits: the id whose code a window begins with."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = max(1, int(lengths.max(initial=1)))
        codes = canonical(lengths)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((codes[used], lengths[used]))]
        # canonical codes, left aligned, ascend in this order and fill the table
        self.ids = np.repeat(order, 1 << (self.bits - lengths[order])).astype(np.int32)
        rest = (1 << self.bits) - len(self.ids)
        self.ids = np.concatenate([self.ids, np.zeros(rest, dtype=np.int32)])
        self.steps = np.maximum(lengths[self.ids], 1).astype(np.int64)

    def unpack(self, bits: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """All ids of a file; one step decodes the next id of every block."""
        if not n:
            return np.zeros(0, dtype=np.int32)
        words = np.frombuffer(bits, dtype=">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        lanes = len(checkpoints)
        last = n - (lanes - 1) * block  # ids in the last block
        out = np.zeros((block, lanes), dtype=np.int32)
        at = checkpoints.copy()
        mask, drop = np.uint64((1 << self.bits) - 1), 64 - self.bits
        for k in range(block if lanes > 1 else last):
            here = at if k < last else at[:-1]
            window = (pairs[here >> 5] >> (drop - (here & 31)).astype(np.uint64)) & mask
            out[k, :len(here)] = self.ids[window]
            here += self.steps[window]
        return out.T.ravel()[:n]


# --- encoding --------------------------------------------------------------

class Ids:
    """The byte-level tokenizer of one worker.  Texts are cut into pieces and
    each distinct piece of a slice is looked up once; the library's model
    encodes those that the worker does not hold, many in a call."""

    _held: dict[str, Ids] = {}

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str, size: int = CACHE_BYTES):
        self.tokenizer = load(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model for pre-tokens in byte-level letters, none of which is
        # white space: a line end parts pre-tokens, byte 11 stands for a line end
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], dtype="<u2")
        self.letters[[10, 11]] = 32, ord(letters[10])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.space, self.newline = np.zeros((2, 1 << 16), dtype=bool)
        self.space[[i for token, i in vocabulary.items() if token.startswith(letters[32])]] = True
        self.newline[vocabulary[letters[10]]] = True
        #: piece -> ids as little-endian unsigned 16-bit bytes
        self.known: dict[str, bytes] = {}
        self.size, self.held = size, 0

    def _together(self, words: list[str], lead: str, opens: np.ndarray, skip: int) -> None:
        """Encodes words, LEARN in a call; a token of ``opens`` tells where the
        ids of each begin, ``skip`` of them its lead's."""
        for at in range(0, len(words), LEARN):
            part = words[at:at + LEARN]
            text = np.frombuffer((lead + ("\n" + lead).join(part)).encode(), dtype=np.uint8)
            text = self.letters[text].tobytes().decode("utf-16-le")
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")
            flat, begin = ids.tobytes(), (2 * np.flatnonzero(opens[ids])).tolist()
            self.known.update(zip(
                part, [flat[a + 2 * skip:b] for a, b in zip(begin, [*begin[1:], len(flat)])], strict=True))

    def _learn(self, pieces: list[str]) -> None:
        spaced, bare = [], []
        for p in pieces:
            if p[0] == " " and p[1:].isalpha():  # of its tokens only the first begins with a space
                spaced.append(p)
            elif p.isalpha():
                bare.append(p)
            else:
                ids = [t.id for x in _PATTERN.findall(p) for t in self.tokenizer.model.tokenize(spelled(x))]
                self.known[p] = _binary(ids)
        self._together(spaced, "", self.space, 0)
        self._together(bare, "\x0b\n", self.newline, 1)
        self.held += sum([ENTRY_BYTES + len(p) * (1 if p.isascii() else 2) for p in pieces])

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """ids of pieces, each a whole number of pre-tokens."""
        if self.held >= self.size:
            self.known.clear()
            self.held = 0
        known = self.known
        self._learn([p for p in pieces if p not in known])
        return [known[p] for p in pieces]

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """ids of each text, ``end`` appended.  Where white space follows a
        space, and for rare characters and added tokens, the library splits
        the text."""
        texts = texts.fill_null("").cast(pa.large_string())
        pieces, edges = cut(texts)
        n_pieces = np.diff(edges)
        row = np.repeat(np.arange(len(texts)), n_pieces)
        coded = pieces.dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)[at]
        double = (words == " ")[at]
        double[(edges[1:] - 1)[n_pieces > 0]] = False
        aside = np.bincount(row[odd | double], minlength=len(texts)) > 0
        for a in self.added:
            aside |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)

        # values: distinct pieces, texts that the library splits, nothing, the end id
        kept = ~aside[row]
        used = np.flatnonzero(np.bincount(at[kept], minlength=len(words)))
        whole = np.flatnonzero(aside)
        values = self.pieces(words[used].tolist())
        values += [_binary(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids) for i in whole.tolist()]
        values += [b"", _binary([end])]
        value = np.zeros(len(words), dtype=np.int64)
        value[used] = np.arange(len(used))
        value = np.where(kept, value[at], len(values) - 2)
        value[edges[whole]] = len(used) + np.arange(len(whole))
        value = np.insert(value, edges[1:], len(values) - 1)

        size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 2
        flat, begin = np.frombuffer(b"".join(values), dtype="<u2"), np.cumsum(size) - size
        size, begin = size[value], begin[value]
        ends = np.cumsum(size)
        ids = np.repeat(begin - (ends - size), size)
        ids += np.arange(len(ids))
        ids = flat[ids]
        offsets = np.concatenate([[0], 2 * ends[edges[1:] + np.arange(len(texts))]])
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def _cut_table() -> np.ndarray:
    """Whether a pre-token begins between two bytes, where these alone tell
    it: before every space and between letters, digits, signs and white space.
    Left to the pattern: what follows a space (one pre-token with it) or an
    apostrophe (it may be a contraction), and the characters from U+0080 on
    that are no letters, with those that share their bytes."""
    kind = np.zeros(256, dtype=np.int64)  # 0: not told
    for b in range(128):
        c = chr(b)
        kind[b] = 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "\t\n\x0b\x0c\r " else 4
    before, behind = kind.copy(), kind.copy()
    before[0x80:0xC0] = 1  # a letter's last byte, unless 0xC2 is its first
    before[[0x97, 0xB7, ord(" "), ord("'")]] = 0
    behind[0xC4:0xCA] = 1
    table = (before[:, None] > 0) & (behind > 0) & (before[:, None] != behind)
    table[:, ord(" ")] = True
    table[9:14, 0xC3] = True  # no white space begins with it
    return table.ravel()


_CUTS = _cut_table()
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, 0x85, 0xA0])


def cut(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """(pieces, edges): the texts in pieces, each a whole number of pre-tokens,
    mostly one; text i has those from edges[i] up to edges[i + 1].  Holds for
    texts of common characters without white space behind a space."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[1:-1] = _CUTS[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    near = 1 + np.flatnonzero(data[:-1] == 0xC2)  # followers of 0xC2
    starts[near + 1] &= data[np.minimum(near + 1, len(data) - 1)] == 32
    # of a run of white space the last character is a pre-token of its own
    near = 2 + np.flatnonzero(_WHITE[data[:-2]] & _WHITE[data[1:-1]])
    starts[near] &= data[near] == 32
    starts[at] = True
    starts = np.flatnonzero(starts[:-1])
    edges = np.searchsorted(starts, at)
    offsets = pa.py_buffer(np.append(starts, len(data)))
    return pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(data)), edges


def _binary(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u2").tobytes()


def _slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts of about ``size`` bytes, a text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield begin, end
        begin = end


def encode(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row, in its order: the ids of each text as 16-bit
    little-endian binary (vocabularies up to 65,536), ``end`` appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Ids.of(path)
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), enc.encode(part.column(1), end).cast(pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type(docs, id_col)}, ids binary")


def id_counts(encoded: DataFrame, size: int = 1 << 16) -> np.ndarray:
    """Occurrences of every id: each task counts, one number per id and task
    is shuffled, one per id (at most 65,536) reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held = batch.column(0)
            for at in range(0, batch.num_rows, 500):
                flat = b"".join([x.as_py() for x in held.slice(at, 500)])
                total += np.bincount(np.frombuffer(flat, dtype="<u2"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    counts = encoded.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(size, dtype=np.int64)
    table = counts.toArrow()
    out[table["token"].to_numpy()] = table["n"].to_numpy()
    return out


def write_ids(docs: DataFrame, path: str, target: str, end: int = END, id_col: str = "doc_id",
              text_col: str = "text") -> None:
    """Writes the ids of ``docs`` as a file set below ``target``.

    Documents are in ascending id order (NULL ids first, rows of one id by
    a hash of their text).  NULL and empty texts have the end id alone;
    repeated rows are written each; other columns are not read; an empty table
    gives a file set without files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    encoded = encode(ordered, path, end).withColumn("ord", F.monotonically_increasing_id())
    encoded.write.option("compression", "zstd").parquet(f"{target}/encoded")
    encoded = spark.read.parquet(f"{target}/encoded")
    lengths = code_lengths(id_counts(encoded))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "token int, bits int").coalesce(1).write.parquet(
        f"{target}/lengths")
    kind = id_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        held: list[tuple[int, pa.Scalar, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            bits, checkpoints = pack(ids, lengths, codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0][0]]), pa.array([len(ids)]), pa.array([[h[1].as_py() for h in held]], pa.list_(held[0][1].type)),
                 pa.array([[len(h[2]) for h in held]], pa.list_(pa.int64())),
                 pa.array([checkpoints.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                ["file", "n", "docs", "sizes", "checkpoints", "bits"])

        for batch in batches:
            for o, doc, ids in zip(batch.column(0), batch.column(1), batch.column(2)):
                # a file holds consecutive documents of one range only
                if held and (n >= FILE_IDS or o.as_py() != held[-1][0] + 1):
                    yield flush()
                    held, n = [], 0
                held.append((o.as_py(), doc, np.frombuffer(ids.as_py(), dtype="<u2").astype(np.int64)))
                n += len(held[-1][2])
        if held:
            yield flush()

    encoded.select("ord", "id", "ids").mapInArrow(
        run, f"file bigint, n bigint, docs array<{kind}>, sizes array<bigint>, checkpoints array<bigint>, bits binary"
    ).write.parquet(f"{target}/files")


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """(id, start, ids) per document of a file set: the number of ids before
    it and its ids, binary little-endian unsigned 32-bit, decoded from the
    files."""
    table = spark.read.parquet(f"{target}/lengths").toArrow()  # at most 65,536 rows
    lengths = np.zeros(1 << 16, dtype=np.int64)
    lengths[table["token"].to_numpy()] = table["bits"].to_numpy()
    files = spark.read.parquet(f"{target}/files")
    kind = dict(files.dtypes)["docs"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                first, n, docs, sizes, checkpoints, bits = (batch.column(k)[i] for k in range(6))
                ids = decoder.unpack(bits.as_py(), checkpoints.values.to_numpy(), n.as_py()).astype("<u4").tobytes()
                ends = np.cumsum(sizes.values.to_numpy())
                starts = ends - sizes.values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(starts + first.as_py()),
                     pa.array([ids[4 * a:4 * b] for a, b in zip(starts, ends)], pa.binary())],
                    ["id", "start", "ids"])

    # ranges are few (one per partition of the writer); files are summed inside
    # their range, so no window holds all files
    heads = files.select("file", "n", F.shiftright("file", 33).alias("part"))
    parts = heads.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("base"))
    inside = heads.select("file", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    offsets = inside.join(parts, "part").select("file", (F.col("base") + F.col("off")).alias("first"))
    # 24 bytes a file: with up to BROADCAST_FILES of them the files stay where
    # they are; beyond, they are joined by shuffle, before they are decoded
    side = F.broadcast(offsets) if files.count() <= BROADCAST_FILES else offsets
    return files.join(side, "file").select("first", "n", "docs", "sizes", "checkpoints", "bits").mapInArrow(
        run, f"id {kind}, start bigint, ids binary")


def fresh_target(spark: SparkSession) -> str:
    """A new folder for a file set below the shared checkpoint folder."""
    return scratch_path(spark, f"llm-huffman-{uuid.uuid4().hex}")
