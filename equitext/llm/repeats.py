"""Candidate search for repeated windows of a sequence (bytes or words).

Two equal windows of W symbols hold the same anchor: the gram of K symbols
with the smallest hash in the window, the rightmost of equals.  Every window
start belongs to exactly one anchor, so a document falls into consecutive
*stretches* (one anchor, the starts it owns), and equal windows lie at the same
offset in stretches whose anchors are equal.  Windows without a partner are
never shipped:

1. stretches whose anchor occurs once are dropped (a combining aggregate);
2. stretches that are equal as a whole settle each other, whatever their
   number; one representative goes on;
3. groups of few different stretches go to tasks, which sort their suffixes
   and compute neighbours' common prefixes;
4. larger groups are cut: the offsets of the anchor in the window are halved,
   which lengthens the symbols that all windows of a group must share, and
   steps 2-4 repeat.  At one offset a group is one window, settled by step 2.

So no group beyond GROUP stretches reaches one task, however common a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitext.llm.util import id_type, saved

#: stretches of one group that are ordered in one task, at most
GROUP = 1000
#: symbols that a task orders at once, about
BATCH = 1_500_000
#: starts handled at once in a document (20 bits hold a position)
SEGMENT = 1 << 19

_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 20) - 1)


@dataclass(frozen=True)
class Windows:
    """What repeats are looked for.  ``symbols`` turns a text into uint64
    symbols.  ``first``: a repeat counts only against a smaller id (the
    smallest id keeps its window); else against any other place."""

    symbols: Callable[[str], np.ndarray]
    window: int
    gram: int
    first: bool

    @property
    def starts(self) -> int:
        return self.window - self.gram + 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2 ** 64."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 14)
        base = _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        held = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, dtype=np.uint64))])
                     for x in (base, inverse))
        _POWERS[which] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Prefix:
    """Hashes of any ranges of a sequence, from running sums."""

    def __init__(self, symbols: np.ndarray, which: int):
        up, self.down = _powers(len(symbols) + 1, which)
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum((symbols + np.uint64(1)) * up[:len(symbols)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    m = len(x) - w + 1
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1:w - 1 + m])


def stretches(s: np.ndarray, spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, whole hash, anchor position, first start, last start) of
    the stretches of a sequence."""
    w, out = spec.window, []
    for at in range(0, max(0, len(s) - w + 1), SEGMENT):
        part = s[at:at + SEGMENT + w - 1]
        one, two = Prefix(part, 0), Prefix(part, 1)
        g = one.grams(spec.gram)
        # the position in the low bits: unique keys, the rightmost of equals
        key = (g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64))
        low = window_min(key, spec.starts)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.append(first[1:], len(low)) - 1
        p = (_LOW - (low[first] & _LOW)).astype(np.int64)
        whole = one.ranges(first, last + w) ^ np.uint64(3) * two.ranges(first, last + w)
        whole = mix(whole + ((p - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64))
        out.append((g[p], whole, p + at, first + at, last + at))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _twins(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each stretch of a document the first one that is equal to it:
    where only ids decide, a periodic text sends each stretch on once."""
    both = mix(h ^ (whole * np.uint64(3)))
    _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
    return first[inverse]


def _scan(docs: DataFrame, spec: Windows, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, z, anchors...) per document: the compressed text and its
    stretches.  ``row`` is drawn here and fixed once the table is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        row = (TaskContext.get().partitionId() + 1) << 33
        for batch in batches:
            step = 500
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [x.as_py() or "" for x in part.column(1)]
                seqs = [spec.symbols(t) for t in texts]
                found = [stretches(s, spec) for s in seqs]
                rows = np.arange(row, row + len(texts))
                row += len(texts)
                twins = [_twins(f[0], f[1]) if spec.first else np.arange(len(f[0])) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column(0), pa.array([len(s) for s in seqs], pa.int64()),
                     pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary()),
                     _lists([_signed(f[0]) for f in found], pa.int64()), _lists([_signed(f[1]) for f in found], pa.int64()),
                     *(_lists([f[i] for f in found], pa.int32()) for i in (2, 3, 4)), _lists(twins, pa.int32())],
                    ["row", "id", "n", "z", "h", "whole", "p", "s0", "s1", "twin"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row bigint, id {id_type(docs, id_col)}, n bigint, z binary, h array<bigint>, "
                                "whole array<bigint>, p array<int>, s0 array<int>, s1 array<int>, twin array<int>")


def _order(spec: Windows):
    """What decides between occurrences: the id, or the place."""
    return F.col("id") if spec.first else F.xxhash64("row", "p")


def _settle(cand: DataFrame, spec: Windows, name: str) -> tuple[DataFrame, DataFrame]:
    """Steps 2 and 3 for stretches (core, whole, row, id, p, s0, s1, done...).

    Returns (spans that equal whole stretches cover, stretches that go on
    with ``others``, the number of different stretches of their group)."""
    keyed = cand.withColumn("o", _order(spec)).withColumn("u", F.xxhash64("row", "p"))
    classes = saved(keyed.groupBy("core", "whole").agg(
        F.min("o").alias("lo"), F.max("o").alias("hi"),
        F.min("u").alias("rep")), f"{name}-classes")
    groups = saved(classes.groupBy("core").agg(F.count(F.lit(1)).alias("others")).filter("others > 1"),
                   f"{name}-groups")
    both = saved(keyed.join(classes, ["core", "whole"]).withColumn(
        "hit", F.coalesce((F.col("lo") < F.col("o")) if spec.first else (F.col("lo") != F.col("hi")), F.lit(False))),
        f"{name}-settled")
    spans = both.filter("hit AND NOT done").select(
        "row", "p", F.col("s0").cast("bigint").alias("begin"), (F.col("s1") + spec.window).cast("bigint").alias("end"))
    # where ids decide, rows of the smallest id all go on: none covers another
    on = (F.col("o") == F.col("lo")) if spec.first else (F.col("rep") == F.col("u"))
    ahead = both.filter(on).withColumn("done", F.col("done") | F.col("hit")).drop(
        "o", "u", "lo", "hi", "rep", "hit").join(groups, "core")
    return spans, ahead


def _fetch(ahead: DataFrame, docs: DataFrame, spec: Windows) -> DataFrame:
    """``ahead`` with the symbols of each stretch as binary ``data``."""
    wanted = ahead.groupBy("row").agg(F.collect_list(F.struct("core", "p", "s0", "s1", "done", "others")).alias("parts"))
    rows = wanted.join(docs.select("row", "id", "z"), "row").select("row", "id", "z", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                text = unpack.decompress(batch.column(2)[i].as_py()).decode("utf-8", "surrogatepass")
                s = spec.symbols(text)
                parts = batch.column(3)[i].as_py()
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["core"] for x in parts], pa.int64()),
                     pa.array([batch.column(0)[i].as_py()] * n, pa.int64()),
                     batch.column(1).take(pa.array([i] * n)),
                     *(pa.array([x[c] for x in parts], pa.int32()) for c in ("p", "s0", "s1")),
                     pa.array([0] * n, pa.int32()), pa.array([spec.starts - 1] * n, pa.int32()),
                     pa.array([x["done"] for x in parts]), pa.array([x["others"] for x in parts], pa.int64()),
                     pa.array([narrow(s[x["s0"]:x["s1"] + spec.window]) for x in parts], pa.binary())],
                    ["core", "row", "id", "p", "s0", "s1", "a", "b", "done", "others", "data"])

    kind = id_type(docs, "id")
    return rows.mapInArrow(run, f"core bigint, row bigint, id {kind}, p int, s0 int, s1 int, a int, b int, "
                                "done boolean, others bigint, data binary")


def narrow(s: np.ndarray) -> bytes:
    """Symbols as bytes: one byte each if they fit, after a mark."""
    return b"\1" + s.astype(np.uint8).tobytes() if len(s) == 0 or s.max() < 256 else b"\10" + s.tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8 if data[0] == 1 else np.uint64, offset=1).astype(np.uint64)


def _cut(hot: DataFrame, spec: Windows, kind: str) -> DataFrame:
    """Each stretch of a large group as two: lower and upper half of the
    anchor offsets."""
    w = spec.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, r in enumerate(batch.select(["row", "p", "s0", "s1", "a", "b", "done", "data"]).to_pylist()):
                s, p = widen(r["data"]), r["p"]
                mid = (r["a"] + r["b"]) // 2
                one, two = Prefix(s, 0), Prefix(s, 1)
                for a, b in ((r["a"], mid), (mid + 1, r["b"])):
                    s0, s1 = max(r["s0"], p - b), min(r["s1"], p - a)
                    if a > b or s0 > s1:
                        continue
                    ends = np.array([[p - a, p - b + w], [s0, s1 + w]]) - r["s0"]
                    h = one.ranges(ends[:, 0], ends[:, 1]) ^ np.uint64(3) * two.ranges(ends[:, 0], ends[:, 1])
                    tag = np.array([(a << 16) + b, ((p - s0) << 16) + s1 - s0], dtype=np.uint64)
                    core, whole = _signed(mix(h + (tag << np.uint64(16)))).tolist()
                    out.append((i, core, whole, r["row"], p, s0, s1, a, b, r["done"],
                                narrow(s[s0 - r["s0"]:s1 + w - r["s0"]])))
            if out:
                i, core, whole, row, p, s0, s1, a, b, done, data = zip(*out)
                ints = [pa.array(x, pa.int32()) for x in (p, s0, s1, a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core, pa.int64()), pa.array(whole, pa.int64()), pa.array(row, pa.int64()),
                     batch.column("id").take(pa.array(i)), *ints, pa.array(done), pa.array(data, pa.binary())],
                    ["core", "whole", "row", "id", "p", "s0", "s1", "a", "b", "done", "data"])

    return hot.mapInArrow(run, f"core bigint, whole bigint, row bigint, id {kind}, p int, s0 int, s1 int, a int, "
                               "b int, done boolean, data binary")


def _ordered(small: DataFrame, solve) -> DataFrame:
    """Spans from tasks that order the suffixes of whole groups.

    ``solve(data, ids, starts)`` gets the symbols of many stretches, the id
    of each and its number of window starts; it returns one boolean array
    per stretch: which starts are covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def flush(rows: list[dict]) -> pa.RecordBatch | None:
            data = [widen(r["data"]) for r in rows]
            covered = solve(data, [r["id"] for r in rows], [r["s1"] - r["s0"] + 1 for r in rows])
            out = []
            for r, c in zip(rows, covered):
                if r["done"] or not c.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
                out += [(r["row"], r["p"], r["s0"] + int(a), r["s0"] + int(b)) for a, b in zip(edge[::2], edge[1::2])]
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["row", "p", "first", "stop"])

        for batch in batches:
            for r in batch.to_pylist():
                if size >= BATCH and held and r["core"] != held[-1]["core"]:
                    if (done := flush(held)) is not None:
                        yield done
                    held, size = [], 0
                held.append(r)
                size += len(r["data"]) // (1 if r["data"][0] == 1 else 8)
        if held and (done := flush(held)) is not None:
            yield done

    grouped = small.select("core", "row", "id", "p", "s0", "s1", "done", "data").repartition("core").sortWithinPartitions("core")
    return grouped.mapInArrow(run, "row bigint, p bigint, first bigint, stop bigint")


def spans(docs: DataFrame, spec: Windows, solve, name: str, id_col: str = "doc_id", text_col: str = "text",
          group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(scan, spans): the saved scan of ``docs`` (row, id, n, z = compressed
    text) and (row, spans array of begin, end): symbols covered by repeated
    windows, unmerged."""
    scan = saved(_scan(docs, spec, id_col, text_col), f"{name}-scan")
    kind = id_type(docs, id_col)
    flat = scan.select("row", "id", F.posexplode(F.arrays_zip("h", "whole", "p", "s0", "s1", "twin")).alias("i", "x")
                       ).filter("i = x.twin").select("row", "id", F.col("x.h").alias("core"), F.col("x.whole").alias("whole"), F.col("x.p").alias("p"),
        F.col("x.s0").alias("s0"), F.col("x.s1").alias("s1"))
    o = _order(spec)
    twice = saved(flat.groupBy("core").agg(F.min(o).alias("lo"), F.max(o).alias("hi")).filter("lo <> hi").select("core"),
                  f"{name}-anchors")
    cand = saved(flat.join(twice, "core").withColumn("done", F.lit(False)), f"{name}-candidates")
    found, ahead = _settle(cand, spec, name)
    found = [found]
    rows = saved(_fetch(ahead, scan, spec), f"{name}-stretches")
    while True:
        small = rows.filter(F.col("others") <= group)
        found.append(_ordered(small, solve).select(
            "row", "p", F.col("first").alias("begin"), (F.col("stop") - 1 + spec.window).alias("end")))
        hot = rows.filter(F.col("others") > group)
        if hot.limit(1).count() == 0:
            break
        more, ahead = _settle(saved(_cut(hot, spec, kind), f"{name}-cut"), spec, name)
        found.append(more)
        rows = saved(ahead.drop("whole"), f"{name}-stretches")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return scan, saved(every.groupBy("row").agg(F.collect_list(F.struct("p", "begin", "end")).alias("spans")), f"{name}-spans")


def merged(spans: list[dict] | None, p: list[int], twin: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of covered symbols; twins share the spans of the first."""
    if not spans:
        return []
    found = [(s["begin"], s["end"]) for s in spans]
    at: dict[int, list[tuple[int, int]]] = {}
    for s in spans:
        at.setdefault(s["p"], []).append((s["begin"], s["end"]))
    for i, t in enumerate(twin):
        if t != i:
            found += [(b + p[i] - p[t], e + p[i] - p[t]) for b, e in at.get(p[t], ())]
    out: list[list[int]] = []
    for b, e in sorted(found):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def kept_rows(scan: DataFrame, spans: DataFrame, fields: str, run) -> DataFrame:
    """(id, n, spans, kept): ``run(text bytes, runs)`` gives what stays."""
    kind = dict(scan.dtypes)["id"]
    value = pa.string() if fields == "string" else pa.binary()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found, kept = [], []
            for z, s, p, twin in zip(*(batch.column(i) for i in (2, 3, 4, 5))):
                runs = merged(s.as_py(), *(([], []) if not s.is_valid else (p.as_py(), twin.as_py())))
                found.append([{"begin": b, "end": e} for b, e in runs])
                kept.append(run(unpack.decompress(z.as_py()), runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, span),
                                              pa.array(kept, value)], ["id", "n", "spans", "kept"])

    rows = scan.join(spans, "row", "left").select("id", "n", "z", "spans", "p", "twin")
    return rows.mapInArrow(task, f"id {kind}, n bigint, spans array<struct<begin:bigint,end:bigint>>, kept {fields}")


@dataclass(frozen=True)
class Suffixes:
    """Window starts of many stretches in suffix order.  ``order``: the starts,
    sorted by their first ``window`` symbols, equal ones by start.  ``lcp[i]``:
    symbols that entry i shares with the one before it, at most ``window`` (0
    for the first); below it in whole ``unit`` symbols."""

    order: np.ndarray
    lcp: np.ndarray
    window: int
    unit: int


def suffixes(data: list[np.ndarray], starts: list[int], window: int) -> Suffixes:
    """Suffix order and neighbours' common prefixes by prefix doubling.

    Names of 1, 2, 4, ... symbols are paired, so that they sort like the symbols
    that they stand for.  The common prefix of two neighbours is found by
    comparing their names from the longest down."""
    flat = np.concatenate(data)
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])])[:-1]
    where = np.concatenate([a + np.arange(n) for a, n in zip(at, starts)])
    unit = m = 1
    if window >= 8 and flat.max() < 256:  # eight bytes are one first name
        padded = np.concatenate([flat, np.zeros(7, dtype=np.uint64)])
        flat = sum(padded[j:len(padded) - 7 + j] << np.uint64(56 - 8 * j) for j in range(8))
        unit = m = 8
    size = len(flat) + 1
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    levels = [(m, rank.astype(np.int32))]
    while m * 2 <= window:
        # positions whose pair would leave the array are never part of a window
        pair = rank[:-m] * size + rank[m:]
        rank = np.concatenate([np.unique(pair, return_inverse=True)[1], np.zeros(m, dtype=np.int64)])
        m *= 2
        levels.append((m, rank.astype(np.int32)))
    last = np.unique(rank[where] * size + rank[where + window - m], return_inverse=True)[1]
    order = np.argsort(last, kind="stable")
    lcp = np.zeros(len(order), dtype=np.int64)
    same = last[order[1:]] == last[order[:-1]]
    lcp[1:][same] = window
    apart = np.flatnonzero(~same) + 1
    one, two, found = where[order[apart - 1]], where[order[apart]], np.zeros(len(apart), dtype=np.int64)
    for m, rank in reversed(levels):
        fits = found + m <= window
        # a window reaches no further than the array
        equal = np.zeros(len(apart), dtype=bool)
        equal[fits] = rank[(one + found)[fits]] == rank[(two + found)[fits]]
        found[equal] += m
    lcp[apart] = np.minimum(found, window - 1)
    return Suffixes(order, lcp, window, unit)


def previous_smaller(value: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, least): for each entry the nearest one before it with a smaller
    value (-1: none), and the least of ``shared`` on the way, from behind that
    entry up to this one (0 where there is none).

    All entries step back at once: one whose candidate is not smaller takes
    over the candidate's own, whose way it has then also walked."""
    n = len(value)
    index = np.arange(-1, n - 1)
    least = np.zeros(n, dtype=np.int64) if shared is None else shared.astype(np.int64)
    left = np.arange(n)
    while True:
        left = left[index[left] >= 0]
        left = left[value[index[left]] >= value[left]]
        if not len(left):
            break
        back = index[left]
        # both sides are read before either is written
        index[left], least[left] = index[back], np.minimum(least[left], least[back])
    least[index < 0] = 0
    return index, least


def next_smaller(value: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same behind each entry; ``shared[i]`` lies between i - 1 and i."""
    n = len(value)
    turned = None if shared is None else np.append(shared[1:], 0)[::-1]
    index, least = previous_smaller(value[::-1], turned)
    return np.where(index < 0, -1, n - 1 - index)[::-1], least[::-1]


def id_order(ids: list, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(own, other) per window start: the order of its stretch's id, as the
    one that looks for a smaller id and as the one that is looked at.  A NULL
    id neither finds a smaller one nor is one."""
    known = {v: i for i, v in enumerate(sorted({v for v in ids if v is not None}))}
    own = np.array([known.get(v, -1) for v in ids])
    other = np.where(own < 0, len(known), own)
    return np.repeat(own, starts), np.repeat(other, starts)


def split(flags: np.ndarray, starts: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(starts)[:-1])
