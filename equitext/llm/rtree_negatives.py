"""Hard-negative mining over an STR-packed R-tree.

Vectors are quantised to whole numbers and packed sort-tile-recursively: rows
are cut into slabs by the coordinate that varies most, the range partitioning
orders each slab by the next one (ties by further coordinates and the id, so
copies of one vector spread over as many partitions as they fill), and each
task packs its rows into leaves of ``LEAF`` rows by the coordinates after that.
A *tile* is one subtree: its leaves' rows, the leaves' minimum bounding boxes
and the boxes of the nodes above them.

For an anchor a and a box [lo, hi], coordinate i adds between a_i lo_i and
a_i hi_i to the inner product; the sums bound every score in the box.  A
best-first queue opens boxes by falling upper bound; the anchors of a block
share it, so a leaf's scores are one matrix product.  For an anchor a box is
skipped if it lies outside the score windows asked for, or if its upper bound
is strictly below the k-th score found so far (ties go on, since they are
broken by id).

Anchors come in blocks of about ``BLOCK``: a block is collected and sent to the
tasks that scan the tiles, and its results are written before the next block
is read.  The first of ``WAVES`` waves searches a part of the tiles; the
k-th scores found there are the floors of the rest, so few candidates travel.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equitext.llm.util import id_type, saved

TILE = 4096
LEAF = 64
FANOUT = 16
BLOCK = 4096
WAVES = 8
#: quantised components are stored as doubles, which hold them exactly
SCALE = 256

_TILE = ("tile bigint, n int, dim int, id array<bigint>, known array<boolean>, label array<bigint>, "
         "row array<bigint>, vec binary")


def _usable(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, vec) of the rows that take part."""
    rows = embeddings.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull()).filter(~bad).select(
        F.monotonically_increasing_id().alias("row"), "id", "label", "vec")


def _axes(rows: DataFrame) -> list[int]:
    """Coordinates by falling variance (as many numbers as dimensions)."""
    found = rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).collect()
    return [r["i"] for r in sorted(found, key=lambda r: (-r["v"], r["i"]))]


def _leaves(vec: np.ndarray, axes: list[int], leaf: int) -> np.ndarray:
    """Row order after sort-tile-recursive packing by ``axes``: slabs by the
    first axis, each slab packed by the rest."""

    def pack(rows: np.ndarray, left: list[int]) -> list[np.ndarray]:
        pages = math.ceil(len(rows) / leaf)
        if pages <= 1 or not left:
            return [rows]
        order = rows[np.argsort(vec[rows, left[0]], kind="stable")]
        if len(left) == 1:
            return [order]
        slabs = math.ceil(pages ** (1 / min(len(left), 3)))
        width = math.ceil(pages / slabs) * leaf
        return [p for i in range(0, len(order), width) for p in pack(order[i:i + width], left[1:])]

    return np.concatenate(pack(np.arange(len(vec)), axes[:3])) if len(vec) else np.arange(0)


def _pack(axes: list[int], tile: int, leaf: int):
    """Rows of a range partition, as they come sorted, to tiles."""

    def emit(number: int, dim: int, part: dict) -> pa.RecordBatch:
        vec = np.floor(np.asarray(part["vec"], dtype=np.float64).reshape(len(part["id"]), dim) * SCALE)
        order = _leaves(vec, [a for a in axes if a < dim], leaf)
        ids = [part["id"][i] for i in order]
        cells = [[number], [len(order)], [dim], [[0 if x is None else x for x in ids]], [[x is not None for x in ids]],
                 [[part["label"][i] for i in order]], [[part["row"][i] for i in order]], [vec[order].tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()),
                 pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cells, kinds)],
            ["tile", "n", "dim", "id", "known", "label", "row", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_: dict[int, dict] = {}  # by dimension
        for batch in batches:
            for row, id_, label, vec in zip(*(batch.column(k).to_pylist() for k in range(4))):
                part = open_.setdefault(len(vec), {"row": [], "id": [], "label": [], "vec": []})
                for name, value in (("row", row), ("id", id_), ("label", label), ("vec", vec)):
                    part[name].append(value)
                if len(part["id"]) == tile:
                    yield emit(number, len(vec), open_.pop(len(vec)))
                    number += 1
        for dim, part in open_.items():
            yield emit(number, dim, part)
            number += 1

    return run


def pack(rows: DataFrame, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """Tiles of (row, id, label, vec) rows, written once."""
    n = rows.count()
    axes = _axes(rows)
    parts = max(1, math.ceil(n / tile))
    if axes:
        slabs = math.ceil(math.sqrt(parts))
        first = F.get("vec", F.lit(axes[0]))
        at = [i / slabs for i in range(1, slabs)]
        cuts = rows.select(first.alias("x")).dropna().approxQuantile("x", at, 0.001) if at else []
        # at most sqrt(rows / TILE) cuts; equal cuts leave empty slabs
        slab = reduce(lambda s, c: s + (first > c).cast("int"), sorted(set(cuts)), F.lit(0))
        order = [F.size("vec"), F.coalesce(slab, F.lit(0)), *[F.get("vec", F.lit(a)) for a in axes[1:4]], F.col("id"),
                 F.col("row")]
    else:
        order = [F.col("id"), F.col("row")]
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return saved(laid.mapInArrow(_pack(axes, tile, leaf), _TILE), "rtree-tiles")


class Tree:
    """Subtree of one tile.  ``levels`` go from the leaves up; a level is
    (lo, hi, first, last): boxes, and the range of children of each node."""

    def __init__(self, cells: dict, leaf: int):
        self.n, dim = cells["n"], cells["dim"]
        self.vec = np.frombuffer(cells["vec"], dtype=np.float64).reshape(self.n, dim)
        self.id, self.known, self.label, self.row = (np.asarray(cells[k]) for k in ("id", "known", "label", "row"))
        first = np.arange(0, self.n, leaf)
        last = np.minimum(first + leaf, self.n)
        lo = np.minimum.reduceat(self.vec, first) if dim else np.zeros((len(first), 0))
        hi = np.maximum.reduceat(self.vec, first) if dim else np.zeros((len(first), 0))
        self.levels = [(lo, hi, first, last)]
        while len(lo) > 1:
            first = np.arange(0, len(lo), FANOUT)
            last = np.minimum(first + FANOUT, len(lo))
            lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
            self.levels.append((lo, hi, first, last))

    def bounds(self, anchors: np.ndarray, big: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level, the least and the largest score that each anchor (row)
        can have in each node (column)."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(dot(up, lo, big) + dot(down, hi, big), dot(up, hi, big) + dot(down, lo, big))
                for lo, hi, _, _ in self.levels]

    def big(self, anchors: np.ndarray) -> bool:
        """Whether scores may leave the whole numbers that a double holds."""
        return bool(anchors.size and self.vec.size
                    and np.abs(anchors).max() * np.abs(self.vec).max() * self.vec.shape[1] >= 2.0**51)


def dot(a: np.ndarray, b: np.ndarray, big: bool = False) -> np.ndarray:
    """Exact inner products of rows of whole numbers; ``big``: in integers of
    any size."""
    if big:
        a, b = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b))
    return a @ b.T


class Asks:
    """What is asked of a block of anchors: per ask an anchor, a score window
    (None: open) and the first ``k`` rows in it: larger scores first, ties by
    smaller id (an unknown id before all others), then by row.  ``kth`` is what
    a score must reach to matter: the floor, or the k-th score so far."""

    def __init__(self, asks: list[tuple], k: int):
        self.k, self.anchor = k, np.array([a for a, _, _, _ in asks], dtype=np.int64)
        bounds = [([x[i] for x in asks], default) for i, default in ((1, -math.inf), (2, math.inf), (3, -math.inf))]
        kind = object if any(v is not None and abs(v) >= 1 << 53 for values, _ in bounds for v in values) else np.float64
        self.low, self.high, self.kth = (
            np.array([default if v is None else v for v in values], dtype=kind) for values, default in bounds)
        self.cells: list[list[tuple]] = [[] for _ in asks]

    def offer(self, ask: int, scores, known, ids, rows) -> None:
        if len(scores) > self.k and scores.dtype != object:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = np.flatnonzero(scores >= cut)
            scores, known, ids, rows = scores[keep], known[keep], ids[keep], rows[keep]
        new = [(int(s), bool(n), int(i), int(r)) for s, n, i, r in zip(scores, known, ids, rows)]
        self.cells[ask] = sorted(self.cells[ask] + new, key=lambda c: (-c[0], c[1], c[2], c[3]))[:self.k]
        if len(self.cells[ask]) == self.k:
            least = self.cells[ask][-1][0]
            if self.kth.dtype != object and abs(least) >= 1 << 53:
                self.kth = self.kth.astype(object)
            self.kth[ask] = max(self.kth[ask], least)


def search(tree: Tree, anchors: np.ndarray, asks: Asks, wanted) -> int:
    """Best-first search of a tile for a block of anchors (rows): boxes are
    opened by their largest upper bound, each for the asks that it still
    matters to.  ``wanted(anchors, first, last)`` marks the rows of a leaf that
    may be offered to each anchor.  Returns the number of scores computed."""
    big = tree.big(anchors)
    bounds = [(low[asks.anchor], high[asks.anchor]) for low, high in tree.bounds(anchors, big)]  # by ask
    heads = [high.max(axis=0) for _, high in bounds]
    top, computed = len(tree.levels) - 1, 0
    queue = [(-heads[top][i], top, i) for i in range(len(heads[top]))]
    heapq.heapify(queue)
    while queue:
        _, level, i = heapq.heappop(queue)
        low, high = bounds[level][0][:, i], bounds[level][1][:, i]
        open_ = np.flatnonzero((high >= asks.kth) & (high >= asks.low) & (low <= asks.high))
        if not len(open_):
            continue
        first, last = tree.levels[level][2][i], tree.levels[level][3][i]
        if level:
            for child in range(first, last):
                heapq.heappush(queue, (-heads[level - 1][child], level - 1, child))
            continue
        who, at = np.unique(asks.anchor[open_], return_inverse=True)
        scores = dot(anchors[who], tree.vec[first:last], big)
        computed += scores.size
        least = np.maximum(asks.kth[open_], asks.low[open_])[:, None]
        of_ask = scores[at]
        hits = (of_ask >= least) & (of_ask <= asks.high[open_][:, None]) & wanted(who, first, last)[at]
        for k in np.flatnonzero(hits.any(axis=1)):
            rows = np.flatnonzero(hits[k])
            here = first + rows
            asks.offer(int(open_[k]), of_ask[k][rows], tree.known[here], tree.id[here], tree.row[here])
    return computed


_FOUND = "anchor bigint, ask int, score bigint, id bigint, row bigint"
_LONG = (-(1 << 63), (1 << 63) - 1)


def _searched(anchors: list[dict], same: bool, k: int, leaf: int):
    """Tiles to the best candidates of each ask of each anchor.  An anchor has
    row, label, vec (bytes) and asks (number, low, high, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple] = {}  # by dimension
        for dim in {len(a["vec"]) // 8 for a in anchors}:
            own = [a for a in anchors if len(a["vec"]) // 8 == dim]
            vecs = np.frombuffer(b"".join(a["vec"] for a in own), dtype=np.float64).reshape(len(own), dim)
            names = [(a["row"], ask[0]) for a in own for ask in a["asks"]]
            asks = Asks([(j, *ask[1:]) for j, a in enumerate(own) for ask in a["asks"]], k)
            blocks[dim] = (vecs, np.array([a["label"] for a in own]), np.array([a["row"] for a in own]), asks, names)
        for batch in batches:
            for number in range(batch.num_rows):
                cells = batch.slice(number, 1).to_pylist()[0]
                if cells["dim"] not in blocks:
                    continue
                vecs, labels, rows, asks, _ = blocks[cells["dim"]]
                tree = Tree(cells, leaf)

                def wanted(who, first, last, tree=tree, labels=labels, rows=rows):
                    alike = tree.label[None, first:last] == labels[who][:, None]
                    return alike & (tree.row[None, first:last] != rows[who][:, None]) if same else ~alike

                search(tree, vecs, asks, wanted)
        out = [(*name, min(max(s, _LONG[0]), _LONG[1]), i if known else None, r)
               for _, _, _, asks, names in blocks.values() for name, found in zip(names, asks.cells) for s, known, i, r in found]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["anchor", "ask", "score", "id", "row"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (anchor, ask); tasks have cut theirs already."""
    order = Window.partitionBy("anchor", "ask").orderBy(F.desc("score"), F.asc_nulls_first("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best(tiles: DataFrame, anchors: list[dict], same: bool, k: int, leaf: int, name: str) -> DataFrame:
    """(anchor, ask, score, id, row, rank) of one block of anchors, written."""
    lead = F.pmod(F.xxhash64("tile"), F.lit(WAVES)) == 0
    started = saved(_top(tiles.filter(lead).mapInArrow(_searched(anchors, same, k, leaf), _FOUND), k), f"{name}-wave")
    floors = {(r["anchor"], r["ask"]): r["score"] for r in started.filter(F.col("rank") == k).collect()}
    rest = [a | {"asks": [(n, low, high, floors.get((a["row"], n))) for n, low, high, _ in a["asks"]]} for a in anchors]
    found = tiles.filter(~lead).mapInArrow(_searched(rest, same, k, leaf), _FOUND)
    return saved(_top(started.drop("rank").union(found), k), name)


def mine(embeddings: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE,
         leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor and each of its first ``positives`` other
    rows of the same label, the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Scores are inner products of floor(256 x); larger first, ties by smaller
    id.  ``is_anchor`` is a condition on ``id``.  Rows with a NULL label, a NULL
    vector or a NULL or non-finite component take no part; vectors of different
    length never meet; empty vectors score 0.  A NULL id ties before all
    others.  Repeated rows are rows of their own: each is an anchor, and each
    can be the other's positive.  Scores beyond a long are compared exactly and
    shown as its limit.  No rows, or no anchors: an empty result.  Extra columns
    are not read.
    """
    spark = embeddings.sparkSession
    if id_type(embeddings, id_col) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number")
    rows = saved(_usable(embeddings, id_col, vector_col, label_col), "rtree-rows")
    tiles = pack(rows, tile, leaf)
    asked = rows.filter(is_anchor)
    blocks = max(1, math.ceil(asked.count() / block))
    asked = saved(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition(
        min(blocks, 512), "block").sortWithinPartitions("block"), "rtree-anchors")
    results = []
    for number in range(blocks):
        own = asked.filter(F.col("block") == number).collect()  # about ``block`` rows
        if not own:
            continue
        anchors = [{"row": r["row"], "id": r["id"], "label": r["label"], "asks": [(0, None, None, None)],
                    "vec": np.floor(np.array(r["vec"], dtype=np.float64) * SCALE).tobytes()} for r in own]
        good = _best(tiles, anchors, True, positives, leaf, "rtree-positives")
        windows: dict[int, list] = {}
        for r in good.collect():  # at most ``positives`` an anchor
            windows.setdefault(r["anchor"], []).append((r["rank"], -(-low * r["score"] // 100), high * r["score"] // 100, None))
        follow = [a | {"asks": [w for w in windows[a["row"]] if w[1] <= w[2]]} for a in anchors if a["row"] in windows]
        bad = _best(tiles, [a for a in follow if a["asks"]], False, negatives, leaf, "rtree-negatives")
        pos = good.select("anchor", F.col("rank").alias("ask"), F.col("id").alias("positive_id"),
                          F.col("score").alias("positive_score"))
        results.append(saved(
            bad.join(pos, ["anchor", "ask"]).select(
                "anchor", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score")), "rtree-mined"))
    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    kind = "anchor bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    mined = reduce(DataFrame.union, results) if results else spark.createDataFrame([], kind)
    return mined.join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
