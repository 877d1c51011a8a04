"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is 64 bits wide.  Its *tile* is the vector of population counts
of four 16-bit segments.  Two fingerprints within a Hamming radius r differ by
at most r in the sum of the absolute differences of these counts, so a pair
of tiles further apart is skipped whole and no link is lost.  Tiles are cut
into chunks of bounded size; each remaining chunk pair is compared in full
with numpy exclusive-or and bit counts.  A task sends back a spanning forest
of the links it found, never the links themselves, so a group of thousands of
near copies costs one edge per fingerprint and chunk pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitext.llm.components import connected
from equitext.llm.util import fresh, id_type, saved

SEGMENTS = 4
WIDTH = 64 // SEGMENTS
BASE = WIDTH + 1
#: fingerprints in a chunk, on average
CHUNK = 512

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def simhash(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of UTF-8 text: A-Z lower-cased, words between
    ASCII white space, ``shingle``-word shingles with repeats (fewer words:
    the whole sequence; none: 0)."""
    words = data.lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    join = b" ".join
    grams = zip(*(words[i:] for i in range(n)))
    raw = np.frombuffer(b"".join([digest(join(g), seed) for g in grams]), dtype=np.uint8)
    rows = raw.reshape(-1, 8)
    counts = np.bincount((rows + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = counts @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, fp signed 64-bit) per row; a NULL or blank text has fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(
                (simhash(x.as_py() or b"", shingle, seed) for x in batch.column(1)),
                dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {id_type(docs, id_col)}, fp bigint")


def _segment_counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("bigint")))
            for i in range(SEGMENTS)]


def _code(parts: list[Column]) -> Column:
    code = F.lit(0)
    for p in parts:
        code = code * BASE + p
    return code.cast("int")


def neighbour_steps(radius: int) -> list[tuple[int, ...]]:
    """Count vectors that a tile differs by from a tile within the radius, one
    of each pair of opposite vectors (the zero vector included)."""
    steps = itertools.product(range(-radius, radius + 1), repeat=SEGMENTS)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * SEGMENTS]


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two chunks as a spanning forest: (node, root), root the
    smallest fingerprint that the node reaches inside these two chunks."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if not near.any():
        return a[:0], a[:0]
    rows, cols = near.any(axis=1), near.any(axis=0)
    near, a, b = near[np.ix_(rows, cols)], a[rows], b[cols]
    top = np.uint64(2**64 - 1)
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
        if np.array_equal(na, la) and np.array_equal(nb, lb):
            break
        la, lb = na, nb
    node, root = np.concatenate([a, b]), np.concatenate([la, lb])
    keep = node != root
    return node[keep], root[keep]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, roots = [], []
            for x, y in zip(batch.column(0), batch.column(1)):
                a = x.values.to_numpy().view(np.uint64)
                b = y.values.to_numpy().view(np.uint64)
                n, r = forest(a, b, radius)
                nodes.append(n)
                roots.append(r)
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (nodes, roots)], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 2, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those
    of all links within ``radius``.  ``fps`` holds distinct ``fp``."""
    tiled = fps.select("fp", _code(_segment_counts(F.col("fp"))).alias("tile"))
    # at most BASE ** SEGMENTS = 83,521 rows whatever the input: safe to broadcast
    sizes = saved(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "tiles")
    chunks = saved(
        tiled.join(F.broadcast(sizes), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"))
        .agg(F.collect_list("fp").alias("fps")), "tile-chunks")
    steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in neighbour_steps(radius)])
    at = [F.floor(F.col("tile") / BASE ** (SEGMENTS - 1 - i)).cast("int") % BASE for i in range(SEGMENTS)]
    moved = [F.col(f"c{i}") + F.col("step")[i] for i in range(SEGMENTS)]
    inside = moved[0].between(0, WIDTH)
    for m in moved[1:]:
        inside = inside & m.between(0, WIDTH)
    near = (
        sizes.select(F.col("tile").alias("ta"), F.col("chunks").alias("na"),
                     *[c.alias(f"c{i}") for i, c in enumerate(at)], F.explode(steps).alias("step"))
        .filter(inside).select("ta", "na", _code(moved).alias("tb"))
    )
    other = F.broadcast(sizes.select(F.col("tile").alias("tb"), F.col("chunks").alias("nb")))
    pairs = (
        near.join(other, "tb")
        .select("ta", "tb", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ca"))
        .select("ta", "ca", "tb", F.explode(F.sequence(
            F.when(F.col("ta") == F.col("tb"), F.col("ca")).otherwise(F.lit(0)), F.col("nb") - 1)).alias("cb"))
    )
    left = chunks.select(F.col("tile").alias("ta"), F.col("chunk").alias("ca"), F.col("fps").alias("fa"))
    right = chunks.select(F.col("tile").alias("tb"), F.col("chunk").alias("cb"), F.col("fps").alias("fb"))
    joined = pairs.join(left, ["ta", "ca"]).join(right, ["tb", "cb"]).select("fa", "fb")
    return joined.mapInArrow(_compare(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row of ``docs``.

    component_id is the smallest id reachable over links of ``radius`` or
    fewer differing bits, the row's own included.  NULL and blank texts have
    fingerprint 0 and link like any other; rows with a NULL id take part and
    get the smallest non-NULL id of their component (NULL if there is none);
    repeated rows are returned each; an empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    fps = saved(fingerprints(docs, shingle, seed, id_col, text_col), "simhash")
    reps = saved(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = connected(links(reps.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    grouped = saved(roots.join(reps, "fp"), "simhash-grouped")
    smallest = saved(grouped.groupBy("root").agg(F.min("first").alias("least")), "simhash-least")
    named = saved(
        reps.join(grouped.join(smallest, "root").select("fp", "least"), "fp", "left")
        .select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-components")
    return fps.join(named, "fp").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Rows with a NULL id cannot be told apart by it and stay.  Of repeated rows
    with that id one stays.
    """
    found = near_duplicates(docs, shingle, radius, seed, id_col, text_col)
    kept_id = fresh(docs, "kept_id")
    keep = saved(found.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias(kept_id)).distinct(),
                 "simhash-kept")
    named = docs.filter(F.col(id_col).isNotNull())
    kept = named.join(keep, F.col(id_col) == F.col(kept_id), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
