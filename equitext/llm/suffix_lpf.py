"""Suffix-array dedup of bytes by longest-previous-factor arrays.

``repeats`` brings stretches that may share a window to one task.  There the
suffixes at all window starts are sorted by their first ``min_bytes`` bytes and
neighbours' common prefixes are computed.  In suffix order the previous and the
next smaller position of an entry are the earlier starts that share most with
it: the longest previous factor is the longer of the two common prefixes.  A
start whose factor reaches ``min_bytes`` is a later copy; the smaller position
that it was found at is the copy's source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from equitext.llm import repeats

MIN_BYTES = 400
GRAM = 64


def byte_symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)


def factors(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, source, other): of each entry in suffix order the longest
    previous factor, the entry it was found at (-1: none), and the other of the
    two smaller positions if it shares as much (else -1).

    ``place`` orders the starts; a factor is previous if its place is smaller.
    """
    before, up = repeats.previous_smaller(place, lcp)
    after, down = repeats.next_smaller(place, lcp)
    length = np.maximum(up, down)
    source = np.where(up >= down, before, after)
    return length, np.where(length > 0, source, -1), np.where((up == down) & (length > 0), after, -1)


def _solver(window: int, first: bool):
    def solve(data: list[np.ndarray], ids: list, starts: list[int]) -> list[np.ndarray]:
        s = repeats.suffixes(data, starts, window)
        covered = np.zeros(len(s.order), dtype=bool)
        if first:
            own, other = repeats.id_order(ids, starts)
            # starts of one id are no copies of each other: equal places
            length, _, _ = factors(other[s.order], s.lcp)
            covered[s.order] = (length >= window) & (own[s.order] >= 0)
        else:
            length, source, also = factors(s.order, s.lcp)
            copies = length >= window
            covered[s.order[copies]] = True
            for found in (source, also):
                covered[s.order[found[copies & (found >= 0)]]] = True
        return repeats.split(covered, starts)

    return solve


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = False, id_col: str = "doc_id",
                   text_col: str = "text", gram: int = GRAM, group: int = repeats.GROUP) -> DataFrame:
    """(id, n_bytes, spans, kept) per row: the maximal removed byte runs and
    the remaining bytes.

    A byte is removed if a ``min_bytes`` string that covers it also starts
    elsewhere, in any row or the same one; with ``keep_first`` only if it also
    starts in a row with a smaller id.  Matches never cross rows.  NULL counts
    as empty and loses nothing; repeated rows count as rows each; a NULL id
    is neither smaller nor larger than another; other columns are not read;
    an empty table gives an empty result.
    """
    spec = repeats.Windows(byte_symbols, min_bytes, min(gram, min_bytes), keep_first)
    scan, spans = repeats.spans(docs, spec, _solver(min_bytes, keep_first), "lpf", id_col, text_col, group)

    def stay(data: bytes, runs: list[tuple[int, int]]) -> bytes:
        edges = [0, *(x for r in runs for x in r), len(data)]
        return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])

    return repeats.kept_rows(scan, spans, "binary", stay).withColumnRenamed("n", "n_bytes")
