"""Substring dedup of words by prefix-partitioned suffix trees.

``repeats`` splits the suffixes that may share a window by symbols that all of
them have: a short gram at first, lengthened where a group would be too large
for a task.  Inside a task the group's suffixes are sorted by words; the common
prefixes of neighbours give the subtree's internal nodes, as intervals of
leaves with a depth.  The nodes of ``min_words`` depth or more are the repeats,
and a leaf below one is removed if the node has a leaf of a smaller id.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from equitext.llm import repeats

MIN_WORDS = 50
GRAM = 12


def word_symbols(text: str) -> np.ndarray:
    """64-bit names of the words between ASCII white space."""
    name = xxhash.xxh64_digest
    raw = b"".join([name(w) for w in text.encode("utf-8", "surrogatepass").split()])
    return np.frombuffer(raw, dtype=np.uint64)


def internal_nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, depth) of the internal nodes of the tree over leaves in
    suffix order: the leaves below a node and the words that they all share.

    A common prefix of neighbours is the depth of a node that reaches from the
    last smaller one before it to the next smaller one behind it; equal depths
    inside one such interval are one node.
    """
    before, _ = repeats.previous_smaller(lcp)
    after, _ = repeats.next_smaller(lcp)
    first, last = np.maximum(before, 0), np.where(after < 0, len(lcp), after) - 1
    node = np.flatnonzero(lcp > 0)
    _, one = np.unique(first[node] * (len(lcp) + 1) + last[node], return_index=True)
    node = node[one]
    return first[node], last[node], lcp[node]


def smallest_below(value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value of the leaves of each node (nodes in order of ``first``)."""
    bounds = np.stack([first, last + 1], axis=1).ravel()
    return np.minimum.reduceat(np.append(value, np.iinfo(value.dtype).max), bounds)[::2]


def _solver(window: int):
    def solve(data: list[np.ndarray], ids: list, starts: list[int]) -> list[np.ndarray]:
        s = repeats.suffixes(data, starts, window)
        own, other = repeats.id_order(ids, starts)
        first, last, depth = internal_nodes(s.lcp)
        deep = depth >= window
        first, last = first[deep], last[deep]
        covered = np.zeros(len(s.order), dtype=bool)
        if len(first):
            # windows end at ``window`` words, so deep nodes do not nest
            smallest = smallest_below(other[s.order], first, last)
            leaves = np.repeat(first - np.concatenate([[0], np.cumsum(last - first + 1)[:-1]]), last - first + 1) + np.arange(
                (last - first + 1).sum())
            covered[s.order[leaves]] = np.repeat(smallest, last - first + 1) < own[s.order[leaves]]
        return repeats.split(covered, starts)

    return solve


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                   gram: int = GRAM, group: int = repeats.GROUP) -> DataFrame:
    """(id, n_words, spans, kept) per row: the maximal removed word runs and
    the kept words joined by one space.

    A word is removed if a window of ``min_words`` words that covers it also
    starts in a row with a smaller id; a NULL id is neither smaller nor larger
    than another.  NULL and blank texts have no words; repeated rows with one
    id do not count against each other; other columns are not read; an empty
    table gives an empty result.
    """
    spec = repeats.Windows(word_symbols, min_words, min(gram, min_words), True)
    scan, spans = repeats.spans(docs, spec, _solver(min_words), "wordtree", id_col, text_col, group)

    def stay(data: bytes, runs: list[tuple[int, int]]) -> str:
        words = data.split()
        edges = [0, *(x for r in runs for x in r), len(words)]
        left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
        return b" ".join(left).decode("utf-8", "surrogatepass")

    return repeats.kept_rows(scan, spans, "string", stay).withColumnRenamed("n", "n_words")
