"""Filter interaction audit over text filters, duplicates by radix tries.

``flags`` gives every row the mask of the filters it fails.  Filters A to D
look at one text; E (a smaller id has the same text) needs the whole table:

1. Rows of an Arrow batch with one text are one *bundle*, so a text that a
   third of all rows share travels once per batch, not once per row.
2. Texts are range-partitioned by adaptive prefixes: 16 bytes, and four times
   as many again and again where a prefix holds more than a partition's share.
3. Each partition inserts its whole texts into a compressed (radix) trie whose
   terminals hold the smallest id, then visits the terminals: bundles with a
   larger id than that get it back, and rows compare their own id with it.

``audit`` reduces masks to counts per (part, mask, labels) before anything is
joined with the filter orders, so the orders cost the same at every size.
"""

from __future__ import annotations

import itertools
import math
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitext.llm.util import id_type, saved

FILTERS = "ABCDE"
#: text bytes that one partition should hold; a prefix with more is extended
PART_BYTES = 48 << 20
FIRST_PREFIX = 16
#: a prefix with less is never extended; bound of the heavy prefixes that are
#: broadcast (8 bytes each)
LEAST_SHARE = 64 << 10
MOST_HEAVY = 1 << 17

_UPPER = string.ascii_uppercase.encode()
_SIGNS = b"#$%&*|"


def text_mask(data: bytes, chars: int) -> int:
    """Bits of the filters A (under 100 words), B (under 0.8 of the words
    distinct), C (over a tenth of the characters A-Z) and D (a sign)."""
    words = data.split()  # bytes are split at 0x20 and 0x09-0x0D only
    n = len(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    return ((n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * upper > 10 * chars) << 2
            | (len(data.translate(None, _SIGNS)) < len(data)) << 3)


class RadixTrie:
    """Compressed trie over byte strings; a terminal holds the smallest id of
    its text.  A node is [label, children by first byte, smallest id or None,
    whether a text ends here]."""

    def __init__(self):
        self.root = [b"", {}, None, False]

    def insert(self, text: bytes, id_) -> list:
        """Adds ``text`` and returns its terminal node, which later inserts
        keep up to date.  A None id ends a text but is smaller than none."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None, False]
                node[1][text[at]] = child
                node = child
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            common = _common(label, text, at)
            upper = [label[:common], {label[common]: child}, None, False]
            child[0] = label[common:]
            node[1][text[at]] = upper
            node, at = upper, at + common
        node[3] = True
        if id_ is not None and (node[2] is None or id_ < node[2]):
            node[2] = id_
        return node

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """(text, smallest id) of every text, in byte order."""
        todo = [(b"", self.root)]
        while todo:
            head, node = todo.pop()
            text = head + node[0]
            if node[3]:
                yield text, node[2]
            todo.extend((text, node[1][b]) for b in sorted(node[1], reverse=True))


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``text[at:]``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, text) to (task, bundle, id, part, mask, text, low, high): the
    text and the smallest and largest id of a bundle go with its first row."""
    task = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        kind, ids, texts = batch.schema.field(0).type, batch.column(0).to_pylist(), batch.column(2)
        chars = pc.utf8_length(texts.cast(pa.large_string())).to_pylist()
        first: dict[bytes, int] = {}
        bundle, mask, low, high = [], [], list(ids), list(ids)
        for i, cell in enumerate(texts):
            data = cell.as_py()
            k = first.setdefault(data, i)
            bundle.append(k)
            mask.append(mask[k] if k < i else text_mask(data, chars[i]))
            if k < i and ids[i] is not None:
                low[k] = ids[i] if low[k] is None else min(low[k], ids[i])
                high[k] = ids[i] if high[k] is None else max(high[k], ids[i])
        leads = [k == i for i, k in enumerate(bundle)]

        def of_lead(values, leads=leads):
            return [v if lead else None for v, lead in zip(values, leads)]

        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * len(ids), pa.int32()), pa.array([(number << 32) + k for k in bundle], pa.int64()),
             batch.column(0), batch.column(1), pa.array(mask, pa.int32()),
             pc.if_else(pa.array(leads, pa.bool_()), texts, pa.scalar(None, texts.type)),
             pa.array(of_lead(low), kind), pa.array(of_lead(high), kind)],
            ["task", "bundle", "id", "part", "mask", "text", "low", "high"])


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, bundle, text, low, high) of one partition to (of_task, of_bundle,
    smallest) for the bundles that hold a larger id than their text's smallest."""
    trie, ends, kind = RadixTrie(), [], None
    for batch in batches:
        kind = batch.schema.field(3).type
        task, bundle, _, low, high = (batch.column(k).to_pylist() if k != 2 else None for k in range(5))
        for i, cell in enumerate(batch.column(2)):
            ends.append((task[i], bundle[i], high[i], trie.insert(cell.as_py(), low[i])))
    hits = [(t, b, node[2]) for t, b, high, node in ends if high is not None and high > node[2]]
    if hits:
        task, bundle, low = zip(*hits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(task, pa.int32()), pa.array(bundle, pa.int64()), pa.array(low, kind)],
            ["of_task", "of_bundle", "smallest"])


def _keyed(texts: DataFrame, share: int) -> DataFrame:
    """``texts`` with (depth, key): the length and the hash of the adaptive
    prefix.  Rows of one prefix travel together, so a hash collision only puts
    two prefixes into one partition; the trie compares whole texts."""
    depth = FIRST_PREFIX
    prefix = lambda n: F.xxhash64(F.substring("text", 1, n))
    keyed = texts.withColumns({"depth": F.lit(depth), "key": prefix(depth)})
    while True:
        size = F.octet_length("text")
        # a prefix that is the whole of all its texts can't be extended
        heavy = saved(
            keyed.filter(F.col("depth") == depth).groupBy("key")
            .agg(F.sum(size).alias("size"), F.max(size).alias("longest"))
            .filter((F.col("size") > share) & (F.col("longest") > depth)).select(F.col("key").alias("long")),
            "trie-heavy")
        if heavy.limit(1).count() == 0:
            return keyed
        # fewer keys than (bytes of all texts) / share <= MOST_HEAVY
        found = keyed.join(F.broadcast(heavy), (F.col("key") == F.col("long")) & (F.col("depth") == depth), "left")
        depth *= 4
        longer = F.col("long").isNotNull()
        keyed = found.select(*texts.columns, F.when(longer, depth).otherwise(F.col("depth")).alias("depth"),
                             F.when(longer, prefix(depth)).otherwise(F.col("key")).alias("key"))


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, part, mask), one row per row of ``docs``; bit k of ``mask`` is set
    where the row fails filter ``FILTERS[k]``.

    A NULL text counts as empty (it fails A, and E if a smaller id's text is
    empty), a NULL part as the empty string.  A NULL id is smaller than none:
    its row fails no E and makes none fail.  Rows with one id and one text are
    no duplicates of each other.  Empty table: empty result.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    kind = id_type(docs, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        text.cast("binary").alias("text"))
    rows = saved(given.mapInArrow(
        _bundles, f"task int, bundle bigint, id {kind}, part string, mask int, text binary, low {kind}, high {kind}"),
        "trie-rows")
    # a row without an id takes part in no comparison
    texts = rows.filter("low IS NOT NULL").select("task", "bundle", "text", "low", "high")
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / part_bytes))
    keyed = _keyed(texts, max(min(part_bytes, total // parts), LEAST_SHARE, total // MOST_HEAVY))
    ranged = keyed.repartitionByRange(parts, F.substring("text", 1, FIRST_PREFIX), "key")
    hits = ranged.select(*texts.columns).mapInArrow(_smallest, f"of_task int, of_bundle bigint, smallest {kind}")
    hits = saved(hits, "trie-hits")
    same = (F.col("task") == F.col("of_task")) & (F.col("bundle") == F.col("of_bundle"))
    copy = F.coalesce(F.col("id") > F.col("smallest"), F.lit(False))
    return rows.select("task", "bundle", "id", "part", "mask").join(hits, same, "left").select(
        "id", "part", F.when(copy, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"))


def audit(flagged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) for every part, all 120 orders of the
    filters and each step, from the rows of ``flags``.

    ``labels`` has (id, quality, toxic); a row without a label is neither good
    nor toxic, and of several labels of one id any 1 counts.
    """
    lab = labels.groupBy(F.col(id_col).alias("of")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"))
    # at most 32 rows a part from here on
    counts = flagged.join(lab, F.col("id") == F.col("of"), "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    bit = lambda i: F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {i}, 1)) - 1)")
    steps = F.array(*[F.struct(F.lit(s).alias("step"), bit(s).alias("bit"), sum((bit(j) for j in range(1, s)), F.lit(0))
                               .alias("before")) for s in range(1, len(FILTERS) + 1)])
    laid = counts.withColumn("filter_order", F.explode(orders)).withColumn("s", F.explode(steps)).select(
        "*", "s.*").drop("s")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(when, value="n"):
        return F.sum(F.when(when, F.col(value)).otherwise(0))

    # of the orders, one in as many as the row has failures puts this one first
    share = F.when(fails, F.expr(f"n * ({math.factorial(len(FILTERS))} div bit_count(mask))")).otherwise(0)
    return laid.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(share).alias("shapley"))
