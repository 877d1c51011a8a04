"""Exact dedup by deterministic block naming, in DataFrame functions only.

A text is cut into fixed-size byte blocks.  All distinct blocks of the corpus
are sorted into integer names; then adjacent names are paired and the distinct
pairs are sorted into new names, level by level, until a document has one
name.  Equal texts get equal names because naming only depends on content, and
different texts never share one: a name stands for one block or one pair, and
an identity also holds the byte length (so also the number of levels).

Blocks are sorted by (64-bit hash, block): hashes only order and partition.
Blocks that share a hash are told apart by their bytes, so a hash collision
costs time, never correctness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitext.llm.util import ascii_lower, fresh, saved

BLOCK_BYTES = 4096


def _blocks(data: Column, size: int) -> Column:
    """Array of fixed-size blocks; an empty text has one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.substring(data, i * F.lit(size) + 1, F.lit(size)))


def _named(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``distinct`` rows sorted by ``keys`` within their hash partition and
    numbered: integer names, unique over the table, fixed once written."""
    return saved(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), name)


def _name_blocks(cut: DataFrame, hash_of) -> DataFrame:
    """(h, block, name): block is NULL where the hash holds one block only."""
    blocks = cut.select(F.explode("blocks").alias("block")).select(hash_of(F.col("block")).alias("h"), "block")
    # collect_set combines on the map side: a block that a third of all
    # documents share crosses the network once per task
    sets = blocks.groupBy("h").agg(F.array_sort(F.collect_set("block")).alias("same"))
    alone = F.size("same") == 1
    shown = F.when(alone, F.array(F.lit(None).cast("binary"))).otherwise(F.col("same"))
    return _named(sets.select("h", F.explode(shown).alias("block")), ["h", "block"], "block-names")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64) -> DataFrame:
    """(row, id, n_bytes, sha256, name) for each row; rows have equal
    (n_bytes, name) exactly when their normalised texts are equal."""
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    cut = docs.select(F.col(id_col).alias("id"), F.encode(norm, "UTF-8").alias("data")).select(
        "id", F.octet_length("data").alias("n_bytes"), F.sha2("data", 256).alias("sha256"),
        _blocks(F.col("data"), block_bytes).alias("blocks"))
    names = _name_blocks(cut, hash_of)
    # where several blocks share a hash, the rows' bytes travel along
    clash = names.filter("block IS NOT NULL").limit(1).count() > 0
    block = (lambda b: b) if clash else (lambda b: F.lit(None).cast("binary"))
    cells = cut.withColumn("cells", F.transform(
        "blocks", lambda b: F.struct(hash_of(b).alias("h"), block(b).alias("block"))))
    # row numbers are drawn once and written: every later step reads them
    rows = saved(cells.select(F.monotonically_increasing_id().alias("row"), "id", "n_bytes", "sha256", "cells"),
                 "block-rows")
    flat = rows.select("row", F.posexplode("cells").alias("i", "cell")).select(
        "row", "i", F.col("cell.h").alias("h"), F.col("cell.block").alias("block"))
    n = names.select(F.col("h").alias("nh"), F.col("block").alias("nb"), F.col("name"))
    on = F.col("h") == F.col("nh")
    if clash:
        on = on & (F.col("nb").isNull() | (F.col("nb") == F.col("block")))
    cur = flat.join(n, on).select("row", "i", "name")
    sizes = rows.select("row", F.size("cells").alias("cells"))
    cur = saved(cur.join(sizes, "row"), "block-level")
    done = [cur.filter("cells = 1").select("row", "name")]
    while True:
        open_ = cur.filter("cells > 1")
        if open_.limit(1).count() == 0:
            break
        pairs = saved(
            open_.groupBy("row", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                # an odd last name is paired with -1, which no name is
                F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1).cast("bigint")).alias("b"),
                F.max("cells").alias("cells")), "block-pairs")
        above = _named(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        cur = saved(pairs.join(above, ["a", "b"]).select(
            "row", "i", "name", F.ceil(F.col("cells") / 2).cast("int").alias("cells")), "block-level")
        done.append(cur.filter("cells = 1").select("row", "name"))
    ids = done[0]
    for d in done[1:]:
        ids = ids.union(d)
    return rows.select("row", "id", "n_bytes", "sha256").join(ids, "row")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64) -> DataFrame:
    """(id, keep_id, group_size, kept, sha256), one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; NULL counts
    as empty.  Of equal texts the row with the largest id stays (NULL ids are
    smallest); among rows that tie in id as well, one stays, the first in the
    written row order.  Empty table: empty result.  Other columns of ``docs``
    are not read.  ``hash_of`` orders blocks; tests pass one that collides.
    """
    ident = saved(identities(docs, id_col, text_col, block_bytes, hash_of), "block-identities")
    # of the largest id, the smallest row number (negated, so one max does it)
    best = F.max(F.struct(F.col("id"), (-F.col("row")).alias("r")))
    groups = saved(ident.groupBy("n_bytes", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")),
                   "block-groups")
    return ident.join(groups, ["n_bytes", "name"]).select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.r") == -F.col("row")).alias("kept"),
        "sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops.

    Kept rows are found again by (id, SHA-256 of the normalised text); of
    several identical rows with one id, one stays.
    """
    sha, kept_id, kept_sha = (fresh(docs, n) for n in ("sha", "kept_id", "kept_sha"))
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(
        F.col("id").alias(kept_id), F.col("sha256").alias(kept_sha))
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.withColumn(sha, F.sha2(F.encode(norm, "UTF-8"), 256))
    same = (F.col(id_col).eqNullSafe(F.col(kept_id))) & (F.col(sha) == F.col(kept_sha))
    found = keyed.join(kept, same, "left_semi")
    return found.dropDuplicates([id_col, sha]).drop(sha)
