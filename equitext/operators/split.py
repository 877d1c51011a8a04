"""Balanced, reproducible train/test construction.

Random order is an md5 of ``id:seed:stratum``, so membership depends on
neither partitioning nor row order, and the same SQL reproduces it.

Exact cuts ("the first k rows of a stratum in hash order") need no rank of
all rows.  Rows are counted per (stratum, first 4 hex digits of the hash) --
65,536 buckets, uniform by construction; the small count table names the one
bucket in which the cut lies, and only its rows are ranked (``exact_cut``).
Every other row is decided by a comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equitext.constants import GROUPS, RESIDUAL_NONTOXIC_KEEP, SPLIT_SEED, TEST_FRACTION, THRESHOLD
from equitext.operators.metrics import group_memberships
from equitext.operators.profile import any_group
from equitext.session import read_if_exists

HASH_BUCKET_DIGITS = 4


def hash_order(id_col: str, seed: int, stratum: Column | str) -> Column:
    """md5 hex of ``id:seed:stratum`` -- the random order of a stratum."""
    s = F.lit(stratum) if isinstance(stratum, str) else stratum
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}:"), s))


def hash_uniform(id_col: str, seed: int, salt: str = "") -> Column:
    """A uniform draw in [0, 1) from the first 8 hex digits of an md5."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}:{salt}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def share(n: str, fraction: float, up: bool = False) -> Column:
    """floor (or ceil) of ``fraction`` times the integer column ``n``, in
    integer arithmetic on the decimal fraction as written (0.333 is
    333/1000)."""
    f = Fraction(str(fraction))
    extra = f.denominator - 1 if up else 0
    return F.expr(f"({n} * {f.numerator}L + {extra}L) div {f.denominator}L")


def exact_cut(df: DataFrame, strata: Sequence[str], order_col: str, take: Column) -> DataFrame:
    """(strata..., _cut): the hash of the last of the first ``take`` rows of
    each stratum in hash order (NULL where none is taken); ``take`` is an
    expression of the stratum size ``_n``.

    One narrow pass counts rows per (stratum, first hex digits).  The small
    count table names the bucket that holds the last row taken; only that
    bucket's rows, one in 65,536, are ranked.  All others are decided by
    comparing hashes.
    """
    strata = list(strata)
    b = df.select(*strata, F.col(order_col).alias("_h"), F.substring(order_col, 1, HASH_BUCKET_DIGITS).alias("_hb"))
    counts = b.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*strata).orderBy("_hb")
    running = counts.select(
        *strata, "_hb", "_c",
        F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_c").over(Window.partitionBy(*strata)).alias("_n"),
    ).withColumn("_take", take)
    # the bucket that holds the last row taken, and that row's place in it
    last = running.where((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_c") < F.col("_take"))).select(
        *strata, "_hb", (F.col("_take") - F.col("_upto") + F.col("_c")).alias("_place"))
    inside = b.join(F.broadcast(last), [*strata, "_hb"])  # one row per stratum
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_h"))
    return inside.withColumn("_rank", rank).where(F.col("_rank") == F.col("_place")).select(
        *strata, F.col("_h").alias("_cut"))


def _before_cut(df: DataFrame, strata: Sequence[str], order_col: str, take: Column) -> DataFrame:
    """``df`` with ``_in``: whether the row is among the first ``take`` of its
    stratum.  No shuffle of ``df``: one cut per stratum is joined."""
    # strata are groups x labels: tens of rows
    cuts = F.broadcast(exact_cut(df, strata, order_col, take))
    j = df.join(cuts, list(strata), "left")
    return j.withColumn("_in", F.coalesce(F.col(order_col) <= F.col("_cut"), F.lit(False))).drop("_cut")


def stratified_split(
    df: DataFrame,
    strata: Sequence[str],
    stratum_name: Column | str,
    id_col: str = "id",
    test_fraction: float = TEST_FRACTION,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Per stratum, the first ceil(fraction * n) rows in hash order are
    'test', the rest 'train'.  Adds ``split``."""
    h = df.withColumn("_h", hash_order(id_col, seed, stratum_name))
    r = _before_cut(h, strata, "_h", share("_n", test_fraction, up=True))
    return r.withColumn("split", F.when(F.col("_in"), F.lit("test")).otherwise(F.lit("train"))).drop("_h", "_in")


def group_split(
    df: DataFrame, groups: Sequence[str] = GROUPS, label: str = "toxic", id_col: str = "id",
    test_fraction: float = TEST_FRACTION,
) -> DataFrame:
    """X1 for every group at once: (id, subgroup, toxic, split) of group rows,
    stratified on (subgroup, toxic).  One long form for all groups."""
    long = (
        group_memberships(df, groups, keep=[id_col, label])
        .where(F.col("gscore") > THRESHOLD)
        .drop("gscore")
    )
    return stratified_split(long, ["subgroup", label], F.col("subgroup"), id_col, test_fraction)


def keep_first(
    df: DataFrame, fraction: float, stratum: str, id_col: str = "id", seed: int = SPLIT_SEED
) -> DataFrame:
    """Exactly floor(fraction * n) rows, the first in hash order."""
    h = df.withColumn("_h", hash_order(id_col, seed, stratum)).withColumn("_s", F.lit(stratum))
    r = _before_cut(h, ["_s"], "_h", share("_n", fraction))
    return r.where("_in").drop("_h", "_s", "_in")


def balanced_split(
    df: DataFrame,
    groups: Sequence[str] = GROUPS,
    label: str = "toxic",
    id_col: str = "id",
    allow_overlap: bool = True,
) -> DataFrame:
    """(id, split) of the balanced train/test construction.

    Group rows are split 70/30 per group stratified on toxicity; of the rows in
    no group, 60 % of the non-toxic ones (first in hash order) and all toxic
    ones are split 70/30 stratified again.  With ``allow_overlap`` a row of
    several groups may be in both sets (as in the original); otherwise a row
    that is test for any group is test only.
    """
    g = group_split(df, groups, label, id_col).select(id_col, "split")
    residual = df.where(~any_group(groups)).select(id_col, label)
    kept = keep_first(residual.where(~F.col(label)), RESIDUAL_NONTOXIC_KEEP, "residual", id_col)
    rest = kept.unionByName(residual.where(F.col(label)))
    r = stratified_split(rest, [label], "rest", id_col).select(id_col, "split")
    if allow_overlap:
        # only a row of several groups occurs twice: residual rows need no distinct
        return g.distinct().unionByName(r)
    disjoint = g.groupBy(id_col).agg(
        F.when(F.max(F.col("split") == "test"), F.lit("test")).otherwise(F.lit("train")).alias("split"))
    return disjoint.unionByName(r)


def seeded_shuffle(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """O3: ``df`` in a random order fixed by ``seed``, with each row's 1-based
    ``place``.  Rows are range-partitioned by hash; the place is the rank
    inside (first hash digits) plus the count of smaller ones."""
    h = df.withColumn("_h", hash_order(id_col, seed, "shuffle")).withColumn(
        "_hb", F.substring("_h", 1, HASH_BUCKET_DIGITS))
    counts = h.groupBy("_hb").agg(F.count(F.lit(1)).alias("_c"))
    # at most 65,536 buckets, whatever the input
    before = Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("_hb", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    rank = F.row_number().over(Window.partitionBy("_hb").orderBy("_h"))
    placed = h.withColumn("_r", rank).join(offsets, "_hb").withColumn("place", F.col("_off") + F.col("_r"))
    return placed.repartitionByRange("place").sortWithinPartitions("place").drop("_h", "_hb", "_off", "_r")


def split_rows(df: DataFrame, split: DataFrame, which: str, id_col: str = "id") -> DataFrame:
    """The rows of one side of a split (left semi join)."""
    return df.join(split.where(F.col("split") == which).select(id_col), id_col, "left_semi")


def downsample(df: DataFrame, fraction: float, seed: int, id_col: str = "id", where: Column | None = None) -> DataFrame:
    """Keep rows whose hash draw is below ``fraction``; rows not
    matching ``where`` are all kept.  Deterministic, partition-independent."""
    keep = hash_uniform(id_col, seed) < fraction
    if where is not None:
        keep = keep | ~where
    return df.where(keep)


def augment_with_external(train: DataFrame, external: DataFrame) -> DataFrame:
    """U4: training rows plus the toxic rows of an external labelled set
    (comment -> comment_text, is_toxic -> toxic)."""
    ext = (
        external.where(F.col("is_toxic"))
        .withColumnsRenamed({"comment": "comment_text", "is_toxic": "toxic"})
        .select("id", "comment_text", "toxic")
        .withColumn("source", F.lit("external"))
    )
    base = train.select("id", "comment_text", "toxic").withColumn("source", F.lit("train"))
    return base.unionByName(ext)


def group_vs_rest(df: DataFrame, groups: Sequence[str] = GROUPS, id_col: str = "id",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Group rows (label 1; a row in k groups appears k times) and rows in
    no group (label 0)."""
    cols = [id_col, *keep]
    members = (
        group_memberships(df, groups, keep=cols)
        .where(F.col("gscore") > THRESHOLD)
        .select(*cols, F.lit(1).alias("group_label"))
    )
    others = df.where(~any_group(groups)).select(*cols, F.lit(0).alias("group_label"))
    return members.unionByName(others)


def write_split(df: DataFrame, split: DataFrame, path: str, id_col: str = "id") -> None:
    """S3: write split rows as Parquet partitioned by ``split``."""
    (
        df.join(split, id_col, "inner")
        .write.mode("overwrite")
        .partitionBy("split")
        .parquet(path)
    )


def reuse_or_build(spark, path: str, build) -> DataFrame:
    """Read the table at ``path`` if it exists, else build, write, read.
    Only a path that is not there is built; any other failure to read it is
    raised, and nothing is ever overwritten."""
    found = read_if_exists(spark, path)
    if found is None:
        build().write.mode("errorifexists").parquet(path)
        found = spark.read.parquet(path)
    return found
