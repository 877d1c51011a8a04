"""Queries: balanced split, sampling, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.operators import joins as J
from equitext.operators import split as X
from equitext.operators.metrics import nan_to_null
from equitext.operators.profile import any_group
from equitext.plans.oracle import prelude
from equitext.plans.q_profile import GCOLS, MEMBERSHIPS, _r, _with, labelled
from equitext.plans.registry import query
from equitext.session import derived_table
from equitext.sources import fixtures as fx

NOGROUP = f"NOT (coalesce(greatest({GCOLS}), 0) > 0.5)"

SPLIT_SQL = f"""gsplit AS (SELECT id, subgroup, toxic,
  CASE WHEN row_number() OVER w <= (count(*) OVER (PARTITION BY subgroup, toxic) * 3 + 9) // 10
  THEN 'test' ELSE 'train' END AS split
  FROM (SELECT id, subgroup, toxic, md5(CAST(id AS VARCHAR) || ':666:' || subgroup) AS h
        FROM memberships WHERE gscore > 0.5)
  WINDOW w AS (PARTITION BY subgroup, toxic ORDER BY h)),
residual AS (SELECT id, toxic FROM labelled WHERE {NOGROUP}),
kept AS (SELECT id, toxic FROM (SELECT id, toxic,
  row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':666:residual')) AS rk,
  count(*) OVER () AS n FROM residual WHERE NOT toxic) WHERE rk <= (n * 6) // 10),
rest AS (SELECT * FROM kept UNION ALL SELECT id, toxic FROM residual WHERE toxic),
rsplit AS (SELECT id, toxic,
  CASE WHEN row_number() OVER w <= (count(*) OVER (PARTITION BY toxic) * 3 + 9) // 10
  THEN 'test' ELSE 'train' END AS split
  FROM (SELECT id, toxic, md5(CAST(id AS VARCHAR) || ':666:rest') AS h FROM rest)
  WINDOW w AS (PARTITION BY toxic ORDER BY h)),
bsplit AS (SELECT DISTINCT id, split FROM (SELECT id, split FROM gsplit UNION ALL SELECT id, split FROM rsplit))"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Comments and their balanced split.  Like the original's split files,
    the split is built once (per application and input files), written
    below the checkpoint folder and read back by every later query."""
    df = labelled(spark, sf_dir)
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")]
    return df, derived_table(spark, "balanced-split", inputs, lambda: X.balanced_split(df))


@query("x01_group_split", _with(SPLIT_SQL, "labelled", memberships=True) + "SELECT * FROM gsplit")
def x01_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-group 70/30 split stratified on toxicity (all groups in one rank)."""
    return X.group_split(labelled(spark, sf_dir)).select("id", "subgroup", "toxic", "split")


@query("x02_residual_downsample", _with(SPLIT_SQL, "labelled", memberships=True) + "SELECT id FROM kept")
def x02_residual_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly floor(0.6 n) of the non-toxic rows in no group."""
    df = labelled(spark, sf_dir)
    residual = df.where(~any_group() & ~F.col("toxic"))
    return X.keep_first(residual, 0.6, "residual").select("id")


@query("x03_balanced_split", _with(SPLIT_SQL, "labelled", memberships=True) + "SELECT id, split FROM bsplit")
def x03_balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole balanced train/test construction: (id, split)."""
    return _split(spark, sf_dir)[1]


@query(
    "x03_disjoint_split",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + "SELECT id, CASE WHEN bool_or(split = 'test') THEN 'test' ELSE 'train' END AS split FROM bsplit GROUP BY id",
)
def x03_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced split without overlap: a row test for any group is test only."""
    return X.balanced_split(labelled(spark, sf_dir), allow_overlap=False)


_U = "CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':{seed}:'), 1, 8)) AS BIGINT) / 4294967296.0"


@query(
    "x04_downsample_nontoxic_train",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + f"""SELECT l.id, l.toxic FROM labelled l SEMI JOIN (SELECT id FROM bsplit WHERE split = 'train') t ON l.id = t.id
WHERE l.toxic OR {_U.format(seed=1).replace('id AS', 'l.id AS')} < 0.1""",
)
def x04_downsample_nontoxic_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep all toxic and 10 % of non-toxic training rows (hash draw, seed 1)."""
    df, split = _split(spark, sf_dir)
    train = X.split_rows(df, split, "train")
    return X.downsample(train, 0.1, 1, where=~F.col("toxic")).select("id", "toxic")


@query(
    "x05_sample_nongroup",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + f"SELECT id FROM labelled WHERE {NOGROUP} AND {_U.format(seed=7)} < 0.5",
)
def x05_sample_nongroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows in no group (hash draw, seed 7)."""
    df = labelled(spark, sf_dir).where(~any_group())
    return X.downsample(df, 0.5, 7).select("id")


@query(
    "j01_attach_predictions",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + f"""SELECT l.id, l.toxic, {_r('l.pred', 'pred')} FROM labelled l
JOIN (SELECT id FROM bsplit WHERE split = 'test') t ON l.id = t.id""",
)
def j01_attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows joined with their predictions by id."""
    df, split = _split(spark, sf_dir)
    test = X.split_rows(df.select("id", "toxic"), split, "test")
    preds = df.select("id", nan_to_null("pred").alias("pred"))
    return J.attach_predictions(test, preds)


@query(
    "j02_residual_rows",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + "SELECT id, toxic FROM labelled ANTI JOIN gsplit USING (id)",
)
def j02_residual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in neither the train nor the test part of any group split."""
    df = labelled(spark, sf_dir)
    taken = X.group_split(df).select("id")
    return J.residual_rows(df.select("id", "toxic"), taken)


@query(
    "j03_non_group_rows",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + "SELECT id FROM labelled ANTI JOIN (SELECT id FROM memberships WHERE gscore > 0.5) USING (id)",
)
def j03_non_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows not in the bag union of group rows (anti join)."""
    from equitext.operators.profile import bag_union

    df = labelled(spark, sf_dir)
    return J.residual_rows(df.select("id"), bag_union(df))


@query(
    "j04_lookup_rows",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + f"""SELECT id, {_r('target', 'target')}, CAST(length(comment_text) AS BIGINT) AS length
FROM labelled SEMI JOIN (SELECT id FROM bsplit WHERE split = 'test') USING (id)""",
)
def j04_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows looked up by the test id set (semi join)."""
    df, split = _split(spark, sf_dir)
    rows = J.lookup_rows(df, split.where(F.col("split") == "test"))
    return rows.select("id", "target", F.length("comment_text").cast("bigint").alias("length"))


EXTERNAL = (
    "external",
    """SELECT conv_id * 1000 + turn AS id, text AS comment,
  (conv_id * 31 + turn * 17) % 10 < 2 AS is_toxic FROM conversations""",
)


@query(
    "u04_augment_toxic",
    prelude("labelled", extra=[MEMBERSHIPS, EXTERNAL]).rstrip("\n")
    + ",\n" + SPLIT_SQL + "\n"
    + """SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic) AS n_toxic FROM (
  SELECT 'train' AS source, l.toxic FROM labelled l SEMI JOIN (SELECT id FROM bsplit WHERE split = 'train') t ON l.id = t.id
  UNION ALL SELECT 'external', is_toxic FROM external WHERE is_toxic) GROUP BY source""",
)
def u04_augment_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows augmented with the external set's toxic rows."""
    df, split = _split(spark, sf_dir)
    train = X.split_rows(df, split, "train")
    aug = X.augment_with_external(train, fx.external_set(spark, sf_dir))
    return aug.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("n_toxic"))


@query(
    "u05_group_vs_rest",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + f"""SELECT id, 1 AS group_label FROM memberships WHERE gscore > 0.5
UNION ALL SELECT id, 0 FROM labelled WHERE {NOGROUP}""",
)
def u05_group_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group rows labelled 1 (duplicates kept) and non-group rows labelled 0."""
    return X.group_vs_rest(labelled(spark, sf_dir))


@query(
    "s03_split_sink",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + f"""SELECT id, toxic, {_r('target', 'target')} FROM labelled
SEMI JOIN (SELECT id FROM bsplit WHERE split = 'test') USING (id)""",
)
def s03_split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the split rows partitioned by split to the shared checkpoint
    folder and read them back (partition pruning on ``split``)."""
    import uuid

    from equitext.session import scratch_path

    df, split = _split(spark, sf_dir)
    path = scratch_path(spark, f"split-{uuid.uuid4().hex}")
    X.write_split(df.select("id", "toxic", "target"), split, path)
    back = spark.read.parquet(path)
    return back.where(F.col("split") == "test").select("id", "toxic", "target")



@query("s04_reuse_or_build", _with(SPLIT_SQL, "labelled", memberships=True) + "SELECT id, split FROM bsplit")
def s04_reuse_or_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split table is built and written on first use, then read back
    (no rebuild) on the second."""
    import uuid

    from equitext.session import scratch_path

    path = scratch_path(spark, f"bsplit-{uuid.uuid4().hex}")
    built = []

    def build() -> DataFrame:
        built.append(1)
        return _split(spark, sf_dir)[1]

    X.reuse_or_build(spark, path, build)
    again = X.reuse_or_build(spark, path, build)
    assert len(built) == 1
    return again


def _fraction_sql(n: int, d: int) -> str:
    return SPLIT_SQL.replace("* 3 + 9) // 10", f"* {n} + {d - 1}) // {d}", 1)


@query(
    "x01_group_split_third",
    _with(_fraction_sql(333, 1000), "labelled", memberships=True) + "SELECT * FROM gsplit",
)
def x01_group_split_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-group split with a test share of exactly 0.333."""
    return X.group_split(labelled(spark, sf_dir), test_fraction=0.333).select("id", "subgroup", "toxic", "split")


@query(
    "x02_keep_quarter",
    _with(SPLIT_SQL.replace("(n * 6) // 10", "(n * 25) // 100"), "labelled", memberships=True) + "SELECT id FROM kept",
)
def x02_keep_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly floor(0.25 n) of the non-toxic rows in no group."""
    residual = labelled(spark, sf_dir).where(~any_group() & ~F.col("toxic"))
    return X.keep_first(residual, 0.25, "residual").select("id")


@query(
    "s02_split_scan",
    _with(SPLIT_SQL, "labelled", memberships=True)
    + "SELECT id, toxic FROM labelled SEMI JOIN (SELECT id FROM bsplit WHERE split = 'train') USING (id)",
)
def s02_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One side of a written split: partition and column pruning."""
    import uuid

    from equitext.session import scratch_path
    from equitext.sources import tables as T

    df, split = _split(spark, sf_dir)
    path = scratch_path(spark, f"split-{uuid.uuid4().hex}")
    X.write_split(df.select("id", "toxic", "target"), split, path)
    return T.read_split(spark, path, "train", ["id", "toxic"])


@query(
    "o03_seeded_shuffle",
    prelude("labelled")
    + """SELECT id, CAST(row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':17:shuffle')) AS BIGINT) AS place FROM labelled""",
)
def o03_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the seeded random order, with their place in it."""
    return X.seeded_shuffle(labelled(spark, sf_dir).select("id"), 17).select("id", "place")
