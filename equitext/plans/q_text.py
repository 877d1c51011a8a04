"""Queries: tokenisers, tweet normaliser, vocabulary, bag of words, TF-IDF."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.functions.text import bow_tokens, normalise_tweet, word_tokens
from equitext.operators import bow as B
from equitext.operators import split as X
from equitext.plans.oracle import prelude
from equitext.plans.q_profile import _r, _with, labelled
from equitext.plans.q_split import SPLIT_SQL
from equitext.plans.registry import query
from equitext.session import scratch_path
from equitext.sources import fixtures as fx

BOW_TOK = (
    "btok",
    r"""SELECT id, unnest(regexp_extract_all(lower(coalesce(comment_text, '')), '[\p{L}\p{N}_]{2,}')) AS token
FROM comments""",
)


@query(
    "f01_word_tokens",
    prelude("tok") + "SELECT id, token, count(*) AS cnt FROM tok GROUP BY id, token",
)
def f01_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding tokeniser: lower-case letter runs of length 2-15."""
    occ = fx.token_occurrences(fx.comments(spark, sf_dir))
    return occ.groupBy("id", "token").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "f02_bow_tokens",
    prelude("comments", extra=[BOW_TOK]) + "SELECT DISTINCT id, token FROM btok",
)
def f02_bow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-words tokeniser (>= 2 word characters), binary per row."""
    c = fx.comments(spark, sf_dir)
    return c.select("id", F.explode(F.array_distinct(bow_tokens("comment_text"))).alias("token"))


@query("f03_tweet_normalise")
def f03_tweet_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """14-rule tweet normaliser over every comment and conversation turn.

    No SQL oracle: rule 12 needs a back-reference in the pattern, which the
    oracle's regex engine lacks; tests check it against a brute-force
    implementation on the small tables and the micro-fixtures.
    """
    c = fx.comments(spark, sf_dir).select("id", F.col("comment_text").alias("text"))
    conv = fx.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    both = c.withColumn("source", F.lit("comments")).unionByName(conv.withColumn("source", F.lit("conversations")))
    out = both.select("source", "id", normalise_tweet("text").alias("normalised"))
    return out.select(
        "source", "id", F.length("normalised").cast("bigint").alias("length"),
        F.size(word_tokens("normalised")).cast("bigint").alias("n_tokens"),
        F.md5("normalised").alias("digest"),
    )


VOCAB_SQL = r""", trainbtok AS (
  SELECT DISTINCT b.id, b.token FROM btok b SEMI JOIN (SELECT id FROM bsplit WHERE split = 'train') t ON b.id = t.id),
vocab AS (SELECT token, df, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS idx FROM (
  SELECT token, count(*) AS df FROM trainbtok GROUP BY token ORDER BY df DESC, token LIMIT 10000))
"""


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from equitext.plans.q_split import _split

    df, split = _split(spark, sf_dir)
    return X.split_rows(df, split, "train"), X.split_rows(df, split, "test")


_VOCAB_HEAD = _with(SPLIT_SQL, "labelled", memberships=True).rstrip("\n") + ",\n" + BOW_TOK[0] + " AS (\n" + BOW_TOK[1] + "\n)" + VOCAB_SQL


@query("a20_vocabulary", _VOCAB_HEAD + "SELECT token, df, idx FROM vocab")
def a20_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10,000 training tokens by document frequency, alphabetical index."""
    train, _ = _train_test(spark, sf_dir)
    return B.fit_vocabulary(train)


@query(
    "m01_bow_fit",
    _VOCAB_HEAD
    + """SELECT t.id, v.idx FROM trainbtok t JOIN vocab v ON t.token = v.token""",
)
def m01_bow_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary bag-of-words of the training rows: (id, idx) per present token."""
    train, _ = _train_test(spark, sf_dir)
    vocab = B.fit_vocabulary(train)
    return B.binary_features(train, vocab)


@query(
    "m02_bow_transform",
    _VOCAB_HEAD
    + """, testbtok AS (SELECT DISTINCT b.id, b.token FROM btok b
  SEMI JOIN (SELECT id FROM bsplit WHERE split = 'test') t ON b.id = t.id)
SELECT t.id, v.idx FROM testbtok t JOIN vocab v ON t.token = v.token""",
)
def m02_bow_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows through the stored vocabulary (written, then read back)."""
    train, test = _train_test(spark, sf_dir)
    path = scratch_path(spark, f"vocab-{uuid.uuid4().hex}")
    B.fit_vocabulary(train).write.mode("overwrite").parquet(path)
    vocab = spark.read.parquet(path)
    return B.binary_features(test, vocab)


@query("s10_vocabulary_sink", _VOCAB_HEAD + "SELECT token, df, idx FROM vocab")
def s10_vocabulary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary written as Parquet (token, df, idx) and scanned back."""
    train, _ = _train_test(spark, sf_dir)
    path = scratch_path(spark, f"vocab-{uuid.uuid4().hex}")
    B.fit_vocabulary(train).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


IDF_SQL = """, nd AS (SELECT count(*) AS n FROM comments),
bdf AS (SELECT token, count(DISTINCT id) AS df FROM btok GROUP BY token),
idf AS (SELECT w.token, CAST(coalesce(b.df, 0) AS BIGINT) AS df,
  ln((1 + nd.n) / (1 + coalesce(b.df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT token FROM word_vectors) w LEFT JOIN bdf b ON b.token = w.token, nd)
"""


@query(
    "a21_idf",
    prelude("word_vectors", extra=[BOW_TOK]) .rstrip("\n") + IDF_SQL
    + f"SELECT token, df, {_r('idf', 'idf')} FROM idf",
)
def a21_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth IDF over the word-vector vocabulary."""
    c = fx.comments(spark, sf_dir)
    return B.idf_table(c, fx.word_vectors(spark, sf_dir))


@query(
    "a21_tfidf",
    prelude("word_vectors", extra=[BOW_TOK]).rstrip("\n") + IDF_SQL
    + f""", tf AS (SELECT id, token, count(*) AS tf FROM btok GROUP BY id, token),
w AS (SELECT tf.id, tf.token, tf.tf * idf.idf AS v FROM tf JOIN idf ON tf.token = idf.token)
SELECT id, token, {_r('v / sqrt(sum(v * v) OVER (PARTITION BY id))', 'tfidf')} FROM w""",
)
def a21_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row L2-normalised TF-IDF over the word-vector vocabulary."""
    c = fx.comments(spark, sf_dir)
    k = fx.embedding_rows(spark, sf_dir)
    idf = B.idf_table(c, fx.word_vectors(spark, sf_dir))
    return B.tfidf(c, idf, bound_rows=k)
