"""Derived views over the driver tables (see FIXTURES.md §2).

The driver tables hold invented multilingual prose with no identity
annotations, so identity scores, targets and predictions are derived from
``doc_id`` by integer arithmetic, word vectors are attached to the most
frequent tokens, and the word lists are taken by vocabulary rank.  Every view
is a lazy DataFrame over the parquet files: its work grows with the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.constants import GROUPS
from equitext.functions.text import word_tokens
from equitext.operators.joins import lookup_join
from equitext.session import derived_table, materialize

# --- fixed values: derivation rules of the comment view ---------------------
# group i (0-based, in GROUPS order): NULL when (doc_id + i + 1) % 5 = 0,
# else ((doc_id * m_i + 13 * (i + 1)) % 100) / 180 with these multipliers:
GROUP_MULTIPLIERS = [37, 41, 43, 47, 53, 59, 61, 67, 71]
# word lists by 1-based vocabulary rank (document frequency desc, token asc)
IDENTITY_RANKS = (11, 20)
PLEASANT_RANKS = (101, 109)
UNPLEASANT_RANKS = (111, 121)
MODEL_BIAS = -0.1
# keyword search: group -> positions in the identity word list; the
# composite group uses three words, the psychiatric group is not searched.
KEYWORD_POSITIONS = {
    "black": [0],
    "christian": [1],
    "female": [2],
    "homosexual_gay_or_lesbian": [3, 5, 7],
    "jewish": [4],
    "male": [5],
    "muslim": [6],
    "white": [8],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan by ``key`` when it yields fewer partitions than
    the cluster runs tasks at once (e.g. one large row group that cannot be
    split).  This only moves rows: results are the same either way, and a scan
    of many files is left alone, so nothing is shuffled at scale."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want, key) if df.rdd.getNumPartitions() < want else df


def _group_expr(i: int) -> str:
    m = GROUP_MULTIPLIERS[i]
    return (
        f"CASE WHEN (doc_id + {i + 1}) % 5 = 0 THEN CAST(NULL AS DOUBLE) "
        f"ELSE CAST((doc_id * {m} + {13 * (i + 1)}) % 100 AS DOUBLE) / 180 END"
    )


TARGET_EXPR = (
    "CASE WHEN doc_id % 97 = 13 THEN CAST(NULL AS DOUBLE) "
    "WHEN toxic = 1 THEN 0.6e0 + CAST(doc_id % 40 AS DOUBLE) / 100 "
    "WHEN toxic = 0 THEN CAST(doc_id % 50 AS DOUBLE) / 100 "
    "ELSE CAST((doc_id * 7919) % 100 AS DOUBLE) / 160 END"
)
# predictions lean towards the label but err on both sides; some rows have
# none, as NULL or NaN
PRED_EXPR = (
    "CASE WHEN doc_id % 89 = 7 THEN CAST(NULL AS DOUBLE) "
    "WHEN doc_id % 89 = 8 THEN CAST('NaN' AS DOUBLE) ELSE "
    "CAST((doc_id * 104729) % 101 AS DOUBLE) / 160 + "
    "CASE WHEN toxic = 1 OR (toxic IS NULL AND (doc_id * 7919) % 100 > 80) "
    "THEN 0.25e0 ELSE 0e0 END END"
)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment table: id, comment_text, target, nine group scores, pred."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    # Broadcast the (doc_id, toxic) side only behind its row count (Parquet
    # metadata); above the bound both sides shuffle by doc_id.
    joined = lookup_join(docs, labels, "doc_id", how="left", bound_rows=labels.count())
    cols = [
        F.col("doc_id").alias("id"),
        F.col("text").alias("comment_text"),
        F.expr(TARGET_EXPR).alias("target"),
    ]
    cols += [F.expr(_group_expr(i)).alias(g) for i, g in enumerate(GROUPS)]
    cols.append(F.expr(PRED_EXPR).alias("pred"))
    return joined.select(*cols)


def token_occurrences(df: DataFrame, id_col: str = "id", text_col: str = "comment_text") -> DataFrame:
    """(id, token), one row per token occurrence."""
    return df.select(F.col(id_col).alias("id"), F.explode(word_tokens(text_col)).alias("token"))


def document_frequency(df: DataFrame, id_col: str = "id", text_col: str = "comment_text") -> DataFrame:
    """(token, df): documents holding each token.

    Tokens are de-duplicated inside each row, so the aggregate needs no
    (id, token) shuffle; map-side partial counts make hot tokens harmless.
    """
    return (
        df.select(F.explode(F.array_distinct(word_tokens(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def embedding_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(rows, dim) of the embedding table in one small aggregate; vec_id is
    contiguous from 0, so rows is a proven bound on the vocabulary."""
    r = table(spark, sf_dir, "embeddings").agg(
        F.max("vec_id").alias("m"), F.max(F.size("embedding")).alias("d")
    ).first()
    return int(r["m"]) + 1, int(r["d"])


def text_chars(spark: SparkSession, sf_dir: str) -> int:
    """Characters of all texts, by one scan of their column."""
    return int(table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).first()[0] or 0)


def embedding_rows(spark: SparkSession, sf_dir: str) -> int:
    return embedding_shape(spark, sf_dir)[0]


def embedding_dim(spark: SparkSession, sf_dir: str) -> int:
    return embedding_shape(spark, sf_dir)[1]


def word_vectors(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """(token, r, vec array<double>): the k most frequent tokens get vectors.

    Rank r is 1-based by (document frequency desc, token asc); vec_id = r - 1.
    The top-k reads only tokens at or above the k-th largest document
    frequency (k = the embedding row count), then a row_number over those k
    rows only.  The result (k rows) is
    written to the shared checkpoint folder: word lists, directions and
    joins then read it instead of re-tokenising the corpus, as a word-vector
    file would be read.
    """
    if corpus is None:
        # The view stands in for a word-vector input file: built once for the
        # current files, then read like that file would be.
        inputs = [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels", "embeddings")]
        return derived_table(spark, "word-vectors", inputs,
                             lambda: word_vectors(spark, sf_dir, comments(spark, sf_dir)))
    k = embedding_rows(spark, sf_dir)
    from equitext.operators.bow import top_k_by_df

    top = top_k_by_df(document_frequency(corpus), k)
    ranked = top.withColumn("r", F.row_number().over(_global_order_window()).cast("bigint"))
    emb = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).alias("r"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )
    return materialize(ranked.join(emb, "r").select("token", "r", "vec"), "word-vectors")


def _global_order_window():
    from pyspark.sql import Window

    # Over at most k rows (the limit above), so one partition is fine.
    return Window.orderBy(F.desc("df"), F.asc("token"))


def word_list(vectors: DataFrame, which: str) -> DataFrame:
    """(token, k, vec) of the identity, pleasant or unpleasant list."""
    lo, hi = {
        "identity": IDENTITY_RANKS,
        "pleasant": PLEASANT_RANKS,
        "unpleasant": UNPLEASANT_RANKS,
    }[which]
    return vectors.filter(F.col("r").between(lo, hi)).select(
        "token", (F.col("r") - lo).alias("k"), "vec"
    )


def word_list_values(vectors: DataFrame, which: str) -> list[str]:
    """The (at most 11) words of a list, in rank order, on the driver."""
    rows = word_list(vectors, which).orderBy("k").select("token").collect()
    return [r[0] for r in rows]


def keyword_map(vectors: DataFrame) -> dict[str, list[str]]:
    """Group -> keyword list, from the identity words (10 words on the driver)."""
    words = word_list_values(vectors, "identity")
    return {g: [words[i] for i in pos] for g, pos in KEYWORD_POSITIONS.items()}


@dataclass(frozen=True)
class LinearModel:
    """A logistic model over dense features: p = sigmoid(w . x + b)."""

    weights: tuple[float, ...]
    bias: float

    @property
    def dim(self) -> int:
        return len(self.weights)


def fixture_model(dim: int = 64) -> LinearModel:
    """Coefficient table generated by rule: w = ((pos*37+11) % 41 - 20) / 5."""
    return LinearModel(tuple(((p * 37 + 11) % 41 - 20) / 5.0 for p in range(dim)), MODEL_BIAS)


def fixture_weights(vectors: DataFrame) -> DataFrame:
    """Debias weights for ranks 21..60, both partial forms.

    Even rank: add_pleasent = (r % 7) / 10, sub_unpleasent = (r % 5) / 10.
    Odd rank: sub_pleasent = (r % 7) / 10, add_unpleasent = (r % 5) / 10.
    """
    even = F.col("r") % 2 == 0
    a = (F.col("r") % 7).cast("double") / 10
    b = (F.col("r") % 5).cast("double") / 10
    null = F.lit(None).cast("double")
    return vectors.filter(F.col("r").between(21, 60)).select(
        "token",
        F.when(even, a).otherwise(null).alias("add_pleasent"),
        F.when(even, b).otherwise(null).alias("sub_unpleasent"),
        F.when(~even, a).otherwise(null).alias("sub_pleasent"),
        F.when(~even, b).otherwise(null).alias("add_unpleasent"),
    )


def templates(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    """Template set (Text, Label) built from the benchmark table.

    Each benchmark item names one identity word (item_id % 10 picks it):
    ``'I am a <word>. ' || text``; even items are labelled BAD.
    """
    ident = word_list(vectors, "identity").select("k", F.col("token").alias("word"))
    bench = table(spark, sf_dir, "benchmark").select(
        "item_id", "text", (F.col("item_id") % 10).alias("k")
    )
    joined = lookup_join(bench, ident, "k", bound_rows=10)
    return joined.select(
        F.col("item_id").alias("id"),
        F.concat(F.lit("I am a "), F.col("word"), F.lit(". "), F.col("text")).alias("Text"),
        F.when(F.col("item_id") % 2 == 0, F.lit("BAD")).otherwise(F.lit("NOT_BAD")).alias("Label"),
    )


def external_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External labelled set (comment, is_toxic) from the conversations table.

    is_toxic = (conv_id * 31 + turn * 17) % 10 < 2.
    """
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("text").alias("comment"),
        (((F.col("conv_id") * 31 + F.col("turn") * 17) % 10) < 2).alias("is_toxic"),
    )
