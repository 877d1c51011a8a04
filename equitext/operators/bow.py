"""Bag-of-words and TF-IDF features.

The vocabulary keeps the ``k`` tokens with the highest *document* frequency
(ties by token), and indexes them alphabetically, as a binary count
vectoriser with ``max_features`` does.  Spark's own ``CountVectorizer`` ranks
by term count even when ``binary=True``, so it is only used with our
vocabulary (``CountVectorizerModel.from_vocabulary``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equitext.constants import VOCAB_SIZE
from equitext.functions import vectors as V
from equitext.functions.text import bow_tokens
from equitext.operators.joins import lookup_join
from equitext.operators.model import exact_sum


def document_frequency(df: DataFrame, text_col: str = "comment_text", tokens=bow_tokens) -> DataFrame:
    """(token, df): tokens de-duplicated per row, counted with map-side
    partial aggregation (no (id, token) shuffle)."""
    return (
        df.select(F.explode(F.array_distinct(tokens(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def top_k_by_df(dfreq: DataFrame, k: int) -> DataFrame:
    """The k (token, df) rows with the highest df, ties by token.

    A plain ``orderBy().limit(k)`` merges k rows from every partition in one
    task.  Instead the k-th largest df value is found first from the small
    histogram (df -> number of tokens; a scalar subquery, no driver round
    trip), so only tokens at or above it enter the final top-k.  The
    (token, df) table is written once, so the histogram and the top-k read
    it instead of tokenising the corpus twice.
    """
    from equitext.session import materialize

    dfreq = materialize(dfreq, "doc-freq")
    hist = dfreq.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    cum = F.sum("n").over(Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0))
    threshold = hist.select("df", cum.alias("cum")).where(F.col("cum") >= k).agg(F.max("df")).scalar()
    cand = dfreq.where(F.col("df") >= F.coalesce(threshold, F.lit(0)))
    return cand.orderBy(F.desc("df"), F.asc("token")).limit(k)


def fit_vocabulary(df: DataFrame, k: int = VOCAB_SIZE, text_col: str = "comment_text") -> DataFrame:
    """(token, df, idx) of the top-k tokens by document frequency.

    The top-k reads only tokens at or above the k-th largest df; the
    alphabetical index is a window over those k rows only.
    """
    top = top_k_by_df(document_frequency(df, text_col), k)
    return top.withColumn("idx", (F.row_number().over(Window.orderBy("token")) - 1).cast("bigint"))


def binary_features(df: DataFrame, vocab: DataFrame, k: int = VOCAB_SIZE,
                    id_col: str = "id", text_col: str = "comment_text") -> DataFrame:
    """M1/M2 as pairs: (id, idx) for every vocabulary token present in a row.
    The vocabulary side is bounded by k rows, so it is broadcast."""
    toks = df.select(id_col, F.explode(F.array_distinct(bow_tokens(text_col))).alias("token"))
    return lookup_join(toks, vocab.select("token", "idx"), "token", bound_rows=k).select(id_col, "idx")


def vectoriser(vocab: DataFrame, k: int = VOCAB_SIZE) -> CountVectorizerModel:
    """M1: a binary ``CountVectorizerModel`` over our vocabulary (alphabetical
    index order); at most k tokens reach the driver."""
    words = [r[0] for r in vocab.orderBy("idx").select("token").collect()]
    return CountVectorizerModel.from_vocabulary(words, inputCol="bow_tokens", outputCol="features", binary=True)


def sparse_features(df: DataFrame, model: CountVectorizerModel, text_col: str = "comment_text") -> DataFrame:
    """M2: add a sparse binary ``features`` vector with a stored vocabulary."""
    return model.transform(df.withColumn("bow_tokens", bow_tokens(text_col))).drop("bow_tokens")


def idf_table(df: DataFrame, vocabulary: DataFrame, text_col: str = "comment_text") -> DataFrame:
    """(token, df, idf) with smooth idf ``ln((1 + n) / (1 + df)) + 1``
    over a fixed vocabulary (tokens absent from the corpus get df = 0)."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    dfreq = document_frequency(df, text_col)
    voc = vocabulary.select("token").distinct()
    j = voc.join(dfreq, "token", "left").select("token", F.coalesce("df", F.lit(0)).alias("df"))
    return j.select(
        "token",
        F.col("df").cast("bigint").alias("df"),
        (F.log((1.0 + n.scalar()) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
    )


def token_counts(df: DataFrame, id_col: str = "id", text_col: str = "comment_text", tokens=bow_tokens) -> DataFrame:
    """(id, token, cnt).  Occurrences are counted before the shuffle (partial
    aggregate); rows already partitioned by id are not shuffled again."""
    occ = df.select(id_col, F.explode(tokens(text_col)).alias("token"))
    return occ.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("cnt"))


def tfidf(df: DataFrame, idf: DataFrame, id_col: str = "id", text_col: str = "comment_text",
          bound_rows: int | None = None) -> DataFrame:
    """(id, token, tfidf), raw term count x idf, L2-normalised per row."""
    tf = token_counts(df, id_col, text_col).withColumnRenamed("cnt", "tf")
    j = lookup_join(tf, idf.select("token", "idf"), "token", bound_rows=bound_rows)
    w = j.withColumn("_v", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "token", (F.col("_v") / norm).alias("tfidf"))


def coefficient_table(vocab: DataFrame, model) -> DataFrame:
    """(token, s): a fitted sparse model over the vocabulary's indices.  Its
    coefficients (at most k numbers) are on the driver already."""
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients.toArray()])
    return vocab.select("token", F.element_at(weights, (F.col("idx") + 1).cast("int")).alias("s"))


def score_token_sets(rows: DataFrame, coef: DataFrame, bias: float, keys: Sequence[str], tokens_col: str,
                     bound_rows: int = VOCAB_SIZE) -> DataFrame:
    """M6 for bag-of-words: (keys..., n_known, pred) for rows with a token
    array; each distinct token counts once, unknown tokens not at all."""
    occ = rows.select(*keys, F.explode_outer(F.array_distinct(tokens_col)).alias("token"))
    j = lookup_join(occ, coef.select("token", "s"), "token", how="left", bound_rows=bound_rows)
    per = j.groupBy(*keys).agg(F.count("s").alias("n_known"), exact_sum("s").alias("_z"))
    z = F.coalesce("_z", F.lit(0.0)) + F.lit(float(bias))
    return per.select(*keys, F.col("n_known").cast("bigint").alias("n_known"), V.sigmoid(z).alias("pred"))


def score_rows(rows: DataFrame, coef: DataFrame, bias: float, keys: Sequence[str],
               text_col: str = "comment_text") -> DataFrame:
    """Rows with free text, tokenised and scored as ``score_token_sets``."""
    return score_token_sets(rows.select(*keys, bow_tokens(text_col).alias("_tokens")), coef, bias, keys, "_tokens")
