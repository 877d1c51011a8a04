"""Bias probes: word probes, template sets, fuzzed pairs, external sets
(M13-M17, A23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitext.functions import vectors as V
from equitext.functions.text import word_tokens
from equitext.operators import metrics as M
from equitext.operators.joins import lookup_join
from equitext.operators.model import exact_mean
from equitext.session import materialize


def word_probe(words: DataFrame, scores: DataFrame, bias: float) -> DataFrame:
    """p(toxic) of single words, each a one-token document."""
    return words.join(scores.select("token", "s"), "token").withColumn("pred", V.sigmoid(F.col("s") + F.lit(bias))).drop("s")


def fuzz(docs: DataFrame, mapping: dict[str, str], id_col: str = "id", text_col: str = "comment_text",
         keep: Sequence[str] = (), tokens=word_tokens) -> DataFrame:
    """A23 input: rows holding at least one mapped word, as token arrays,
    once as written (variant 'orig') and once with every mapped word
    replaced (variant 'fuzzed').  The mapping is a short word list, so it is
    a literal map applied inside each row: no join, no shuffle."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    toks = docs.select(id_col, *keep, tokens(text_col).alias("tokens"))
    hit = toks.where(F.exists("tokens", lambda t: F.element_at(m, t).isNotNull()))
    fz = F.transform("tokens", lambda t: F.coalesce(F.element_at(m, t), t))
    return hit.select(
        id_col, *keep,
        F.explode(F.array(
            F.struct(F.lit("orig").alias("variant"), F.col("tokens").alias("tokens")),
            F.struct(F.lit("fuzzed").alias("variant"), fz.alias("tokens")),
        )).alias("_v"),
    ).select(id_col, *keep, "_v.variant", "_v.tokens")


def score_token_arrays(rows: DataFrame, scores: DataFrame, bias: float, keys: Sequence[str],
                       tokens_col: str = "tokens", bound_rows: int | None = None) -> DataFrame:
    """(keys..., n_known, pred) for rows carrying a token array: mean-vector
    features, one row per key (no known token -> sigmoid(b))."""
    occ = rows.select(*keys, F.explode_outer(tokens_col).alias("token"))
    j = lookup_join(occ, scores.select("token", "s"), "token", how="left", bound_rows=bound_rows)
    per = j.groupBy(*keys).agg(F.count("s").alias("n_known"), exact_mean("s").alias("_z"))
    z = F.coalesce("_z", F.lit(0.0)) + F.lit(bias)
    return per.select(*keys, F.col("n_known").cast("bigint").alias("n_known"), V.sigmoid(z).alias("pred"))


def score_texts(rows: DataFrame, scores: DataFrame, bias: float, keys: Sequence[str],
                text_col: str = "text", bound_rows: int | None = None) -> DataFrame:
    """Rows with free text: tokenise (F1) and score as ``score_token_arrays``."""
    t = rows.select(*keys, word_tokens(text_col).alias("tokens"))
    return score_token_arrays(t, scores, bias, keys, bound_rows=bound_rows)


def evaluate(scored: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "pred") -> DataFrame:
    """(keys..., n, tp, fp, fn, tn, accuracy, auc) per key.

    The scored rows are written once (one row per document, small
    next to the text), so the confusion counts and the AUC read them
    instead of scoring twice."""
    keys = list(keys)
    scored = materialize(scored.select(*keys, label, score), "scored")
    conf = M.with_rates(M.confusion_counts(scored, keys, label, score)).select(
        *keys, "n", "tp", "fp", "fn", "tn", "accuracy"
    )
    a = M.auc(scored, keys, score, label).select(*keys, "auc")
    if not keys:
        return conf.select("*", a.scalar().alias("auc"))
    return conf.join(a, keys, "left")
