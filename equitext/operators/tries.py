"""Tries of the debias search per document (O4) and weights carried from one
document to the next (M7/M8 with the original's running weight table).

A *try* gives every eligible token its best accepted draw out of
``draws / tries``.  The draws of a token depend on the token and the try only,
so a try is a column of numbers per vocabulary token: the logit of its vector
in that try.  A document's logit in a try is the mean of these numbers, and all
tries are side by side in one aggregate per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitext.functions import vectors as V
from equitext.functions.text import word_tokens
from equitext.operators.debias import (
    Directions,
    SearchParams,
    _consts,
    best_draws,
    search_candidates,
    token_geometry,
    weight_columns,
)
from equitext.operators.joins import lookup_join
from equitext.operators.model import wide_sum
from equitext.session import materialize
from equitext.sources.fixtures import LinearModel

TRIES = 10
#: logits are summed as whole numbers of this unit, so sums are exact and
#: tries that are equal are exactly equal under any partitioning
UNIT = 1e12


def try_table(
    tokens: DataFrame,
    vectors: DataFrame,
    model: LinearModel,
    dirs: Directions,
    params: SearchParams = SearchParams(),
    tries: int = TRIES,
    similar: DataFrame | None = None,
    bound_rows: int | None = None,
) -> DataFrame:
    """(token, kind, tries, units, best_unit) for every token with a vector.

    ``units`` holds its logit in each try, ``best_unit`` with its best draw over
    all tries; ``tries`` the chosen draws (NULL: none accepted, the vector stays
    as it is).  ``kind`` and ``tries`` are NULL for tokens that no rule applies
    to and for those not in ``tokens``.
    """
    cand = search_candidates(tokens, vectors, model, dirs, params, similar, bound_rows)
    found = cand.select("token", "kind", best_draws(params, _consts(model, dirs), tries).alias("tries"))
    base = token_geometry(vectors, model, dirs).select("token", "z0")
    z0 = F.col("z0")

    def unit(z: Column) -> Column:
        return F.round(z * UNIT).cast("bigint")

    units = F.when(F.col("tries").isNull(), F.array_repeat(unit(z0), tries)).otherwise(
        F.transform("tries", lambda t: unit(F.coalesce(t["z"], z0))))
    return base.join(found, "token", "left").select(
        "token", "kind", "tries", units.alias("units"),
        unit(F.coalesce(F.array_max("tries")["z"], z0)).alias("best_unit"))


def _probability(units: Column, n: Column, bias: float) -> Column:
    """Mean logit of a document from its sum; no known token: the bias."""
    mean = F.try_divide(units.cast("double") / UNIT, n.cast("double"))
    return V.sigmoid(F.coalesce(mean, F.lit(float(bias))))


def _winner(sums: list[Column], n: Column, bias: float) -> Column:
    """(p, nt): the highest probability and minus the (1-based) try; of equal
    tries the first, as only a strictly better one replaces it."""
    return F.array_max(F.array(*[
        F.struct(_probability(s, n, bias).alias("p"), F.lit(-t).alias("nt")) for t, s in enumerate(sums, 1)]))


def best_try(
    docs: DataFrame,
    table: DataFrame,
    bias: float,
    tries: int = TRIES,
    id_col: str = "id",
    text_col: str = "comment_text",
    bound_rows: int | None = None,
) -> DataFrame:
    """(id, n_known, best_try, pred, pred_token_best) per document: the try
    with the highest probability, and the probability if every token took its
    own best draw instead.  A document without a known token has try 1."""
    occ = docs.select(id_col, F.explode_outer(word_tokens(text_col)).alias("token"))
    j = lookup_join(occ, table.select("token", "units", "best_unit"), "token", how="left", bound_rows=bound_rows, dim=tries)
    per = j.groupBy(id_col).agg(
        F.count("best_unit").alias("n_known"), wide_sum(F.col("best_unit")).alias("_best"),
        *[wide_sum(F.col("units")[t]).alias(f"_t{t}") for t in range(tries)])
    n = F.col("n_known")
    won = per.withColumn("_w", _winner([F.col(f"_t{t}") for t in range(tries)], n, bias))
    return won.select(id_col, "n_known", (-F.col("_w.nt")).alias("best_try"), F.col("_w.p").alias("pred"),
                      _probability(F.col("_best"), n, bias).alias("pred_token_best"))


def try_weights(
    docs: DataFrame, winners: DataFrame, table: DataFrame, id_col: str = "id", text_col: str = "comment_text",
    bound_rows: int | None = None,
) -> DataFrame:
    """(id, token, best_try, add_pleasent, sub_unpleasent, sub_pleasent,
    add_unpleasent): the weights of each document's winning try."""
    rows = docs.join(winners.select(id_col, "best_try"), id_col).select(
        id_col, "best_try", F.explode(F.array_distinct(word_tokens(text_col))).alias("token"))
    eligible = table.where("tries IS NOT NULL").select("token", "kind", "tries")
    j = lookup_join(rows, eligible, "token", bound_rows=bound_rows)
    chosen = j.withColumn("_b", F.element_at("tries", F.col("best_try"))).where("_b IS NOT NULL")
    return chosen.select(id_col, "token", "best_try", *weight_columns(F.col("kind"), F.col("_b")))


def carried_weights(
    docs: DataFrame,
    table: DataFrame,
    bias: float,
    tries: int = TRIES,
    id_col: str = "id",
    text_col: str = "comment_text",
    bound_rows: int | None = None,
) -> DataFrame:
    """(token, writer, best_try, add_pleasent, ...): the weight table that is
    carried through the documents in id order.

    A document uses the weights that earlier documents have written; its other
    eligible tokens take their draws, and those accepted in its winning try are
    written.  So a token's weights come from the first document whose winning
    try accepts a draw of it (``writer``), and that try depends on earlier
    writers.

    The table is found as a fixed point: each round gives every document the
    weights of writers before it from the last round, and takes per token the
    smallest id that writes.  After k rounds whatever depends on a chain of at
    most k writers is final, and a round that changes nothing ends the search;
    by induction over the ids the fixed point is the table of the walk in order.
    A round is one join with the vocabulary and one aggregate per document; the
    (token, writer, try) table is written each round, so lineage stays short.
    """
    occ = docs.select(id_col, F.explode(word_tokens(text_col)).alias("token"))
    counts = occ.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("cnt"))
    known = lookup_join(counts, table.select("token", "units", (F.col("tries").isNotNull()).alias("open"), F.transform(
        F.coalesce("tries", F.array().cast(dict(table.dtypes)["tries"])), lambda t: t.isNotNull()).alias("accepts")),
        "token", bound_rows=bound_rows, dim=tries)
    # tokens that nothing can change are one sum per document
    pairs = materialize(known, "carried-pairs")
    fixed = pairs.where(~F.col("open")).groupBy(id_col).agg(
        F.sum("cnt").alias("n0"), wide_sum(F.col("cnt") * F.col("units")[0]).alias("u0"))
    open_pairs = pairs.where("open").select(id_col, "token", "cnt", "units", "accepts")
    writers = None
    while True:
        if writers is None:
            rows = open_pairs.withColumns({"writer": F.lit(None).cast(dict(docs.dtypes)[id_col]),
                                           "at": F.lit(None).cast("int")})
        else:
            rows = open_pairs.join(writers, "token", "left")
        given = F.col("writer") < F.col(id_col)  # NULL: not yet
        unit = [F.when(given, F.element_at("units", F.col("at"))).otherwise(F.col("units")[t]) for t in range(tries)]
        per = rows.groupBy(id_col).agg(
            F.sum("cnt").alias("n1"), *[wide_sum(F.col("cnt") * u).alias(f"_t{t}") for t, u in enumerate(unit)],
            # a document's own tokens
            F.collect_list(F.when(F.coalesce(given, F.lit(False)), None).otherwise(
                F.struct("token", "accepts"))).alias("free"))
        whole = per.join(fixed, id_col, "left")
        zero = F.lit(0).cast("decimal(38,0)")
        sums = [F.col(f"_t{t}") + F.coalesce("u0", zero) for t in range(tries)]
        won = whole.select(id_col, "free", (-_winner(sums, F.col("n1") + F.coalesce("n0", F.lit(0)), bias)["nt"]).alias("at"))
        written = won.select(id_col, "at", F.explode(F.filter(
            "free", lambda x: F.element_at(x["accepts"], F.col("at")))["token"]).alias("token"))
        first = F.min(F.struct(F.col(id_col).alias("writer"), "at"))
        after = materialize(written.groupBy("token").agg(first.alias("f")).select("token", "f.*"), "carried-writers")
        if writers is not None:
            same = after.join(writers.withColumnsRenamed({"writer": "w", "at": "a"}), "token", "full").where(
                ~(F.col("writer").eqNullSafe(F.col("w")) & F.col("at").eqNullSafe(F.col("a"))))
            if same.limit(1).count() == 0:
                break
        writers = after
    chosen = table.where("tries IS NOT NULL").join(writers, "token").withColumn("_b", F.element_at("tries", F.col("at")))
    return chosen.select("token", "writer", F.col("at").alias("best_try"), *weight_columns(F.col("kind"), F.col("_b")))
