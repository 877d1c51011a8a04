"""Dataset profile: projections, predicates, class balance (P1-P14, A1-A4,
A24, U1-U3).

Every profile is one scan with conditional aggregates for all groups; the
original rescans the frame once per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equitext.constants import GROUPS, THRESHOLD
from equitext.operators.metrics import group_memberships, nan_to_null, positive


def binarise(df: DataFrame, col: str = "target", out: str = "toxic") -> DataFrame:
    """``toxic = target > 0.5`` (strict); a missing target is not toxic."""
    return df.withColumn(out, F.coalesce(nan_to_null(col) > THRESHOLD, F.lit(False)))


def with_length(df: DataFrame, text_col: str = "comment_text", out: str = "length") -> DataFrame:
    """Text length in characters."""
    return df.withColumn(out, F.length(text_col).cast("bigint"))


def normalise_scores(df: DataFrame, cols: Sequence[str] = GROUPS) -> DataFrame:
    """NaN identity scores become NULL (in neither subgroup nor background)."""
    return df.withColumns({c: nan_to_null(c) for c in cols})


def identity_filter(df: DataFrame, group: str | None = None, max_length: int | None = None,
                    length_col: str = "length") -> DataFrame:
    """Rows of one group (score > 0.5), optionally with length <= n."""
    if group:
        df = df.where(positive(group))
    if max_length is not None:
        df = df.where(F.col(length_col) <= max_length)
    return df


def keyword_pattern(keywords: str | Sequence[str]) -> str:
    """Case-insensitive alternation; keywords are regular expressions
    and match as substrings (``male`` also hits ``female``)."""
    words = [keywords] if isinstance(keywords, str) else list(keywords)
    # (?iu): Unicode-aware case folding, as in the original matcher.
    return "(?iu)" + "|".join(words)


def keyword_filter(df: DataFrame, keywords: str | Sequence[str] | None = None,
                   max_length: int | None = None, text_col: str = "comment_text",
                   length_col: str = "length") -> DataFrame:
    """Rows whose text contains any keyword, optionally length <= n."""
    if keywords:
        df = df.where(F.col(text_col).rlike(keyword_pattern(keywords)))
    if max_length is not None:
        df = df.where(F.col(length_col) <= max_length)
    return df


def any_group(groups: Sequence[str] = GROUPS) -> Column:
    """The row is in at least one group (NULL scores count as not)."""
    return F.coalesce(F.greatest(*[nan_to_null(g) for g in groups]), F.lit(0.0)) > THRESHOLD


def prediction_label(score: str = "pred") -> Column:
    """Predicted positive, strict ``> 0.5``."""
    return F.coalesce(positive(score), F.lit(False))


def encode_label(col: str = "Label", positive_value: str = "BAD") -> Column:
    """P10: 1 if the label equals ``positive_value`` else 0."""
    return F.when(F.col(col) == positive_value, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def class_balance(df: DataFrame, group: str | None = None, label: str = "toxic") -> DataFrame:
    """One row (n, n_toxic, fraction_toxic) overall or in one group."""
    return identity_filter(df, group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label)).alias("n_toxic"),
        F.try_divide(F.count_if(F.col(label)).cast("double"), F.count(F.lit(1)).cast("double")).alias(
            "fraction_toxic"
        ),
    )


def _stack(row: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One-row aggregate -> one row per name, with fields ``{name}__{field}``."""
    arr = F.array(
        *[
            F.struct(F.lit(n).alias("subgroup"), *[F.col(f"{n}__{f}").alias(f) for f in fields])
            for n in names
        ]
    )
    return row.select(F.explode(arr).alias("_s")).select("_s.*")


def group_prevalence(df: DataFrame, groups: Sequence[str] = GROUPS, label: str = "toxic") -> DataFrame:
    """A2: per group n, n_toxic and the three percentages of the profile.

    One scan, 2 + 2 x groups conditional counts in one global aggregate.
    """
    y = F.col(label)
    aggs = [F.count(F.lit(1)).alias("_total")]
    for g in groups:
        aggs.append(F.count_if(positive(g)).alias(f"{g}__n"))
        aggs.append(F.count_if(positive(g) & y).alias(f"{g}__n_toxic"))
    row = df.agg(*aggs)
    total = F.col("_total").cast("double")
    long = row.select(
        "_total",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(g).alias("subgroup"),
                        F.col(f"{g}__n").alias("n"),
                        F.col(f"{g}__n_toxic").alias("n_toxic"),
                    )
                    for g in groups
                ]
            )
        ).alias("_s"),
    ).select("_total", "_s.*")
    n, t = F.col("n").cast("double"), F.col("n_toxic").cast("double")
    return long.select(
        "subgroup",
        "n",
        "n_toxic",
        F.try_divide(100.0 * n, total).alias("pct_of_all"),
        F.try_divide(100.0 * t, n).alias("pct_toxic_in_group"),
        F.try_divide(100.0 * t, total).alias("pct_toxic_of_all"),
    )


def group_toxic_counts(df: DataFrame, groups: Sequence[str] = GROUPS, label: str = "toxic") -> DataFrame:
    """A3: (subgroup, toxic, n) for rows in each group."""
    long = group_memberships(df, groups, keep=[label]).where(F.col("gscore") > THRESHOLD)
    return long.groupBy("subgroup", F.col(label).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def keyword_class_balance(df: DataFrame, keyword_map: Mapping[str, str | Sequence[str]],
                          text_col: str = "comment_text", label: str = "toxic") -> DataFrame:
    """A4: per keyword group, (n, n_toxic, pct_toxic) of rows whose text
    matches; one scan for all groups."""
    y = F.col(label)
    aggs = []
    for g, kw in keyword_map.items():
        hit = F.col(text_col).rlike(keyword_pattern(kw))
        aggs.append(F.count_if(hit).alias(f"{g}__n"))
        aggs.append(F.count_if(hit & y).alias(f"{g}__n_toxic"))
    long = _stack(df.agg(*aggs), list(keyword_map), ["n", "n_toxic"])
    return long.withColumn(
        "pct_toxic", F.try_divide(100.0 * F.col("n_toxic").cast("double"), F.col("n").cast("double"))
    )


def bag_union(df: DataFrame, groups: Sequence[str] = GROUPS, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per (row, group it belongs to); a row in k groups appears
    k times (the concatenation of per-group frames)."""
    return (
        group_memberships(df, groups, keep=keep)
        .where(F.col("gscore") > THRESHOLD)
        .drop("gscore")
    )


def distinct_union(*frames: DataFrame) -> DataFrame:
    """Distinct union of key sets."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def segment_flags(df: DataFrame, group: str, label: str = "toxic") -> DataFrame:
    """The four disjoint segments of one group as a column
    (sub_pos, sub_neg, bg_pos, bg_neg); NULL scores are in none."""
    y = F.col(label)
    return df.withColumn(
        "segment",
        F.when(positive(group) & y, "sub_pos")
        .when(positive(group) & ~y, "sub_neg")
        .when((nan_to_null(group) <= THRESHOLD) & y, "bg_pos")
        .when((nan_to_null(group) <= THRESHOLD) & ~y, "bg_neg"),
    )


def false_positives(df: DataFrame, groups: Sequence[str] = GROUPS, score: str = "pred",
                    label: str = "toxic", keep: Sequence[str] = ("id",)) -> DataFrame:
    """Per group, rows predicted positive that are not toxic."""
    rows = df.where(prediction_label(score) & ~F.col(label))
    return bag_union(rows, groups, keep=keep)


def error_rows(df: DataFrame, score: str = "pred", label: str = "toxic") -> DataFrame:
    """False positives and false negatives, with the error kind; a row
    without a prediction is neither."""
    p = positive(score)
    y = F.col(label)
    return df.where(p != y).withColumn("error", F.when(p, F.lit("fp")).otherwise(F.lit("fn")))
