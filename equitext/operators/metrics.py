"""Classification and bias metrics.

AUC is the tie-aware rank-sum statistic computed from per-score counts:

    AUC = sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (sum pos * sum neg)

which equals the trapezoidal ROC area with ties.  Rows are first reduced to
one row per (key, distinct score) with map-side partial aggregation.  The
running count of negatives is a window over a table of at most ``BUCKET_ROWS``
distinct scores; a larger table is cut into buckets of about that many rows
(bounds from approximate quantiles), with a per-bucket offset from a small
table, so a single "overall" key does not become a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.ml.feature import Bucketizer

from equitext.constants import GROUPS, OVERALL_MODEL_WEIGHT, POWER, THRESHOLD
from equitext.session import literal_table, materialize

#: rows that one window may hold
BUCKET_ROWS = 1 << 20


def nan_to_null(c: Column | str) -> Column:
    """Spark's NaN > 0.5 is true; pandas' is false.  Normalise NaN to NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def positive(c: Column | str) -> Column:
    """Strict ``> 0.5``; NULL stays NULL (so it is in no segment)."""
    return nan_to_null(c) > THRESHOLD


def background(c: Column | str) -> Column:
    """``<= 0.5``; NULL stays NULL."""
    return nan_to_null(c) <= THRESHOLD


# --------------------------------------------------------------------------
# Confusion matrix and rates
# --------------------------------------------------------------------------


def confusion_counts(
    df: DataFrame, keys: Sequence[str] = (), label: str = "toxic", score: str = "pred"
) -> DataFrame:
    """(keys, n, tp, fp, fn, tn) with prediction ``score > 0.5``.

    One rule for all metrics: a row without a score or without a label is in
    neither the matrix nor the AUC."""
    y = F.col(label)
    p = positive(score)
    df = df.where(p.isNotNull() & y.isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"),
        F.count_if(~p & ~y).alias("tn"),
    ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * 100.0, den.cast("double"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds accuracy (fraction) and the percentage rates of the report."""
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    return counts.select(
        "*",
        F.try_divide((tp + tn).cast("double"), n.cast("double")).alias("accuracy"),
        _pct(tp + fp, n).alias("acceptance_rate"),
        _pct(tp, tp + fn).alias("tpr"),
        _pct(tn, tn + fp).alias("tnr"),
        _pct(fn, fn + tp).alias("fnr"),
        _pct(fp, fp + tn).alias("fpr"),
    )


# --------------------------------------------------------------------------
# Running sums and AUC
# --------------------------------------------------------------------------


def prefix_sums_below(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    value_cols: Sequence[str],
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """For each row, ``<v>_below`` = sum of v over rows of the same keys with a
    strictly smaller ``order_col`` (rows are distinct per keys + order_col).

    Exact.  The input (already reduced to distinct scores) is written once to
    the shared checkpoint folder, so the steps below do not recompute it.  A
    table of up to ``bucket_rows`` rows is one window per key.  A larger one is
    cut by quantiles of ``order_col`` into as many buckets as hold about that
    many rows each, so tasks grow with the rows and no window does; the bucket
    bounds (rows / ``bucket_rows`` numbers) reach the driver, and the sums
    inside a bucket are offset by a running sum over the table of buckets.
    """
    keys = list(keys)
    df = materialize(df, "score-counts")
    buckets = -(-df.count() // bucket_rows)
    before = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    if buckets <= 1:
        return df.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_below") for v in value_cols])
    qs = df.approxQuantile(order_col, [i / buckets for i in range(1, buckets)], 1.0 / (4 * buckets))
    inner_splits = sorted({float(q) for q in qs if q == q and abs(q) != float("inf")})
    splits = [float("-inf"), *(inner_splits or [0.0]), float("inf")]
    b = Bucketizer(
        splits=splits, inputCol=order_col, outputCol="_bucket", handleInvalid="keep"
    ).transform(df)
    tot = b.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    w_off = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0)).alias(f"_o_{v}") for v in value_cols],
    )
    w_in = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(order_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = b.select(
        "*",
        *[F.coalesce(F.sum(v).over(w_in), F.lit(0)).alias(f"_i_{v}") for v in value_cols],
    )
    out = inner.join(offsets, [*keys, "_bucket"])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_o_{v}") + F.col(f"_i_{v}")).alias(f"{v}_below") for v in value_cols],
    )


def score_counts(
    df: DataFrame, keys: Sequence[str], score: str = "pred", label: str = "toxic"
) -> DataFrame:
    """(keys, score, pos, neg): one row per distinct score (map-side combine)."""
    y = F.col(label)
    return (
        df.where(nan_to_null(score).isNotNull() & y.isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    )


def _auc_ratio(num: Column, pos: Column, neg: Column) -> Column:
    return F.try_divide(num, pos.cast("double") * neg.cast("double"))


def auc(
    df: DataFrame, keys: Sequence[str] = (), score: str = "pred", label: str = "toxic"
) -> DataFrame:
    """(keys, n_pos, n_neg, auc); NULL when a key has one class only."""
    keys = list(keys)
    k = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(1))
    sc = prefix_sums_below(score_counts(src, k, score, label), k, "score", ["neg"])
    num = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    res = sc.groupBy(*k).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        num.alias("_num"),
    )
    res = res.select(
        *keys, "n_pos", "n_neg", _auc_ratio(F.col("_num"), F.col("n_pos"), F.col("n_neg")).alias("auc")
    )
    return res


# --------------------------------------------------------------------------
# Bias AUCs (A10-A12, A15) in one scan
# --------------------------------------------------------------------------


def group_memberships(df: DataFrame, groups: Sequence[str] = GROUPS, keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., subgroup, gscore) of every non-NULL group score."""
    arr = F.array(*[F.struct(F.lit(g).alias("subgroup"), nan_to_null(g).alias("gscore")) for g in groups])
    return (
        df.select(*keep, F.explode(arr).alias("_m"))
        .select(*keep, "_m.subgroup", "_m.gscore")
        .where(F.col("gscore").isNotNull())
    )


def bias_aucs(
    df: DataFrame, groups: Sequence[str] = GROUPS, score: str = "pred", label: str = "toxic"
) -> DataFrame:
    """(subgroup, subgroup_size, subgroup_auc, bpsn_auc, bnsp_auc), a row for
    every group, also one without any annotated row; one scan, see
    ``bias_summary``."""
    return bias_summary(df, groups, score, label).where(F.col("scope") != "overall").select(
        F.col("scope").alias("subgroup"), F.col("size").alias("subgroup_size"), F.col("auc").alias("subgroup_auc"),
        "bpsn_auc", "bnsp_auc")


def subgroup_confusion(
    df: DataFrame, groups: Sequence[str] = GROUPS, score: str = "pred", label: str = "toxic"
) -> DataFrame:
    """A5-A8 per group: rows with group score > 0.5 (a row may count in several)."""
    long = group_memberships(df, groups, keep=[score, label]).where(F.col("gscore") > THRESHOLD)
    return with_rates(confusion_counts(long, ["subgroup"], label, score))


# --------------------------------------------------------------------------
# Power mean and final metric
# --------------------------------------------------------------------------


def power_mean_col(c: str, p: float = POWER) -> Column:
    """Aggregate (sum x^p / n)^(1/p) over non-NULL values."""
    return F.pow(F.avg(F.pow(F.col(c), F.lit(p))), F.lit(1.0 / p))


def power_means(bias: DataFrame, p: float = POWER) -> DataFrame:
    """One row: power means of the three AUC columns."""
    return bias.agg(
        power_mean_col("subgroup_auc", p).alias("pm_subgroup_auc"),
        power_mean_col("bpsn_auc", p).alias("pm_bpsn_auc"),
        power_mean_col("bnsp_auc", p).alias("pm_bnsp_auc"),
    )


def final_metric(
    overall_auc: DataFrame, bias: DataFrame, p: float = POWER, w: float = OVERALL_MODEL_WEIGHT
) -> DataFrame:
    """One row: overall_auc, the three power means, final_metric.

    ``overall_auc`` is a one-row DataFrame with column ``auc``; both inputs
    are one-row aggregates, so the join is one row by one row.
    """
    pm = power_means(bias, p)
    o = overall_auc.select(F.col("auc").alias("overall_auc"))
    bias_score = (F.col("pm_subgroup_auc") + F.col("pm_bpsn_auc") + F.col("pm_bnsp_auc")) / 3.0
    # The overall AUC is one value: a scalar subquery, not a join.
    return pm.select(
        o.select("overall_auc").scalar().alias("overall_auc"), *pm.columns).select(
        "overall_auc",
        "pm_subgroup_auc",
        "pm_bpsn_auc",
        "pm_bnsp_auc",
        (F.lit(w) * F.col("overall_auc") + F.lit(1.0 - w) * bias_score).alias("final_metric"),
    )


def bias_summary(
    df: DataFrame, groups: Sequence[str] = GROUPS, score: str = "pred", label: str = "toxic",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(scope, size, auc, bpsn_auc, bnsp_auc, tp, fp, fn, tn) for "overall" and
    every group, from one scan.

    Rows are reduced to one row per distinct score that holds the counts of
    all groups side by side, so no row is copied once per group.  Running sums
    over that table come first; then each score unfolds to a row per scope,
    which a partial aggregate takes in at once.
    """
    y, p = F.col("_y"), nan_to_null(score)
    src = df.where(p.isNotNull() & F.col(label).isNotNull()).select(
        p.alias("score"), F.col(label).alias("_y"), *[nan_to_null(g).alias(f"g{i}") for i, g in enumerate(groups)])
    counts = [F.count_if(y).alias("sp"), F.count_if(~y).alias("sn")]
    for i in range(len(groups)):
        inside, outside = F.col(f"g{i}") > THRESHOLD, F.col(f"g{i}") <= THRESHOLD
        counts += [F.count_if(inside & y).alias(f"sp{i}"), F.count_if(inside & ~y).alias(f"sn{i}"),
                   F.count_if(outside & y).alias(f"bp{i}"), F.count_if(outside & ~y).alias(f"bn{i}")]
    table = src.groupBy("score").agg(*counts).withColumn("_all", F.lit(1))
    running = ["sn", *[f"{c}{i}" for i in range(len(groups)) for c in ("sn", "bn")]]
    pre = prefix_sums_below(table, ["_all"], "score", running, bucket_rows)
    fields = ["sp", "sn", "bp", "bn", "sn_below", "bn_below"]
    zero = F.lit(0).cast("bigint")
    cells = [("overall", {"sp": F.col("sp"), "sn": F.col("sn"), "sn_below": F.col("sn_below")})]
    cells += [(g, {c: F.col(f"{c}{i}") for c in ("sp", "sn", "bp", "bn")}
               | {f"{c}_below": F.col(f"{c}{i}_below") for c in ("sn", "bn")}) for i, g in enumerate(groups)]
    long = pre.select("score", F.explode(F.array(*[
        F.struct(F.lit(name).alias("scope"), *[v.get(c, zero).alias(c) for c in fields]) for name, v in cells])).alias("c"))
    sp, sn, bp, bn, sb, bb = (F.col(f"c.{c}") for c in fields)
    high = F.col("score") > THRESHOLD
    per = long.groupBy("c.scope").agg(
        F.sum(sp).alias("sp"), F.sum(sn).alias("sn"), F.sum(bp).alias("bp"), F.sum(bn).alias("bn"),
        F.sum(sp * (sb + sn / 2.0)).alias("n_sub"), F.sum(bp * (sb + sn / 2.0)).alias("n_bpsn"),
        F.sum(sp * (bb + bn / 2.0)).alias("n_bnsp"),
        *[F.sum(F.when(when, c).otherwise(0)).alias(n) for n, c, when in (
            ("tp", sp, high), ("fp", sn, high), ("fn", sp, ~high), ("tn", sn, ~high))])
    # a scope without rows has a row as well
    names = literal_table(df.sparkSession, [("overall",), *[(g,) for g in groups]], "scope string")
    full = F.broadcast(names).join(per, "scope", "left")
    count = {c: F.coalesce(c, zero) for c in ("sp", "sn", "bp", "bn", "tp", "fp", "fn", "tn")}
    return full.select(
        "scope", (count["sp"] + count["sn"]).alias("size"),
        _auc_ratio(F.col("n_sub"), count["sp"], count["sn"]).alias("auc"),
        *[F.when(F.col("scope") != "overall", _auc_ratio(F.col(n), count[a], count[b])).alias(name)
          for n, a, b, name in (("n_bpsn", "bp", "sn", "bpsn_auc"), ("n_bnsp", "sp", "bn", "bnsp_auc"))],
        *[count[c].alias(c) for c in ("tp", "fp", "fn", "tn")])


def compare_models(
    df: DataFrame, base: str, other: str, groups: Sequence[str] = GROUPS, label: str = "toxic",
) -> DataFrame:
    """(scope, size, and per AUC its value under both score columns and the
    change), for "overall" and every group."""
    aucs = ["auc", "bpsn_auc", "bnsp_auc"]
    one, two = (bias_summary(df, groups, c, label).select(
        "scope", F.col("size").alias(f"_n_{c}"), *[F.col(a).alias(f"{a}_{c}") for a in aucs]) for c in (base, other))
    # a row per scope on both sides
    both = one.join(F.broadcast(two), "scope")
    return both.select(
        "scope", F.col(f"_n_{base}").alias("size"), *[f"{a}_{c}" for a in aucs for c in (base, other)],
        *[(F.col(f"{a}_{other}") - F.col(f"{a}_{base}")).alias(f"{a}_change") for a in aucs])


def final_from_summary(summary: DataFrame, p: float = POWER, w: float = OVERALL_MODEL_WEIGHT) -> DataFrame:
    """A13/A14 of a ``bias_summary``: one row, no further scan."""
    groups = F.col("scope") != "overall"
    means = [F.pow(F.avg(F.when(groups, F.pow(F.col(c), F.lit(p)))), F.lit(1.0 / p)).alias(f"pm_{n}")
             for c, n in (("auc", "subgroup_auc"), ("bpsn_auc", "bpsn_auc"), ("bnsp_auc", "bnsp_auc"))]
    one = summary.agg(F.max(F.when(~groups, F.col("auc"))).alias("overall_auc"), *means)
    bias_score = (F.col("pm_subgroup_auc") + F.col("pm_bpsn_auc") + F.col("pm_bnsp_auc")) / 3.0
    return one.select("*", (F.lit(w) * F.col("overall_auc") + F.lit(1.0 - w) * bias_score).alias("final_metric"))


def bias_report(
    df: DataFrame, groups: Sequence[str] = GROUPS, score: str = "pred", label: str = "toxic"
) -> DataFrame:
    """M18 per-group records: sizes, three AUCs, confusion and rates,
    sorted by subgroup AUC ascending (O1); one scan of ``df``."""
    per = bias_summary(df, groups, score, label).where(F.col("scope") != "overall")
    n = F.nullif(F.col("size"), F.lit(0))
    counts = per.select(
        F.col("scope").alias("subgroup"), F.col("size").alias("subgroup_size"), F.col("auc").alias("subgroup_auc"),
        "bpsn_auc", "bnsp_auc", n.alias("n"),
        # a group without rows has no matrix
        *[F.when(n.isNotNull(), F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return with_rates(counts).drop("n").orderBy(F.asc_nulls_first("subgroup_auc"), "subgroup")
