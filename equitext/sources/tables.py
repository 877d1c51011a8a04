"""Sources and sinks.

Schemas are fixed, never inferred.  CSV inputs hold free text with quotes
and line breaks, so they are read with ``multiLine`` and doubled-quote
escapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType

from equitext.constants import GROUPS

COMMENT_SCHEMA = StructType(
    [
        StructField("id", LongType(), False),
        StructField("target", DoubleType(), True),
        StructField("comment_text", StringType(), True),
        *[StructField(g, DoubleType(), True) for g in GROUPS],
    ]
)
TEMPLATE_SCHEMA = StructType([StructField("Text", StringType()), StructField("Label", StringType())])
FUZZED_SCHEMA = StructType(
    [StructField("rev_id", LongType()), StructField("comment", StringType()), StructField("toxic", BooleanType())]
)
EXTERNAL_SCHEMA = StructType([StructField("comment", StringType()), StructField("is_toxic", BooleanType())])

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.options(**_CSV).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comment table with a fixed schema; NaN scores become NULL."""
    from equitext.operators.profile import normalise_scores

    return normalise_scores(read_csv(spark, path, COMMENT_SCHEMA))


def read_split(spark: SparkSession, path: str, which: str, columns: list[str]) -> DataFrame:
    """One side of a split table written partitioned by ``split``;
    the partition filter and column list reach the scan."""
    return spark.read.parquet(path).where(F.col("split") == which).select(*columns)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Template set (Text, Label in {BAD, NOT_BAD})."""
    return read_csv(spark, path, TEMPLATE_SCHEMA)


def read_fuzzed(spark: SparkSession, path: str) -> DataFrame:
    """Fuzzed / non-fuzzed set (rev_id, comment, toxic)."""
    return read_csv(spark, path, FUZZED_SCHEMA)


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """External labelled set (comment, is_toxic)."""
    return read_csv(spark, path, EXTERNAL_SCHEMA)


def write_predictions(preds: DataFrame, path: str, id_col: str = "id") -> None:
    """Predictions keyed by id (never by position)."""
    preds.select(id_col, "pred").write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_model(table: DataFrame, path: str) -> None:
    """A model as its (feature, weight) coefficient table."""
    table.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str):
    from equitext.operators.model import model_from_table

    return model_from_table(spark.read.parquet(path))


def metric_report(summary: DataFrame) -> DataFrame:
    """A ``bias_summary`` as long (scope, metric, value) rows instead of
    printed blocks; a group without rows has no matrix."""
    empty = F.col("size") == 0
    cols = {"subgroup_size": F.col("size"), "subgroup_auc": F.col("auc"), "bpsn_auc": F.col("bpsn_auc"),
            "bnsp_auc": F.col("bnsp_auc"), **{c: F.when(~empty, F.col(c)) for c in ("tp", "fp", "fn", "tn")}}
    wide = summary.select("scope", *[c.cast("double").alias(n) for n, c in cols.items()])
    return wide.unpivot("scope", list(cols), "metric", "value")


WEIGHT_COLUMNS = ("add_pleasent", "sub_unpleasent", "sub_pleasent", "add_unpleasent")


def write_weights(weights: DataFrame, path: str) -> None:
    """Debias weights as text, one JSON object per token
    (``{token: {weight: value, ...}}``, absent weights left out)."""
    lines = weights.select(F.to_json(F.create_map(F.col("token"), F.struct(*WEIGHT_COLUMNS))).alias("value"))
    lines.write.text(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(token, four weights) of a JSON weight file: one object per line
    as ``write_weights`` leaves it, or one object for all words (which is one
    row; a word list, small by nature).  ``{}`` for a token means no weight."""
    schema = MapType(StringType(), StructType([StructField(c, DoubleType()) for c in WEIGHT_COLUMNS]))
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.explode(F.from_json("value", schema, {"mode": "FAILFAST"})).alias("token", "w"))
    return parsed.select("token", *[F.col(f"w.{c}").alias(c) for c in WEIGHT_COLUMNS])
