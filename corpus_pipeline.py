"""Corpus pipeline: stages over ``documents``, each one operator of
``equitext.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``; ``run`` does just
that.  All stages but the last return the columns of ``docs`` as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.llm import bpe_tree, decontam_seeds, exact_blocks, simhash_tiles, toxicity_channel
from equitext.llm.util import read, saved


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the rest stays."""
    return toxicity_channel.drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_blocks.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (3-word shingles, 2 bits) the document with
    the smallest doc_id stays."""
    return simhash_tiles.drop_near_copies(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    return decontam_seeds.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): ids and their decoding; ids are binary,
    little-endian unsigned 32-bit."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe_tree.encode_decode(docs, path)
    return out.select(F.col("id").alias("doc_id"), F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids", "text")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: the classifier, SimHash and BPE have no SQL; the tests hold run() against
#: a brute-force version of the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
