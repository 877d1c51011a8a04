"""Registered queries of this subpackage: one thin ``opN_<name>`` per
operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.llm import (
    bpe_tree,
    decontam_seeds,
    exact_blocks,
    html_styletree,
    huffman_ids,
    langid_unigram,
    rtree_negatives,
    secret_ledger,
    simhash_tiles,
    suffix_lpf,
    suffix_tree_words,
    toxicity_channel,
    trie_audit,
)
from equitext.llm.util import UPPER, fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


_NORM = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


@query("op1_exact_blocks", f"""
WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    out = exact_blocks.exact_groups(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.col("sha256").alias("text_sha256"))


@query("op7_simhash_tiles")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word SimHash, links at 2 or fewer differing bits, whole components."""
    out = simhash_tiles.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


@query("op4_toxicity_channel")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored text scored; labels are learned outside the held-out fold."""
    out = toxicity_channel.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), folds=5)
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


@query("op10_decontam_seeds")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verified overlap of each document with each benchmark
    item: at least 13 words, 0.8 of them equal."""
    out = decontam_seeds.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


@query("op8_bpe_tree")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under the word-end BPE and their decoding."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe_tree.encode_decode(read(spark, sf_dir, "documents"), path)
    return out.select(F.col("id").alias("doc_id"), F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op5_langid_unigram")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; two of three folds are learned from."""
    docs = read(spark, sf_dir, "documents")
    model = langid_unigram.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), folds=3, held_out=1)
    out = langid_unigram.predict(docs, model)
    return out.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op6_html_styletree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_styletree.extract(read(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _span_sums(out: DataFrame) -> list:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return [removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans")]


@query("op2_suffix_lpf")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 400-byte string that also starts elsewhere."""
    out = suffix_lpf.remove_repeats(read(spark, sf_dir, "documents"), min_bytes=400)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", *_span_sums(out),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_suffix_tree_words")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word window of a smaller doc_id."""
    out = suffix_tree_words.remove_repeats(read(spark, sf_dir, "documents"), min_words=50)
    return out.select(F.col("id").alias("doc_id"), "n_words", *_span_sums(out),
                      F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op9_huffman_ids")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as Huffman files in doc_id order and read back."""
    target = huffman_ids.fresh_target(spark)
    huffman_ids.write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), target, end=2)
    out = huffman_ids.read_ids(spark, target)
    return out.select(F.col("id").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"))


_RULE_SQL = """
SELECT doc_id, sha, {rank} AS rank, '{kind}' AS kind,
       list_transform(range(1, len(ms) + 1), lambda i: struct_pack(
           l := length(ms[i]), g := length(gs[i]),
           e := list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))) AS found
FROM (SELECT *, regexp_extract_all(t, {pattern}) AS ms, regexp_extract_all(t, {pattern}, {group}) AS gs,
             string_split_regex(t, {pattern}) AS gaps FROM d)"""
_RULES_SQL = [
    ("assign", r"""'([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""", 2, 6),
    ("access", "'AKIA[A-Z0-9]+'", 0, 20),
    ("hex", "'[0-9a-f]+'", 0, 24),
    ("pem", "'-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----'", 0, 1),
    ("github", "'gh[pousr]_[A-Za-z0-9]{36,}'", 0, 1),
]


def _op11_sql() -> str:
    least = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, _, _, n in _RULES_SQL) + " END"
    rules = " UNION ALL ".join(
        _RULE_SQL.format(rank=i, kind=k, pattern=p, group=g) for i, (k, p, g, _) in enumerate(_RULES_SQL))
    return f"""
WITH d AS (SELECT row_number() OVER () AS sha, doc_id, coalesce(text, '') AS t FROM documents),
r AS ({rules}),
s AS (SELECT sha, rank, kind, m.e - m.l AS b, m.e AS e FROM (SELECT sha, rank, kind, unnest(found) AS m FROM r) WHERE m.g >= {least}),
g AS (SELECT sha, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(concat_ws(':', kind, b, e), ',' ORDER BY b, rank) AS spans,
             string_agg(concat_ws(':', kind, b, e), ',' ORDER BY b, rank) FILTER (rank < 3) AS base
      FROM s GROUP BY sha)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (sha)"""


@query("op11_secret_ledger", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, each distinct text scanned once."""
    ledger = secret_ledger.fresh_ledger(spark)
    out = secret_ledger.scan(read(spark, sf_dir, "documents"), ledger)
    kinds = [r.kind for r in secret_ledger.BASE]

    def count(kind):
        return F.size(F.filter("spans", lambda s: secret_ledger.kind_of(s) == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: secret_ledger.kind_of(s).isin(kinds))
    return out.select(F.col("path").alias("doc_id"), *map(count, kinds),
                      F.sha2(secret_ledger.listed(base), 256).alias("base_sha256"),
                      secret_ledger.listed(F.col("spans")).alias("spans"))


@query("op12_rtree_negatives", """
WITH e AS (SELECT row_number() OVER () AS r, vec_id,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
             list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score,
             s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id) AS place
      FROM p JOIN s ON p.ar = s.ar AND NOT s.same
       AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY place <= 5)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM n""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree_negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


@query("op13_trie_audit", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT w.doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS m
      FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
             coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
a AS (SELECT part, filter_order, step, bit,
             sum(n) FILTER (m & (before | bit) = 0) AS kept, sum(n) FILTER (m & bit <> 0 AND m & before = 0) AS removed,
             sum(n) FILTER (m & bit <> 0 AND m & before <> 0) AS redundant, sum(n) FILTER (m = bit) AS unique_fails,
             sum(good) FILTER (m & bit <> 0 AND m & before = 0) AS good_lost,
             sum(toxic) FILTER (m & bit <> 0 AND m & before = 0) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM a""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction of five text filters in all orders, per language."""
    return trie_audit.audit(trie_audit.flags(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))
