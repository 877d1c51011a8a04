"""Queries: word vectors, document vectors, similarity, stop list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.constants import COMPOSITE_GROUP, COMPOSITE_KEYWORDS, GROUPS, IDENTITY_WORDS
from equitext.functions import vectors as V
from equitext.operators import bow as B
from equitext.operators import embed as E
from equitext.plans.oracle import prelude
from equitext.plans.q_profile import MEMBERSHIPS, _r, labelled
from equitext.plans.q_text import BOW_TOK, IDF_SQL
from equitext.plans.registry import query
from equitext.session import literal_table, scratch_path
from equitext.sources import fixtures as fx

# Each group's identity word: the group name itself, or the first keyword
# of the composite group; the psychiatric group has none.
PROXIMITY_POSITIONS = {
    g: IDENTITY_WORDS.index(COMPOSITE_KEYWORDS[0] if g == COMPOSITE_GROUP else g)
    for g in GROUPS
    if g in IDENTITY_WORDS or g == COMPOSITE_GROUP
}
SELF_SIMILARITY = 1.0 - 1e-9  # a token "is" the identity word at cosine >= 1


def _norm_sql(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


@query(
    "s08_word_vector_scan",
    prelude("word_vectors")
    + f"SELECT token, r, CAST(len(vec) AS BIGINT) AS dim, {_r(_norm_sql('vec'), 'norm')} FROM word_vectors",
)
def s08_word_vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors written in word2vec text format (header line first) and
    scanned back with the text reader."""
    wv = fx.word_vectors(spark, sf_dir)
    n = fx.embedding_rows(spark, sf_dir)
    dim = fx.embedding_dim(spark, sf_dir)
    path = scratch_path(spark, f"w2v-{uuid.uuid4().hex}")
    header = literal_table(spark, [(f"{n} {dim}",)], "value string")
    body = wv.select(F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    header.unionByName(body).write.mode("overwrite").text(path)
    back = E.read_word2vec_text(spark, path)
    ranks = wv.select("token", "r")
    return back.join(ranks, "token").select(
        "token", "r", F.size("vec").cast("bigint").alias("dim"), V.norm("vec").alias("norm")
    )


@query(
    "j05_token_vector_join",
    prelude("tok", "word_vectors")
    + """SELECT c.id, CAST(count(t.token) AS BIGINT) AS n_tokens,
  CAST(count(w.token) AS BIGINT) AS n_known
FROM comments c LEFT JOIN tok t ON c.id = t.id LEFT JOIN word_vectors w ON t.token = w.token
GROUP BY c.id""",
)
def j05_token_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token occurrences joined to vectors; unknown tokens are dropped."""
    c = fx.comments(spark, sf_dir)
    k = fx.embedding_rows(spark, sf_dir)
    occ = fx.token_occurrences(c)
    wv = fx.word_vectors(spark, sf_dir).select("token", F.lit(1).alias("known"))
    from equitext.operators.joins import lookup_join

    j = lookup_join(occ, wv, "token", how="left", bound_rows=k)
    per = j.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count("known").alias("n_known")
    )
    return c.select("id").join(per, "id", "left").select(
        "id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce("n_known", F.lit(0)).cast("bigint").alias("n_known"),
    )


MEAN_SQL = """SELECT '{name}' AS list_name, CAST(pos AS BIGINT) AS pos, round(avg(x), 6) + 0.0 AS value FROM (
  SELECT unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM {view}) GROUP BY pos"""


@query(
    "a16_mean_vectors",
    prelude("identity_words", "pleasant_words", "unpleasant_words")
    + "\nUNION ALL\n".join(
        MEAN_SQL.format(name=n, view=f"{n}_words") for n in ("identity", "pleasant", "unpleasant")
    ),
)
def a16_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each word list (identity, pleasant, unpleasant)."""
    wv = fx.word_vectors(spark, sf_dir)
    out = None
    for name in ("identity", "pleasant", "unpleasant"):
        m = E.mean_vector_long(wv, fx.word_list(wv, name)).select(
            F.lit(name).alias("list_name"), F.col("pos").cast("bigint").alias("pos"), "value"
        )
        out = m if out is None else out.unionByName(m)
    return out


@query(
    "a17_doc_mean_vectors",
    prelude("tok", "word_vectors").rstrip("\n")
    + """, mv AS (SELECT t.id, pos, avg(w.vec[pos + 1]) AS value
  FROM tok t JOIN word_vectors w ON t.token = w.token, range(64) p(pos) GROUP BY t.id, pos),
known AS (SELECT DISTINCT id FROM mv)
SELECT id, CAST(pos AS BIGINT) AS pos, round(value, 6) + 0.0 AS value FROM mv
UNION ALL SELECT c.id, CAST(pos AS BIGINT), 0.0 FROM comments c, range(64) p(pos)
WHERE c.id NOT IN (SELECT id FROM known)""",
)
def a17_doc_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of known token vectors per comment (zero vector if none), long form."""
    c = fx.comments(spark, sf_dir)
    k, dim = fx.embedding_shape(spark, sf_dir)
    dv = E.doc_vectors(c, fx.word_vectors(spark, sf_dir), "mean", dim=dim, bound_rows=k, chars=lambda: fx.text_chars(spark, sf_dir))
    return dv.select("id", F.posexplode("vec").alias("pos", "value")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), "value"
    )


@query(
    "a18_doc_sum_vectors",
    prelude("tok", "word_vectors").rstrip("\n")
    + """, dv AS (SELECT t.id, count(*) AS n_known, pos, sum(w.vec[pos + 1]) AS value
  FROM tok t JOIN word_vectors w ON t.token = w.token, range(64) p(pos) GROUP BY t.id, pos),
agg AS (SELECT id, max(n_known) AS n_known, sqrt(sum(value * value)) AS norm, sum(value) AS total
  FROM dv GROUP BY id)
SELECT c.id, CAST(coalesce(a.n_known, 0) AS BIGINT) AS n_known,
  round(coalesce(a.norm, 0.0), 6) + 0.0 AS norm, round(coalesce(a.total, 0.0), 6) + 0.0 AS total
FROM comments c LEFT JOIN agg a ON c.id = a.id""",
)
def a18_doc_sum_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of known token vectors per comment: (id, n_known, norm, total)."""
    c = fx.comments(spark, sf_dir)
    k, dim = fx.embedding_shape(spark, sf_dir)
    dv = E.doc_vectors(c, fx.word_vectors(spark, sf_dir), "sum", dim=dim, bound_rows=k, chars=lambda: fx.text_chars(spark, sf_dir))
    return dv.select(
        "id", "n_known", V.norm("vec").alias("norm"),
        F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    "a19_tfidf_vectors",
    prelude("tok", "word_vectors", extra=[BOW_TOK]).rstrip("\n") + IDF_SQL
    + """, tf AS (SELECT id, token, count(*) AS tf FROM btok GROUP BY id, token),
tw AS (SELECT tf.id, tf.token, tf.tf * idf.idf AS v FROM tf JOIN idf ON tf.token = idf.token),
tfidf AS (SELECT id, token, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS tfidf FROM tw),
occ AS (SELECT t.id, t.token, w.vec, coalesce(f.tfidf, 0.0) AS wt FROM tok t
  JOIN word_vectors w ON t.token = w.token LEFT JOIN tfidf f ON f.id = t.id AND f.token = t.token),
dv AS (SELECT id, pos, sum(vec[pos + 1] * wt) / count(*) AS value, count(*) AS n_known
  FROM occ, range(64) p(pos) GROUP BY id, pos),
agg AS (SELECT id, max(n_known) AS n_known, sqrt(sum(value * value)) AS norm FROM dv GROUP BY id)
SELECT c.id, CAST(coalesce(a.n_known, 0) AS BIGINT) AS n_known, round(coalesce(a.norm, 0.0), 6) + 0.0 AS norm
FROM comments c LEFT JOIN agg a ON c.id = a.id""",
)
def a19_tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF-weighted token vectors divided by the known-token count."""
    c = fx.comments(spark, sf_dir)
    k, dim = fx.embedding_shape(spark, sf_dir)
    wv = fx.word_vectors(spark, sf_dir)
    dv = E.tfidf_doc_vectors(c, wv, B.idf_table(c, wv), dim=dim, bound_rows=k, chars=lambda: fx.text_chars(spark, sf_dir))
    return dv.select("id", "n_known", V.norm("vec").alias("norm"))


_PROX_ROWS = ", ".join(f"('{g}', {k})" for g, k in PROXIMITY_POSITIONS.items())


@query(
    "a22_identity_proximity",
    prelude("labelled", "tok", "word_vectors", "identity_words", extra=[MEMBERSHIPS]).rstrip("\n")
    + f""", anchor AS (SELECT * FROM (VALUES {_PROX_ROWS}) t(subgroup, k)),
an AS (SELECT a.subgroup, w.vec, {_norm_sql('w.vec')} AS n FROM anchor a JOIN identity_words w ON w.k = a.k),
au AS (SELECT subgroup, list_transform(vec, lambda x: x / n) AS u FROM an),
wn AS (SELECT token, vec, {_norm_sql('vec')} AS n FROM word_vectors),
wu AS (SELECT token, list_transform(vec, lambda x: x / n) AS u FROM wn),
rows_ AS (SELECT m.id, m.subgroup, CAST(m.length AS BIGINT) AS comment_length FROM memberships m
  JOIN anchor a ON a.subgroup = m.subgroup WHERE m.gscore > 0.5),
sims AS (SELECT r.id, r.subgroup,
  list_sum(list_transform(range(1, 65), lambda i: wu.u[i] * au.u[i])) AS sim
  FROM rows_ r JOIN tok t ON t.id = r.id JOIN wu ON wu.token = t.token JOIN au ON au.subgroup = r.subgroup),
agg AS (SELECT id, subgroup, count(*) AS n, avg(sim) AS ms FROM sims WHERE sim < {SELF_SIMILARITY!r}
  GROUP BY id, subgroup)
SELECT r.id, r.subgroup, r.comment_length, CAST(coalesce(a.n, 0) AS BIGINT) AS number_embeddings,
  round(a.ms, 6) + 0.0 AS mean_similarity
FROM rows_ r LEFT JOIN agg a ON a.id = r.id AND a.subgroup = r.subgroup""",
)
def a22_identity_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group row: how many of its words sit near the group's identity
    word, and their mean cosine (the word itself excluded)."""
    df = labelled(spark, sf_dir)
    k = fx.embedding_rows(spark, sf_dir)
    wv = fx.word_vectors(spark, sf_dir)
    ident = wv.join(fx.word_list(wv, "identity").select("token", "k"), "token").orderBy("k")
    anchors = [list(r["vec"]) for r in ident.select("vec").collect()]  # 10 vectors
    return E.identity_proximity(df, wv, anchors, PROXIMITY_POSITIONS, bound_rows=k, self_similarity=SELF_SIMILARITY)


@query(
    "p15_stop_list_exclusion",
    prelude("labelled", "tok", "pleasant_words", "unpleasant_words")
    + """SELECT DISTINCT t.token FROM tok t SEMI JOIN (SELECT id FROM labelled WHERE toxic) l ON t.id = l.id
WHERE t.token NOT IN (SELECT token FROM pleasant_words UNION ALL SELECT token FROM unpleasant_words)""",
)
def p15_stop_list_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of toxic rows, minus the pleasant/unpleasant lists."""
    df = labelled(spark, sf_dir)
    wv = fx.word_vectors(spark, sf_dir)
    stop = fx.word_list(wv, "pleasant").unionByName(fx.word_list(wv, "unpleasant"))
    toks = fx.token_occurrences(df.where("toxic")).select("token").distinct()
    return E.exclude_words(toks, stop, bound_rows=20)
