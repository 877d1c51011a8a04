"""Word vectors and document vectors.

Token vectors live in a table (token, vec).  The vector side is broadcast when
its size in bytes is small: tokens meet it in the partition of their row, and
the per-document mean or sum is a hash aggregate of plain sums whose partial
step already holds one row per document.  A larger vector side is cut in parts
and meets blocks of whole documents, see ``routed_sums``.  Either way a document
is shuffled as its text or as one vector per part, never as a vector per token.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from equitext.constants import THRESHOLD
from equitext.functions import vectors as V
from equitext.functions.text import bow_tokens, word_tokens
from equitext.operators.joins import fits, lookup_join
from equitext.operators.metrics import nan_to_null
from equitext.session import materialize

# Bytes of vectors that a task of ``routed_sums`` holds, and tokens of text that
# it streams past them; characters of text a token, about.
PART_BYTES = 256 << 20
BLOCK_TOKENS = 64 << 20
TOKEN_CHARS = 6
# Rows whose tokens are looked up at once, and tokens whose vectors are added at once.
_SLICE_ROWS, _SLICE_TOKENS = 2000, 1 << 14


def read_word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """word2vec text format -> (token, vec array<double>).

    The header line (``<count> <dim>``) is dropped by its field count.
    """
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("f"))
    return parts.where(F.size("f") > 2).select(
        F.col("f")[0].alias("token"),
        F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.cast("double")).alias("vec"),
    )


def mean_vector_long(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """Element-wise mean of the vectors of a word list, long form
    (pos, value).  ``words`` is a (token) list, small by definition; a word
    without a vector is an error."""
    absent = [r["token"] for r in missing_words(vectors, words).orderBy("token").take(10)]
    if absent:
        raise KeyError(f"words without a vector: {', '.join(absent)}")
    j = vectors.join(words.select("token"), "token", "left_semi")
    return (
        j.select(F.posexplode("vec").alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg("x").alias("value"))
    )


def missing_words(vectors: DataFrame, words: DataFrame) -> DataFrame:
    return words.select("token").join(vectors.select("token"), "token", "left_anti")


def collect_vector(long: DataFrame) -> list[float]:
    """A (pos, value) direction to the driver: bounded by the dimension."""
    rows = long.orderBy("pos").collect()
    return [float(r["value"]) for r in rows]


def doc_vectors(
    docs: DataFrame,
    vectors: DataFrame,
    how: str = "mean",
    id_col: str = "id",
    text_col: str = "comment_text",
    dim: int | None = None,
    bound_rows: int | None = None,
    chars: Callable[[], int] | None = None,
) -> DataFrame:
    """A17 (mean) / A18 (sum): (id, n_known, vec) for every row of ``docs``.

    Unknown tokens are skipped; a row without a known token gets the zero
    vector (and n_known 0).  The sums are ``dim`` plain columns, so a vector is
    neither built per occurrence nor shuffled.  ``chars`` gives the characters
    of the texts, see ``routed_sums``; it is asked above the broadcast limit only.
    """
    if dim is None:
        raise ValueError("dim is required")
    if fits(vectors.select("token", "vec"), bound_rows, dim):
        occ = docs.select(id_col, F.explode_outer(word_tokens(text_col)).alias("token"))
        j = lookup_join(occ, vectors.select("token", "vec"), "token", how="left", bound_rows=bound_rows, dim=dim)
        per = vector_sums(j, id_col, F.lit(1), F.lit(1), dim)
    else:
        known = vectors.select("token", F.concat(whole("vec", dim), known_mark("vec")).alias("x"))
        rows = docs.select(id_col, word_tokens(text_col).alias("words"))
        per = routed_totals(routed_sums(rows, known, [id_col], [dim + 1], bound_rows, chars), id_col, dim)
    n = F.when(F.col("n_known") > 0, F.col("n_known")).otherwise(F.lit(1)) if how == "mean" else F.lit(1)
    return per.select(id_col, "n_known", F.transform("vec", lambda x: x / n).alias("vec"))


def vector_sums(rows: DataFrame, id_col: str, count: Column, weight: Column, dim: int,
                more: dict[str, Column] | None = None) -> DataFrame:
    """(id, n_known, more..., vec): per id the number of known occurrences,
    further aggregates and the weighted vector sum; rows without a vector add
    nothing."""
    more = more or {}
    sums = rows.groupBy(id_col).agg(
        F.coalesce(F.sum(F.when(F.col("vec").isNotNull(), count)), F.lit(0)).cast("bigint").alias("n_known"),
        *[c.alias(name) for name, c in more.items()],
        *[F.coalesce(F.sum(weight * F.col("vec")[i]), F.lit(0.0)).alias(f"_v{i}") for i in range(dim)])
    return sums.select(id_col, "n_known", *more, F.array(*[F.col(f"_v{i}") for i in range(dim)]).alias("vec"))


def tfidf_doc_vectors(
    docs: DataFrame,
    vectors: DataFrame,
    idf: DataFrame,
    id_col: str = "id",
    text_col: str = "comment_text",
    dim: int | None = None,
    bound_rows: int | None = None,
    chars: Callable[[], int] | None = None,
) -> DataFrame:
    """Sum over known token occurrences of vec x tfidf(doc, token),
    divided by the number of known occurrences (not by the weight sum).

    One pass: a row's word tokens (which have the vectors) and bag-of-words
    tokens (which have the weights) are counted side by side, meet one
    vocabulary of (token, vec, idf), and the norm of the weights is one more sum
    of the aggregate that adds the vectors, divided out of it at the end.  Texts
    are laid by id first, so counts and sums stay where their text is."""
    if dim is None:
        raise ValueError("dim is required")

    def marked(tokens: Column, word: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(word).alias("word")))

    vocabulary = vectors.select("token", "vec").join(idf.select("token", "idf"), "token", "left")
    laid = docs.select(id_col, F.col(text_col).alias("_text")).repartition(id_col)
    if fits(vocabulary, bound_rows, dim):
        both = F.concat(marked(word_tokens("_text"), 1), marked(bow_tokens("_text"), 0))
        occ = laid.select(id_col, F.explode_outer(both).alias("o")).select(id_col, "o.token", "o.word")
        counts = occ.groupBy(id_col, "token").agg(
            F.count_if(F.col("word") == 1).alias("cnt"), F.count_if(F.col("word") == 0).alias("tf"))
        j = lookup_join(counts, vocabulary, "token", how="left", bound_rows=bound_rows, dim=dim)
        v = F.col("tf") * F.coalesce("idf", F.lit(0.0))
        per = vector_sums(j, id_col, F.col("cnt"), F.col("cnt") * v, dim, {"_sq": F.sum(v * v)})
    else:
        i = F.coalesce("idf", F.lit(0.0))
        known = vocabulary.select("token", F.concat(known_mark("vec"), F.transform(whole("vec", dim), lambda x: x * i),
                                                    F.array(i * i)).alias("x"))
        # rows of one id are one document
        rows = laid.groupBy(id_col).agg(*[F.flatten(F.collect_list(f("_text"))).alias(c) for c, f in (
            ("words", word_tokens), ("bow", bow_tokens))])
        x = F.col("x")
        per = routed_sums(rows, known, [id_col], [1, dim, 1], bound_rows, chars).groupBy(id_col).agg(
            F.sum(x[0]).cast("bigint").alias("n_known"), F.sum(x[dim + 1]).alias("_sq"),
            *[F.sum(x[d + 1]).alias(f"_v{d}") for d in range(dim)]).select(
            id_col, "n_known", "_sq", F.array(*[F.col(f"_v{d}") for d in range(dim)]).alias("vec"))
    n = F.when(F.col("n_known") > 0, F.col("n_known")).otherwise(F.lit(1))
    by = n * F.sqrt(F.coalesce("_sq", F.lit(0.0)))
    return per.select(id_col, "n_known", by.alias("_by"), "vec").select(
        id_col, "n_known", F.transform("vec", lambda x: F.coalesce(F.try_divide(x, F.col("_by")), F.lit(0.0))).alias("vec"))


# ---------------------------------------------------------------------------
# Vocabularies above the broadcast limit
# ---------------------------------------------------------------------------


def whole(vec: str, dim: int) -> Column:
    """The vector with zeros for what it lacks."""
    return F.transform(F.coalesce(vec, V.zeros(dim)), lambda x: F.coalesce(x, F.lit(0.0)))


def known_mark(vec: str) -> Column:
    return F.array(F.col(vec).isNotNull().cast("double"))


def routed_totals(sums: DataFrame, id_col: str, dim: int, more: dict[str, Column] | None = None) -> DataFrame:
    """(id, n_known, more..., vec) of ``routed_sums`` over (vec, known mark, ...)."""
    more, x = more or {}, F.col("x")
    return sums.groupBy(id_col).agg(
        F.sum(x[dim]).cast("bigint").alias("n_known"), *[c.alias(name) for name, c in more.items()],
        *[F.sum(x[i]).alias(f"_v{i}") for i in range(dim)]).select(
        id_col, "n_known", *more, F.array(*[F.col(f"_v{i}") for i in range(dim)]).alias("vec"))


def routed_sums(rows: DataFrame, vocabulary: DataFrame, keep: list[str], widths: list[int],
                bound_rows: int | None = None, chars: Callable[[], int] | None = None) -> DataFrame:
    """(keep..., x): per row of ``rows`` (keep..., words array<string>) and part
    of the vocabulary (token, x array<double>) the sum of ``x`` over the row's
    tokens in that part; the sums of all parts add up to the row's.

    With one width, ``x`` is added once per occurrence.  With a ``bow``
    column and three, a token with cnt occurrences in ``words`` and tf in ``bow``
    adds cnt, cnt x tf and tf x tf times the three pieces of ``x``.

    This is a product of blocks: a part has at most PART_BYTES of vectors, a
    block of rows about BLOCK_TOKENS tokens of each part, and one sorted partition
    streams its tokens past the part that it holds.  Every part is copied once
    per block, so copies of vectors grow as the text, whatever the vocabulary; a
    row is copied once per part, each as its tokens of that part.

    ``chars`` gives the characters of all texts, or a bound of them; it sets the
    number of blocks and no result.  Without it the tokens are written once to be
    counted.
    """
    size = sum(widths)
    n = bound_rows if bound_rows is not None else vocabulary.count()
    parts = max(1, math.ceil(n * (8 * size + 64) / PART_BYTES))
    texts = [c for c in ("words", "bow") if c in rows.columns]
    if chars is None:
        rows = materialize(rows.select(*keep, *texts), "doc-tokens")
        occurrences = rows.agg(F.sum(sum(F.size(c) for c in texts))).first()[0] or 0
    else:
        occurrences = len(texts) * chars() / TOKEN_CHARS
    lines = rows.select(F.struct(*keep).alias("keep"), *texts)
    blocks = max(1, math.ceil(occurrences / (BLOCK_TOKENS * parts)))

    def part(token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(parts))

    nothing = F.lit(None).cast(lines.schema["keep"].dataType)
    block, p = F.pmod(F.xxhash64("keep"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    # a token has no space, so a text of them is its tokens
    def text(c: str) -> Column:
        mine = F.col(c) if parts == 1 else F.filter(c, lambda t: part(t) == F.col("_p"))
        return F.array_join(mine, " ").alias(c)

    asked = lines.select("*", p.alias("_p")).select(
        (block * parts + F.col("_p")).cast("int").alias("cell"), F.lit(1).alias("kind"), "keep", *[text(c) for c in texts],
        F.lit(None).cast("array<double>").alias("x"))
    given = vocabulary.where("token <> ''").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), "token", "x").select(
        (F.col("_b") * parts + part(F.col("token"))).cast("int").alias("cell"), F.lit(0).alias("kind"),
        nothing.alias("keep"), F.col("token").alias("words"), *[F.lit("").alias(c) for c in texts[1:]], "x")
    laid = given.unionByName(asked).repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "kind")
    out = StructType([StructField("keep", lines.schema["keep"].dataType), StructField("x", ArrayType(DoubleType()))])
    return laid.mapInArrow(_streamed(widths, len(texts) > 1), out).select("keep.*", "x")


def _streamed(widths: list[int], counted: bool):
    """Rows (cell, kind, keep, words[, bow], x) sorted by cell and kind, tokens
    with their vectors (kind 0) before the rows that ask for them."""
    size = sum(widths)

    def codes(column: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, token number) of the tokens found."""
        lists = pc.split_pattern(column, " ")
        row = pc.list_parent_indices(lists).to_numpy()
        at = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=tokens), -1).to_numpy()
        found = at >= 0
        return row[found], at[found].astype(np.int64)

    def add(out: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray | None, x: np.ndarray) -> None:
        """out[row] += weight * x[at], rows ascending."""
        for lo in range(0, len(row), _SLICE_TOKENS):
            r = row[lo:lo + _SLICE_TOKENS]
            y = x[at[lo:lo + _SLICE_TOKENS]]
            if weight is not None:
                y *= weight[lo:lo + _SLICE_TOKENS, None]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            out[r[first]] += np.add.reduceat(y, first, axis=0)

    def sums(batch: pa.RecordBatch, tokens: pa.Array, x: np.ndarray) -> np.ndarray:
        out = np.zeros((batch.num_rows, size))
        row, at = codes(batch.column(3), tokens)
        if not counted:
            add(out, row, at, None, x)
            return out
        n, (a, b, _) = max(1, len(tokens)), widths
        word, cnt = np.unique(row * n + at, return_counts=True)
        row, at = codes(batch.column(4), tokens)
        bow, tf = np.unique(row * n + at, return_counts=True)
        both, i, j = np.intersect1d(word, bow, assume_unique=True, return_indices=True)
        add(out[:, :a], word // n, word % n, cnt.astype(float), x[:, :a])
        add(out[:, a:a + b], both // n, both % n, (cnt[i] * tf[j]).astype(float), x[:, a:a + b])
        add(out[:, a + b:], bow // n, bow % n, tf.astype(float) ** 2, x[:, a + b:])
        return out

    def table(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        if not held:
            return pa.array([], pa.string()), np.zeros((0, size))
        names = pa.concat_arrays([t.cast(pa.string()) for t, _ in held]).dictionary_encode()
        x = np.concatenate([v for _, v in held])
        if len(names.dictionary) == len(x):
            return names.dictionary, x
        # a token that is listed twice counts twice, as in a join
        once = np.zeros((len(names.dictionary), size))
        np.add.at(once, names.indices.to_numpy(), x)
        return names.dictionary, once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [*np.flatnonzero(np.diff(at, prepend=-1)), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if at[lo] // 2 != cell:
                    cell, held, ready = at[lo] // 2, [], None
                if at[lo] % 2 == 0:
                    piece = batch.slice(lo, hi - lo)
                    held.append((piece.column(3), piece.column(piece.num_columns - 1).flatten().to_numpy().reshape(-1, size)))
                    continue
                if ready is None:
                    ready, held = table(held), []
                for k in range(lo, hi, _SLICE_ROWS):
                    piece = batch.slice(k, min(_SLICE_ROWS, hi - k))
                    out = sums(piece, *ready)
                    x = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * size, out.ravel())
                    yield pa.RecordBatch.from_arrays([piece.column(2), x], ["keep", "x"])

    return run


def similarity_columns(vectors: DataFrame, anchors: Sequence[Sequence[float]], out: str = "cos") -> DataFrame:
    """(token, cos array<double>): cosine of each token to each anchor vector.

    Anchors (at most a handful of identity words) are literals, so this is
    a projection over the vocabulary, not a join.
    """
    units = [V.literal(_unit(a)) for a in anchors]
    # the unit vector is a column of its own, referenced once per anchor
    u = vectors.select("token", V.unit("vec").alias("_u"))
    return u.select("token", F.array(*[V.dot("_u", a) for a in units]).alias(out))


def _unit(a: Sequence[float]) -> list[float]:
    n = sum(x * x for x in a) ** 0.5
    return [x / n for x in a] if n > 0 else list(a)


def identity_proximity(
    docs: DataFrame,
    vectors: DataFrame,
    anchors: Sequence[Sequence[float]],
    positions: dict[str, int],
    id_col: str = "id",
    text_col: str = "comment_text",
    bound_rows: int | None = None,
    self_similarity: float = 1.0 - 1e-9,
) -> DataFrame:
    """Per (row, subgroup that the row is in): comment length, number of
    known tokens whose cosine to the subgroup's identity word is below 1 (the
    word itself, up to rounding, is skipped), and their mean cosine.
    ``positions`` maps a group column to its 0-based anchor.  Unknown tokens are
    skipped.

    A row is tokenised once, whatever the number of its groups: the counts and
    sums for all anchors are side by side in its aggregate, and its groups pick
    theirs."""
    cos = similarity_columns(vectors, anchors)
    member = F.array(*[F.struct(F.lit(g).alias("subgroup"), F.lit(k + 1).alias("at"), nan_to_null(g).alias("g"))
                       for g, k in positions.items()])
    rows = docs.select(
        id_col, F.length(text_col).cast("bigint").alias("comment_length"),
        F.transform(F.filter(member, lambda m: m["g"] > THRESHOLD), lambda m: F.struct(m["subgroup"], m["at"])).alias("_in"),
        F.col(text_col).alias("_text")).where(F.size("_in") > 0)
    occ = rows.select(id_col, F.explode(word_tokens("_text")).alias("token"))
    j = lookup_join(occ, cos, "token", bound_rows=bound_rows, dim=len(anchors))
    used = sorted(set(positions.values()))
    near = {k: F.when(F.col("cos")[k] < self_similarity, F.col("cos")[k]) for k in used}
    per = j.groupBy(id_col).agg(*[F.count(x).alias(f"_n{k}") for k, x in near.items()],
                                *[F.sum(x).alias(f"_s{k}") for k, x in near.items()])
    slots = range(max(used) + 1)
    counts = F.array(*[F.col(f"_n{k}") if k in near else F.lit(0).cast("bigint") for k in slots])
    sums = F.array(*[F.col(f"_s{k}") if k in near else F.lit(None).cast("double") for k in slots])
    each = rows.select(id_col, "comment_length", "_in").join(
        per.select(id_col, counts.alias("_n"), sums.alias("_s")), id_col, "left").select(
        id_col, "comment_length", "_n", "_s", F.explode("_in").alias("m"))
    n = F.coalesce(F.element_at("_n", F.col("m.at")), F.lit(0))
    return each.select(id_col, "m.subgroup", "comment_length", n.cast("bigint").alias("number_embeddings"),
                       F.try_divide(F.element_at("_s", F.col("m.at")), n.cast("double")).alias("mean_similarity"))


def exclude_words(tokens: DataFrame, stop: DataFrame, bound_rows: int | None = None) -> DataFrame:
    """Tokens not in a (small) stop list."""
    return lookup_join(tokens, stop.select("token"), "token", "left_anti", bound_rows)
