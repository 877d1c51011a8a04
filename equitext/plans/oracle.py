"""DuckDB twins of the derived views, used by the SQL oracle.

``prelude(*names)`` returns a ``WITH`` clause holding the named views and the
views they depend on.  Only the tables the driver registers are read
(documents, labels, embeddings, benchmark, conversations).
"""

from __future__ import annotations

from equitext.constants import GROUPS
from equitext.sources.fixtures import GROUP_MULTIPLIERS, PRED_EXPR, TARGET_EXPR


def _group_sql(i: int) -> str:
    m = GROUP_MULTIPLIERS[i]
    return (
        f"CASE WHEN (doc_id + {i + 1}) % 5 = 0 THEN CAST(NULL AS DOUBLE) "
        f"ELSE CAST((doc_id * {m} + {13 * (i + 1)}) % 100 AS DOUBLE) / 180 END AS {GROUPS[i]}"
    )


_GROUP_COLS = ",\n  ".join(_group_sql(i) for i in range(len(GROUPS)))

VIEWS: dict[str, tuple[list[str], str]] = {
    "comments": (
        [],
        f"""SELECT d.doc_id AS id, d.text AS comment_text,
  {TARGET_EXPR.replace('toxic', 'l.toxic').replace('doc_id', 'd.doc_id')} AS target,
  {_GROUP_COLS.replace('doc_id', 'd.doc_id')},
  {PRED_EXPR.replace('toxic', 'l.toxic').replace('doc_id', 'd.doc_id')} AS pred
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "labelled": (
        ["comments"],
        """SELECT * REPLACE (CASE WHEN isnan(pred) THEN NULL ELSE pred END AS pred),
  coalesce(target > 0.5, false) AS toxic FROM comments""",
    ),
    "tok": (
        ["comments"],
        r"""SELECT id, t AS token FROM (SELECT id, unnest(regexp_extract_all(
  lower(coalesce(comment_text, '')), '[\p{L}\p{Nl}\p{No}_]+')) AS t FROM comments)
WHERE length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_')""",
    ),
    "vocab_rank": (
        ["tok"],
        """SELECT token, df, CAST(row_number() OVER (ORDER BY df DESC, token) AS BIGINT) AS r
FROM (SELECT token, count(DISTINCT id) AS df FROM tok GROUP BY token)""",
    ),
    "word_vectors": (
        ["vocab_rank"],
        """SELECT v.token, v.r, CAST(e.embedding AS DOUBLE[]) AS vec
FROM vocab_rank v JOIN embeddings e ON e.vec_id = v.r - 1""",
    ),
    "identity_words": (
        ["word_vectors"],
        "SELECT token, r - 11 AS k, vec FROM word_vectors WHERE r BETWEEN 11 AND 20",
    ),
    "pleasant_words": (
        ["word_vectors"],
        "SELECT token, r - 101 AS k, vec FROM word_vectors WHERE r BETWEEN 101 AND 109",
    ),
    "unpleasant_words": (
        ["word_vectors"],
        "SELECT token, r - 111 AS k, vec FROM word_vectors WHERE r BETWEEN 111 AND 121",
    ),
    "model": (
        [],
        """SELECT list_transform(range(64), lambda p: CAST((p * 37 + 11) % 41 - 20 AS DOUBLE) / 5) AS w,
  -0.1 AS b""",
    ),
    "token_scores": (
        ["word_vectors", "model"],
        """SELECT token, r, list_sum(list_transform(range(1, 65), lambda i: vec[i] * m.w[i])) AS s
FROM word_vectors, model m""",
    ),
    "weights": (
        ["word_vectors"],
        """SELECT token,
  CASE WHEN r % 2 = 0 THEN CAST(r % 7 AS DOUBLE) / 10 END AS add_pleasent,
  CASE WHEN r % 2 = 0 THEN CAST(r % 5 AS DOUBLE) / 10 END AS sub_unpleasent,
  CASE WHEN r % 2 = 1 THEN CAST(r % 7 AS DOUBLE) / 10 END AS sub_pleasent,
  CASE WHEN r % 2 = 1 THEN CAST(r % 5 AS DOUBLE) / 10 END AS add_unpleasent
FROM word_vectors WHERE r BETWEEN 21 AND 60""",
    ),
}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def prelude(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause for the named views (dependencies first) plus extras."""
    parts = [f"{n} AS (\n{VIEWS[n][1]}\n)" for n in _order(names)]
    parts += [f"{n} AS (\n{body}\n)" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"
