import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from equitext.llm import exact_blocks

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _rows():
    r = random.Random(3)
    texts = [None, "", "", "A", "a", "É", "é", "ÀB", "Àb", "x" * 50, "X" * 50, "x" * 49, "ab" * 40, "ab" * 39 + "ba", "y" * 5000]
    texts += ["".join(r.choice("aAbB") for _ in range(r.randint(0, 3))) for _ in range(40)]
    texts += ["tail " * 9 + c for c in "aabbA"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows + [rows[0], rows[1], (None, "A"), (None, "only here"), (None, "only here")]


def brute(rows):
    norm = [(i, (t or "").translate(LOWER)) for i, t in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t and j is not None]
        out.append((i, max(ids, default=None), sum(u == t for _, u in norm), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1, 7, 4096])
@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda b: F.pmod(F.xxhash64(b), F.lit(3)).cast("bigint")])
def test_groups_match_brute_force(spark, block, hash_of):
    rows = _rows() if block > 1 else [r for r in _rows() if len(r[1] or "") < 200]
    df = spark.createDataFrame([(i, t, "row", 5) for i, t in rows], "doc_id long, text string, row string, name int")
    got = exact_blocks.exact_groups(df, block_bytes=block, hash_of=hash_of).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["sha256"]) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = [(r["id"], r["sha256"]) for r in got if r["kept"]]
    assert len(kept) == len({r["sha256"] for r in got}) == len({s for _, s in kept})
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_drop_copies_keeps_columns_and_one_row_each(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, t, i, "z") for i, t in rows], "doc_id long, text string, id long, sha256 string")
    out = exact_blocks.drop_copies(df)
    assert out.columns == df.columns
    left = [((r["text"] or "").translate(LOWER), r["doc_id"]) for r in out.collect()]
    want = {(t, k) for (i, t), (_, k, _, _) in zip([(i, (t or "").translate(LOWER)) for i, t in rows], brute(rows))}
    assert len(left) == len(set(left)) and set(left) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_blocks.exact_groups(df).count() == 0 and exact_blocks.drop_copies(df).count() == 0
