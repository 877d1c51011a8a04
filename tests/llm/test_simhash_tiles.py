import random
import re

import numpy as np
import pytest
import xxhash

from equitext.llm import components, simhash_tiles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius):
    fps = [fingerprint(t) for _, t in rows]
    n, comp = len(rows), list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], fps[i], min(ids, default=None)))
    return out


def _rows(seed, n):
    r = random.Random(seed)
    base = [" ".join(r.choice("alpha beta gamma delta EpsÉ zeta".split()) for _ in range(r.choice([1, 2, 3, 60, 400])))
            for _ in range(n // 3)]
    texts = [None, "", " \t\n", "One", "one", "a\x0bb c", "a b\x0cc", "long " * 3000]
    while len(texts) < n:
        words = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(["x", "y", "alpha"])
        texts.append(" ".join(words))
    ids = list(range(n))
    r.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[5], (None, texts[9]), (None, "nobody else wrote this line")]


@pytest.mark.parametrize("radius, chunk", [(2, 512), (2, 3), (6, 4)])
def test_components_match_brute_force(spark, monkeypatch, radius, chunk):
    monkeypatch.setattr(simhash_tiles, "CHUNK", chunk)
    rows = _rows(radius + chunk, 120)
    df = spark.createDataFrame([(a, b, 1, "f") for a, b in rows], "doc_id long, text string, fp int, root string")
    got = simhash_tiles.near_duplicates(df, 3, radius).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r["id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=key) == sorted(brute(rows, radius), key=key)


def test_chunked_links_match_all_pairs(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(b) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) for b in base for _ in range(12)}
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    found = components.connected(simhash_tiles.links(df, 2, chunk=5)).collect()
    groups = {}
    for x in found:
        groups.setdefault(x["root"], set()).add(x["node"] % 2**64)
    want, left = [], set(fps)
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            a = todo.pop()
            comp.add(a)
            near = {b for b in left if (a ^ b).bit_count() <= 2}
            left -= near
            todo += near
        if len(comp) > 1:
            want.append(comp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200), (None, 3), (300, 301), (300, 301)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 300, 301: 300}


def test_drop_near_copies_and_empty_table(spark):
    rows = _rows(9, 60)
    df = spark.createDataFrame([(a, b, a) for a, b in rows], "doc_id long, text string, component_id long")
    out = simhash_tiles.drop_near_copies(df)
    assert out.columns == df.columns
    want = sorted({c for i, _, c in brute(rows, 2) if i is not None})
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == want
    assert out.filter("doc_id IS NULL").count() == 2
    empty = df.limit(0)
    assert simhash_tiles.near_duplicates(empty).count() == 0 and simhash_tiles.drop_near_copies(empty).count() == 0
