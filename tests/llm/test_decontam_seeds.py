import itertools
import random

import pytest

from equitext.llm import decontam_seeds as D


def test_masks_find_two_substitutions_in_thirteen_words():
    for gone in itertools.combinations(range(13), 2):
        assert any(
            all(o + p not in gone for p, c in enumerate(m) if c == "1")
            for m in D.MASKS for o in range(13 - len(m) + 1))


def _missed(masks, similarity, longest=60):
    """Lengths at which some pattern with the wanted share of equal words,
    the first and last among them, fits no mask.  Kept per state (the last
    words, equal or not): the best sum of 1 - s for equal and -s for others."""
    up, down = 1000 - round(similarity * 1000), round(similarity * 1000)
    span = max(map(len, masks))
    kept = [int(m, 2) for m in masks]
    best, missed = {1: up} if 1 not in kept else {}, []
    for n in range(2, longest + 1):
        new = {}
        for state, total in best.items():
            for bit, gain in ((0, -down), (1, up)):
                full = state << 1 | bit
                if not any(full & m == m for m in kept):
                    key = full & ((1 << span - 1) - 1)
                    new[key] = max(new.get(key, total + gain), total + gain)
        best = new
        if n >= D.MIN_WORDS and any(k & 1 and total >= 0 for k, total in best.items()):
            missed.append(n)
    return missed


@pytest.mark.parametrize("similarity", [0.8, 0.9, 1.0, 0.79, 0.7, 0.6, 0.5])
def test_masks_miss_no_pattern_at_any_length(similarity):
    assert _missed(D.masks_for(similarity), similarity) == []


def test_three_substitutions_in_fifteen_words():
    item = [f"w{i}" for i in range(15)]
    for gone in itertools.combinations(range(1, 14), 3):
        doc = " ".join("other" if i in gone else w for i, w in enumerate(item))
        assert D.Seeds([(1, " ".join(item))], 0.8).overlaps([doc]) == [(0, 0, 0, 0, 15, 12)], gone


def brute(doc, item):
    """Longest aligned stretch of 13 words or more with 0.8 equal words."""
    a, b = D.words(doc), D.words(item)
    if len(b) < 5:
        return None
    best = None
    if len(b) < D.MIN_WORDS:
        return next(((s, 0, len(b), len(b)) for s in range(len(a) - len(b) + 1) if a[s:s + len(b)] == b), None)
    for shift in range(-len(b), len(a)):
        same = {j: a[j + shift] == b[j] for j in range(len(b)) if 0 <= j + shift < len(a)}
        ends = [j for j in same if same[j]]
        for i, j in itertools.combinations(ends, 2):
            n, e = j - i + 1, sum(same[k] for k in range(i, j + 1))
            if n >= 13 and e * 1000 >= n * 800 and (best is None or (n, e, -(i + shift)) > (best[2], best[3], -best[0])):
                best = (i + shift, i, n, e)
    return best


def test_two_stretches_on_one_alignment():
    r = random.Random(5)
    patterns = ["1" * 12 + "0" * 10 + "1111101011111", "1" * 12 + "0" * 3 + "1" * 12, "0" * 20]
    patterns += ["".join(r.choice(["1" * r.randint(1, 13), "0" * r.randint(1, 9)]) for _ in range(9)) for _ in range(200)]
    for p in patterns:
        item = [f"w{i}" for i in range(max(len(p), 13))]
        doc = [w if i < len(p) and p[i] == "1" else "other" for i, w in enumerate(item)]
        got = D.Seeds([(1, " ".join(item))], 0.8).overlaps([" ".join(doc)])
        want = brute(" ".join(doc), " ".join(item))
        assert got == ([(0, 0, *want)] if want else []), p
    assert brute(" ".join(f"w{i}" if c == "1" else "x" for i, c in enumerate(patterns[0])),
                 " ".join(f"w{i}" for i in range(len(patterns[0])))) == (22, 22, 13, 11)


def _tables(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [text(n) for n in (3, 5, 9, 12, 13, 14, 25, 40)] + [None, "", "Même Mot, ÉTÉ! " * 6]
    docs = [None, "", "w1", text(300)]
    for _ in range(50):
        words = (r.choice(items) or "").upper().split()[r.randint(0, 3):]
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            if words:
                words[r.randrange(len(words))] = "other"
        docs.append(f"{text(r.randint(0, 30))}, {' '.join(words)}. {text(r.randint(0, 30))}")
    rows = list(enumerate(docs))
    return rows + [rows[7], (None, docs[8])], list(enumerate(items))


@pytest.mark.parametrize("seed, block", [(1, D.BLOCK_CHARS), (2, 150)])
def test_overlaps_match_brute_force(spark, seed, block):
    docs, items = _tables(seed)
    d = spark.createDataFrame([(a, b, 0, "x") for a, b in docs], "doc_id long, text string, item_id int, similarity string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r["id"], *tuple(r)[1:6]) for r in D.find_overlaps(d, b, block_chars=block).collect()), key=str)
    want = sorted(((i, k, *v) for i, t in docs for k, x in items if x and (v := brute(t, x))), key=str)
    assert got == want
    flagged = {(i, t) for i, t in docs if any(x and brute(t, x) for _, x in items)}
    left = D.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(
        ((i, t) for i, t in docs if (i, t) not in flagged), key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.find_overlaps(d, b).count() == 0 and D.drop_contaminated(d, b).count() == 1
    assert D.find_overlaps(d.limit(0), spark.createDataFrame([(1, "q " * 20)], "item_id long, text string")).count() == 0


def test_plans_hold_few_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    want = key(D.find_overlaps(docs, bench).collect()), key(D.drop_contaminated(docs, bench).collect())
    assert 0 < len(want[1]) <= docs.count()
    monkeypatch.setattr(D, "AT_ONCE", 2)
    size = bench.selectExpr("sum(char_length(text))").first()[0] // 6
    found, kept = D.find_overlaps(docs, bench, block_chars=size), D.drop_contaminated(docs, bench, block_chars=size)
    assert (key(found.collect()), key(kept.collect())) == want
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (found, kept)]
    assert plans[0].count("MapInArrow") < 2 and plans[1].count("ArrowEvalPython") < 2
