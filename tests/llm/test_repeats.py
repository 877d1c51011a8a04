import random

import pytest

from equitext.llm import repeats, suffix_lpf, suffix_tree_words


def _rows(seed: int, n: int) -> list[tuple[int | None, str | None]]:
    """Texts with shared passages, copies, near copies, periods and blanks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.randint(4, 30))) for _ in range(6)]
    texts: list[str | None] = [None, "", "  ", "a", "for " * 60, "x y " * 40 + "z", passages[0]]
    while len(texts) < n:
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(" ".join(word() for _ in range(r.randint(0, 15))))
            parts.append(r.choice(passages))
        texts.append(r.choice([" ", "\n"]).join(parts))
        if r.random() < 0.3:
            texts.append(texts[-1])
        if r.random() < 0.3:
            texts.append(texts[-1][: len(texts[-1]) // 2] + " changed " + texts[-1][len(texts[-1]) // 2:])
    ids: list[int | None] = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [(None, passages[1] + " " + passages[2]), (None, passages[1]), rows[-1]]


def brute(rows, window, units, first):
    """Removed runs of each row, from every window of every row."""
    seqs = [units(t or "") for _, t in rows]
    where: dict = {}
    for i, s in enumerate(seqs):
        for j in range(len(s) - window + 1):
            where.setdefault(tuple(s[j:j + window]), []).append(i)
    out = []
    for i, s in enumerate(seqs):
        gone = [False] * len(s)
        for j in range(len(s) - window + 1):
            others = where[tuple(s[j:j + window])]
            if first:
                own = rows[i][0]
                hit = own is not None and any(rows[k][0] is not None and rows[k][0] < own for k in others)
            else:
                hit = len(others) > 1
            if hit:
                gone[j:j + window] = [True] * window
        out.append(gone)
    return seqs, out


def _runs(gone):
    return sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("group", [3, 1000])
def test_bytes_match_brute_force(spark, first, group):
    rows = _rows(5 + first, 60)
    df = spark.createDataFrame([(a, b, "row", 1) for a, b in rows], "doc_id long, text string, row string, z int")
    got = suffix_lpf.remove_repeats(df, min_bytes=24, keep_first=first, gram=7, group=group).collect()
    seqs, gone = brute(rows, 24, lambda t: t.encode(), first)
    want = sorted((i if i is not None else -1, len(s), _runs(g), bytes(b for b, x in zip(s, g) if not x))
                  for (i, _), s, g in zip(rows, seqs, gone))
    assert sorted((r["id"] if r["id"] is not None else -1, r["n_bytes"], len(r["spans"]), bytes(r["kept"]))
                  for r in got) == want


@pytest.mark.parametrize("group", [2, 1000])
def test_words_match_brute_force(spark, group):
    rows = _rows(11, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree_words.remove_repeats(df, min_words=8, gram=3, group=group).collect()
    seqs, gone = brute(rows, 8, lambda t: t.encode().split(), True)
    want = sorted((i if i is not None else -1, len(s), b" ".join(b for b, x in zip(s, g) if not x).decode())
                  for (i, _), s, g in zip(rows, seqs, gone))
    assert sorted((r["id"] if r["id"] is not None else -1, r["n_words"], r["kept"]) for r in got) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_lpf.remove_repeats(df).count() == 0
    assert suffix_tree_words.remove_repeats(df).count() == 0


def test_window_min():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 50, 101).astype(np.uint64)
    for w in (1, 2, 7, 101):
        assert repeats.window_min(x, w).tolist() == [x[i:i + w].min() for i in range(len(x) - w + 1)]


def _common(a, b, most):
    n = 0
    while n < most and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("kind, window", [("bytes", 24), ("bytes", 30), ("words", 7), ("words", 8)])
def test_suffix_order_and_common_prefixes(kind, window):
    import numpy as np

    r = random.Random(window)
    base = [r.randint(97, 99) for _ in range(40)]
    data = [base[i:] + base[:r.randint(5, 40)] for i in (0, 3, 0, 8)] + [[97] * 60]
    if kind == "words":
        data = [[x * 10**15 for x in d] for d in data]
    starts = [len(d) - window + 1 for d in data]
    s = repeats.suffixes([np.array(d, dtype=np.uint64) for d in data], starts, window)
    cut = [d[i:i + window] for d, n in zip(data, starts) for i in range(n)]
    want = sorted(range(len(cut)), key=lambda i: (cut[i], i))
    assert s.order.tolist() == want
    for k in range(1, len(want)):
        n = _common(cut[want[k - 1]], cut[want[k]], window)
        assert s.lcp[k] == (n if n == window else n // s.unit * s.unit)


def test_smaller_values_and_factors_against_all_pairs():
    import numpy as np

    r = np.random.default_rng(6)
    for n in (1, 2, 9, 60, 61):
        for values in (r.permutation(n), r.integers(0, 4, n), np.arange(n)[::-1], np.arange(n)):
            lcp = np.append(0, r.integers(0, 6, n - 1))
            index, least = repeats.previous_smaller(values, lcp)
            behind, after = repeats.next_smaller(values, lcp)
            length, source, other = suffix_lpf.factors(values, lcp)
            for i in range(n):
                back = [j for j in range(i) if values[j] < values[i]]
                ahead = [j for j in range(i + 1, n) if values[j] < values[i]]
                assert index[i] == (back[-1] if back else -1) and behind[i] == (ahead[0] if ahead else -1)
                assert least[i] == (lcp[back[-1] + 1:i + 1].min() if back else 0)
                assert after[i] == (lcp[i + 1:ahead[0] + 1].min() if ahead else 0)
                # the longest factor over every smaller place, not only the nearest
                best = max([lcp[j + 1:i + 1].min() for j in back] + [lcp[i + 1:j + 1].min() for j in ahead], default=0)
                assert length[i] == best
                if best:
                    assert values[source[i]] < values[i]
                    a, b = sorted((source[i], i))
                    assert lcp[a + 1:b + 1].min() == best
                assert (other[i] >= 0) <= (best > 0)


def test_internal_nodes_are_the_shared_prefixes():
    import numpy as np

    r = random.Random(3)
    words = sorted("".join(r.choice("ab") for _ in range(6)) for _ in range(40))
    lcp = np.array([0] + [_common(a, b, 6) for a, b in zip(words, words[1:])])
    first, last, depth = suffix_tree_words.internal_nodes(lcp)
    got = {(words[a][:d], a, b) for a, b, d in zip(first, last, depth)}
    want = set()
    for d in range(1, 7):
        for p in {w[:d] for w in words}:
            below = [i for i, w in enumerate(words) if w.startswith(p)]
            # a node branches, or ends copies of one word
            if len(below) > 1 and (d == 6 or len({words[i][d] for i in below}) > 1):
                want.add((p, below[0], below[-1]))
    assert got == want
    ids = np.array([r.randint(0, 9) for _ in words])
    assert suffix_tree_words.smallest_below(ids, first, last).tolist() == [ids[a:b + 1].min() for a, b in zip(first, last)]
