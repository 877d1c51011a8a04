import itertools
import random
import re

import pytest

from equitext.llm import trie_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_masks(rows):
    out = []
    for i, text, part in rows:
        t = text or ""
        words = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        mask = ((len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words))
                + 4 * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t)) + 16 * copy)
        out.append((i, part or "", mask))
    return out


def brute_audit(rows, labels):
    """Every order walked through document by document."""
    flagged = brute_masks(rows)
    out = []
    for part in {p for _, p, _ in flagged}:
        docs = [(m, labels.get(i, (0, 0))) for i, p, m in flagged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = docs, []
            for step, letter in enumerate(order, 1):
                fails = lambda d, b=1 << "ABCDE".index(letter): bool(d[0] & b)
                removed = [d for d in left if fails(d)]
                redundant = sum(map(fails, gone))
                left, gone = [d for d in left if not fails(d)], gone + removed
                shapley[letter] += len(removed)
                lines.append([part, order, step, len(left), len(removed), redundant,
                              sum(d[0] == 1 << "ABCDE".index(letter) for d in docs),
                              sum(d[1][0] == 1 for d in removed), sum(d[1][1] == 1 for d in removed)])
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def _rows(n=160):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "A", "$5", "x|y", "LOUD"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([5, 99, 100, 130]))) for _ in range(40)]
    long = "shared start of many texts " * 400
    texts = [None, "", " \x0b", "A" * 50, "\x1c".join("abc"), long, long + "x", long + "y", long[:-1], "same"] + base
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(n)]
    r.shuffle(rows)
    return rows + [rows[0], rows[0], (None, "same", "en"), (None, None, None), (-5, "same", "fr")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("part_bytes, batch", [(trie_audit.PART_BYTES, 10_000), (3_000, 7)])
def test_masks_match_brute_force(spark, part_bytes, batch):
    rows = _rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = trie_audit.flags(_frame(spark, rows).repartition(5), part_bytes=part_bytes).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, out), key=repr) == sorted(brute_masks(rows), key=repr)
    assert key


def test_long_shared_starts_are_split_by_longer_prefixes(spark):
    head = "h" * 100
    rows = [(i, head + chr(97 + i % 26) * 200) for i in range(260)]
    texts = spark.createDataFrame([(bytes(t, "utf8"),) for _, t in rows], "text binary")
    keyed = trie_audit._keyed(texts, 5_000).select("depth", "key").distinct().collect()
    # 16 and 64 bytes hold one prefix; 256 hold 26 of 10 texts each
    assert sorted({r["depth"] for r in keyed}) == [256] and len(keyed) == 26
    # copies of one text end where the text ends
    one = spark.createDataFrame([(b"t" * 300,)] * 200, "text binary")
    assert [r["depth"] for r in trie_audit._keyed(one, 1_000).select("depth").distinct().collect()] == [1024]


def test_audit_matches_every_order_walked(spark):
    rows = [r for r in _rows(90) if r[0] is not None]
    r = random.Random(5)
    labels = {i: (r.choice([0, 1, None]), r.choice([0, 1, None])) for i in {x[0] for x in rows} if r.random() < 0.7}
    lab = spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id long, quality int, toxic int")
    out = trie_audit.audit(trie_audit.flags(_frame(spark, rows)), lab)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == brute_audit(rows, labels)


def test_repeated_labels_empty_tables_and_clashing_columns(spark):
    lab = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, "x", "en", 5, 6, "k", 7)],
                                "doc_id long, text string, lang string, mask int, task int, key string, bundle long")
    row = trie_audit.audit(trie_audit.flags(odd), lab).filter("filter_order = 'ABCDE' AND step = 1").first()
    assert (row["kept"], row["removed"], row["good_lost"], row["toxic_lost"], row["shapley"]) == (0, 1, 1, 1, 120)
    empty = trie_audit.audit(trie_audit.flags(_frame(spark, [])), lab)
    assert empty.count() == 0
    assert trie_audit.audit(trie_audit.flags(odd), lab.limit(0)).count() == 600


def test_trie_against_a_dictionary():
    r = random.Random(11)
    trie, known, nodes = trie_audit.RadixTrie(), {}, []
    for i in range(3000):
        text = bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(0, 9))) * r.choice([1, 1, 40])
        id_ = r.choice([None, r.randint(-50, 50)])
        nodes.append((text, trie.insert(text, id_)))
        known[text] = min((x for x in (known.get(text), id_) if x is not None), default=None)
    assert dict(trie.terminals()) == known
    assert [t for t, _ in trie.terminals()] == sorted(known)
    assert all(node[2] == known[text] for text, node in nodes)
