import hashlib
import random
import re

from equitext.llm import secret_ledger
from equitext.llm.secret_ledger import RULES, Rule

# the contract's patterns as Python regular expressions, checked match by match
PATTERNS = [
    ("assign", re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                          re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ("pem", re.compile("-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"), 0, 1),
    ("github", re.compile("gh[pousr]_[A-Za-z0-9]{36,}"), 0, 1),
]


def brute(text):
    spans = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern, group, least) in enumerate(PATTERNS)
             for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(s, e, f"{kind}@1") for s, _, e, kind in sorted(spans)]


TEXTS = [
    None, "", " ", "no secret here",
    "token=abc", "token=abcdef", "token=token: abcdefgh", "TOKEN = 'abc.def'", "Api_Key:\"x/y+z==\"", "apikey  :  123456",
    "password: secret=tokentoken", "passwdK=abcdef ſecret=abcdef", "secret\t=abcdefgh", "é token=üabcdef token=abcdef",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIA" + "9" * 20 + "z", "AKIAAKIA" + "B" * 12, "AKIA",
    "0123456789abcdef01234567", "0123456789abcdef0123456", "g" + "f" * 50 + "g", "F" * 30,
    "😀" * 5 + " token=" + "a" * 24 + " 😀 " + "0" * 24,
    "-----BEGIN RSA PRIVATE KEY-----\nMII", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a" * 36, "ghp_" + "a" * 35,
    "token=" * 2000 + "abcdef", "token=ab " * 3000, "a" * 24 + "token=" + "b" * 24,
]


def _random_texts(n):
    r = random.Random(7)
    parts = ["token", "=", ":", " ", "'", '"', "AKIA", "ABCD1234" * 3, "abc", "0123456789ab", "é", "API_KEY", "secret", "\n"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_spans_match_brute_force(spark):
    rows = list(enumerate(TEXTS + _random_texts(300)))
    rows += [rows[5], (None, "token=abcdef")]
    out = secret_ledger.scan(_frame(spark, rows), secret_ledger.fresh_ledger(spark)).collect()
    got = sorted((r["path"] if r["path"] is not None else -1, [tuple(s) for s in r["spans"]]) for r in out)
    assert got == sorted((i if i is not None else -1, brute(t)) for i, t in rows)
    by_path = {r["path"]: r["blob"] for r in out}
    assert by_path[5].hex() == hashlib.sha256(b"token=abcdef").hexdigest()


def _entries(spark, ledger):
    return [(bytes(r["blob"]).hex(), tuple(sorted(r["rules"]))) for r in spark.read.parquet(ledger).collect()]


def test_only_unseen_pairs_are_scanned(spark):
    ledger = secret_ledger.fresh_ledger(spark)
    keys = tuple(sorted(r.key for r in RULES))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # three versions of two paths, one text twice: two blobs are scanned
    first = _frame(spark, [(1, "token=abcdef"), (2, "token=abcdef"), (1, "clean")])
    secret_ledger.scan(first, ledger)
    assert sorted(_entries(spark, ledger)) == sorted([(sha("token=abcdef"), keys), (sha("clean"), keys)])
    # an old text under a new path and one new text: one blob more
    second = _frame(spark, [(3, "token=abcdef"), (3, "AKIA" + "Z" * 16)])
    out = secret_ledger.scan(second, ledger).collect()
    assert len(_entries(spark, ledger)) == 3
    assert sorted([tuple(s) for s in r["spans"]] for r in out) == [[(0, 12, "assign@1")], [(0, 20, "access@1")]]
    # a new version of one rule: that rule alone, on the blobs given
    changed = tuple(Rule("access", "AKIA[A-Z0-9]+", 0, 30, version=2) if r.kind == "access" else r for r in RULES)
    out = secret_ledger.scan(second, ledger, rules=changed).collect()
    assert sorted(_entries(spark, ledger))[0][1] is not None
    added = [e for e in _entries(spark, ledger) if e[1] == ("access@2",)]
    assert sorted(b for b, _ in added) == sorted([sha("token=abcdef"), sha("AKIA" + "Z" * 16)])
    assert sorted([tuple(s) for s in r["spans"]] for r in out) == [[], [(0, 12, "assign@1")]]
    # nothing left to scan
    secret_ledger.scan(second, ledger, rules=changed)
    assert len(_entries(spark, ledger)) == 5


def test_repeated_append_counts_once(spark):
    ledger = secret_ledger.fresh_ledger(spark)
    docs = _frame(spark, [(1, "token=abcdef token=ghijkl")])
    secret_ledger.scan(docs, ledger)
    saved = spark.createDataFrame(spark.read.parquet(ledger).collect(), spark.read.parquet(ledger).schema)
    saved.write.mode("append").parquet(ledger)
    spans = secret_ledger.scan(docs, ledger).first()["spans"]
    assert [tuple(s) for s in spans] == [(0, 12, "assign@1"), (13, 25, "assign@1")]


def test_unseen_blobs_join_by_shuffle_beyond_the_bound(spark, monkeypatch):
    ledger = secret_ledger.fresh_ledger(spark)
    secret_ledger.scan(_frame(spark, [(1, "x")]), ledger)
    monkeypatch.setattr(secret_ledger, "BROADCAST_BYTES", 0)
    rows = [(i, f"token=abcdef{i % 7}") for i in range(50)] + [(99, "x")]
    out = secret_ledger.scan(_frame(spark, rows), ledger).collect()
    assert sorted((r["path"], [tuple(s) for s in r["spans"]]) for r in out) == sorted((i, brute(t)) for i, t in rows)
    assert len(_entries(spark, ledger)) == 8


def test_findings_empty_table_and_clashing_columns(spark):
    ledger = secret_ledger.fresh_ledger(spark)
    assert secret_ledger.scan(_frame(spark, []), ledger).count() == 0
    odd = spark.createDataFrame([(1, "token=abcdef", "p", b"b", "s")],
                                "doc_id long, text string, path string, blob binary, spans string")
    found = secret_ledger.findings(secret_ledger.scan(odd, ledger)).collect()
    assert [(r["path"], r["kind"], r["rule_version"], r["start"], r["end"]) for r in found] == [(1, "assign", 1, 0, 12)]


def test_main_path_has_no_python(spark):
    ledger = secret_ledger.fresh_ledger(spark)
    out = secret_ledger.scan(_frame(spark, [(1, "token=abcdef")]), ledger)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_very_long_text_with_many_matches(spark):
    text = "token=abc123 " * 20_000 + "ü" + "f" * 30
    spans = secret_ledger.scan(_frame(spark, [(1, text)]), secret_ledger.fresh_ledger(spark)).first()["spans"]
    assert [tuple(s) for s in spans] == brute(text)
