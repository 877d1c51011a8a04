"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of every path is content-addressed: its *blob* is the
SHA-256 of its text.  A ledger (a Parquet table in shared storage) holds one
row per blob and scan: the rule versions that were run on it and the spans
that they found.  A scan takes the pairs of blob and rule version that the
ledger lacks, runs only those rules, once per distinct blob, appends the rows,
and joins the findings of the current rule versions back to all paths.  A new
version of one rule makes that rule alone run again; a text seen under another
path or in an older version is never scanned again.

A ledger row is whole in itself, so rows that a broken or repeated append
leaves behind are valid and count once.  The ledger holds offsets, never the
secrets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equitext.llm.util import saved
from equitext.session import ensure_checkpoint_dir, read_if_exists

#: unseen blobs are broadcast up to this size (32 bytes and rule names each);
#: beyond it they join by shuffle
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """``pattern``'s matches, leftmost and non-overlapping, in a regular
    expression of ASCII characters; a match stays if its ``group`` has
    ``least`` characters.  A changed rule gets a new ``version``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: fixed values: the base rules first, in their listed order, then those added
BASE = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key")
         + ")[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    # a run of 24 or more is the whole run either way; this form skips letters
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED

_SPANS = "array<struct<start:bigint,end:bigint,rule:string>>"


def _hits(rule: Rule, text: Column, todo: Column) -> Column:
    """Per match (rule, i, gap, len, ok): the text before it since the last
    match, its own length and whether it stays.  Splitting at the pattern gives
    the gaps, so one pass over the matches places them all, however many."""
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("group"))
    # the last gap has no match behind it
    matches = F.transform(F.filter(found, lambda z: z["all"].isNotNull()), lambda z, i: F.struct(
        F.lit(rule.key).alias("rule"), i.alias("i"), F.char_length(z["gap"]).cast("bigint").alias("gap"),
        F.char_length(z["all"]).cast("bigint").alias("len"),
        (F.char_length(z["group"]) >= rule.least).alias("ok")))
    wanted = F.array_contains(todo, rule.key) & text.rlike(rule.pattern)
    return F.when(wanted, matches).otherwise(
        F.array().cast("array<struct<rule:string,i:int,gap:bigint,len:bigint,ok:boolean>>"))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    return read_if_exists(spark, path)


def _addresses(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return versions.select(F.col(path_col).alias("path"), text.alias("text")).select(
        "path", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("blob"), "text")


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo) for each distinct blob that lacks a rule version: the
    names of the rule versions still to be run on it."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    distinct = blobs.select("blob").distinct()
    if ledger is None:
        return distinct.withColumn("todo", keys)
    done = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
    return distinct.join(done, "blob", "left").select(
        "blob", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")
    ).filter(F.size("todo") > 0)


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, spans) of (blob, todo, text), one row per blob."""
    hits = texts.select("blob", "todo", F.explode_outer(
        F.concat(*[_hits(r, F.col("text"), F.col("todo")) for r in rules])).alias("hit")).select("blob", "todo", "hit.*")
    # rows of a blob are together already: neither step below shuffles again
    so_far = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far))
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "end", "rule")
    return placed.groupBy("blob", F.col("todo").alias("rules")).agg(
        F.collect_list(F.when(F.col("ok"), span)).cast(_SPANS).alias("spans"))


def update(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``ledger`` lacks, appends it, and returns
    (path, blob), one row per version."""
    spark = versions.sparkSession
    addressed = _addresses(versions, path_col, text_col)
    addresses = saved(addressed.select("path", "blob"), "ledger-addresses")
    before = _ledger(spark, ledger)
    todo = unseen(addresses, before, rules)
    texts = addressed.select("blob", "text")
    if before is not None:
        todo = saved(todo, "ledger-unseen")
        if todo.count() * (32 + sum(len(r.key) + 8 for r in rules)) <= BROADCAST_BYTES:
            # known texts are left out where they lie
            texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    # one text per blob: copies are combined before the shuffle
    texts = texts.groupBy("blob").agg(F.first("text").alias("text"))
    if before is None:
        texts = texts.withColumn("todo", F.array(*[F.lit(r.key) for r in rules]))
    else:
        texts = texts.join(todo, "blob")
    _scanned(texts, rules).write.mode("append").parquet(ledger)
    return addresses


def scan(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans), one row per row of ``versions``.

    spans: (start, end, rule) in code points, end exclusive, by start and then
    in the order of ``rules``; ``rule`` is kind@version.  A NULL text counts as
    empty; a NULL path is kept; repeated rows give repeated rows; an empty
    table gives an empty result (and an empty append).  Other columns are not
    read.  Texts of any length are scanned whole, in time linear in their
    length and n log n in their matches.
    """
    addresses = update(versions, ledger, path_col, text_col, rules)
    now = _ledger(versions.sparkSession, ledger)
    keys = [r.key for r in rules]
    order = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)])
    ranked = F.transform(F.filter("spans", lambda s: s["rule"].isin(keys)), lambda s: F.struct(
        s["start"].alias("start"), order[s["rule"]].alias("rank"), s["end"].alias("end"), s["rule"].alias("rule")))
    found = (
        now.select("blob", ranked.alias("spans")).filter(F.size("spans") > 0)
        # rows of several scans of a blob; a repeated append counts once
        .groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("ranked"))
        .select(F.col("blob").alias("of"), F.transform(
            "ranked", lambda s: F.struct(s["start"], s["end"], s["rule"])).cast(_SPANS).alias("spans"))
    )
    # few blobs have findings; a blob under very many paths is one row there,
    # and adaptive execution splits its paths
    return addresses.join(found, F.col("blob") == F.col("of"), "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def findings(scanned: DataFrame) -> DataFrame:
    """(path, blob, kind, rule_version, start, end): one row per finding and
    path, from the rows of ``scan``."""
    one = scanned.select("path", "blob", F.explode("spans").alias("s"))
    return one.select("path", "blob", F.substring_index("s.rule", "@", 1).alias("kind"),
                      F.substring_index("s.rule", "@", -1).cast("int").alias("rule_version"), "s.start", "s.end")


def kind_of(span: Column) -> Column:
    return F.substring_index(span["rule"], "@", 1)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_of(s), s["start"], s["end"])), ",")


def fresh_ledger(spark: SparkSession) -> str:
    """A path below the shared checkpoint folder where no ledger is yet."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
