"""Main-text extraction with a site style tree.

Every page is parsed once into text blocks, each with the style nodes (paths
of containers, tag, classes and id) it lies under.  The pages of a host are
merged into one style tree by aggregation: for each style node the spread of
its own texts (those of no deeper node) over the host's pages, as entropy, says
how alike its pages are there.  The texts are the leaves of the tree.  A leaf
is removed if its node says the same on most pages (importance near 0) and the
text itself is on most of them; a branch thus goes as a whole only if all below
it is unimportant, and a wrapper around menu and content keeps its content.
Roles that HTML itself names (nav, aside, footer, class names of adverts,
comments, ...) are removed by rule and not counted, so a host with a single
page is handled too.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitext.llm.util import id_type, saved

#: branches below this importance are removed, on hosts with enough pages
IMPORTANCE = 0.25
MIN_PAGES = 8
#: share of presentation entropy in a node's importance
PRESENTATION = 0.1
#: bytes of a noise table that may be broadcast; beyond, hosts are joined by shuffle
BROADCAST_BYTES = 16_000_000

#: fixed values of HTML: elements by what they do to text
RAW = frozenset("script style title textarea".split())
SKIPPED = frozenset("noscript template iframe".split())
EMBEDDED = frozenset("svg math select object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
CONTAINER = frozenset(
    "article aside blockquote body center details div dl fieldset figure footer form header main nav ol section table ul".split())
CLOSES_P = BLOCK - {"br", "body", "head", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body nav aside".split())
NOISE_TAGS = frozenset("nav footer aside form button menu dialog head header label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                        "toolbar tablist status".split())
MAIN_TAGS = frozenset(("article", "main"))
#: words that name a part which is no article, and words that go with them
NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo promos promotion recommendations recommended related replies reply respond search share sharing "
    "sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split())
NEUTRAL_WORDS = frozenset(
    "area articles bar block body bottom box button buttons column container content entry footer form global head header icons inner "
    "item items left link links list main menu nav navigation outer page panel post posts primary right row secondary section side "
    "site slot tertiary text title top unit wrap wrapper".split())
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S)
_OPENS = re.compile(r"<(?:main|article)[\s>/]", re.I)
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


def host_of(url: str | None) -> str:
    """Lower-cased host of a URL; empty if there is none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


@lru_cache(maxsize=4096)
def noise_name(names: str) -> bool:
    """Whether a class or id names a part that is no article.  A name counts
    as a whole: all its words are noise or neutral words and at least one is
    noise, so ``has-sidebar``, ``comments-open`` and ``search-engines`` don't
    count, ``site-footer`` and ``ad-slot-3`` do."""
    for name in re.split(r"\s+", names):
        words = [w for w in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        if words and any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in NEUTRAL_WORDS for w in words):
            return True
    return False


#: of a node: kept, noise by its name, noise by what it is
KEPT, NAMED, BARRED = 0, 1, 2


class _Node:
    __slots__ = ("tag", "noise", "main", "path", "branch", "link")

    def __init__(self, tag, noise, main, path, branch, link):
        self.tag, self.noise, self.main, self.path, self.branch, self.link = tag, noise, main, path, branch, link


class Block(NamedTuple):
    """A text block: its noise (KEPT, NAMED or BARRED), whether it lies inside
    the main element, its share of link text and its style node (None: none)."""

    text: str
    noise: int
    main: bool
    link: float
    branch: int | None


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def blocks(page: str) -> list[Block]:
    """Every non-empty block, in page order.

    A style node is the hash of its parent's hash and its own tag and names, so
    a page takes time and memory in proportion to its length, however deep its
    elements nest.  A name that says noise is taken back where the page's main
    element begins (``main``, or the first ``article`` of a page that had none),
    and is never read from that element itself.
    """
    out: list[Block] = []
    stack = [_Node("", KEPT, False, 0, None, False)]
    depth = Counter()  # open elements by tag, so an end tag without one costs nothing
    parts: list[str] = []
    linked, seen_main = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.noise, top.main, min(1.0, linked / max(1, len(raw))), top.branch))
        linked = 0

    def close_to(at: int) -> None:
        if any(n.tag in BLOCK for n in stack[at:]):
            flush()
        for n in stack[at:]:
            depth[n.tag] -= 1
        del stack[at:]

    def close_open(tags, until, every: bool = False) -> None:
        """Closes the nearest open element of ``tags`` (or all of them) inside
        ``until``."""
        if not any(depth[t] for t in tags):
            return
        found = None
        for d in range(len(stack) - 1, 0, -1):
            if stack[d].tag in tags:
                found = d
                if not every:
                    break
            elif stack[d].tag in until:
                break
        if found is not None:
            close_to(found)

    pos, lasts, last_tag = 0, {}, max(page.rfind(">"), page.rfind("<!"))
    while True:
        # behind the last end of a tag there is none to look for
        m = _MARKUP.search(page, pos) if pos <= last_tag else None
        text = page[pos:m.start()] if m else page[pos:]
        if text:
            parts.append(text)
            if stack[-1].link:
                linked += len(text)
        if not m:
            break
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "p" and not depth["p"]:
                flush()
            if depth[tag]:
                for d in range(len(stack) - 1, 0, -1):
                    if stack[d].tag == tag:
                        close_to(d)
                        break
                    if stack[d].tag in CONTAINER and tag not in BLOCK:
                        break  # an inline end tag does not close a container
            continue
        if tag in RAW or tag in SKIPPED:
            if not attrs.endswith("/"):
                end = None
                if lasts.get(tag, pos) >= pos:  # past the last end tag there is none to look for
                    end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, pos)
                    if not end:
                        lasts[tag] = -1
                if end and tag in SKIPPED and _OPENS.search(page, pos, end.start()):
                    end = None  # not closed where it should be
                if end:
                    pos = end.end()
                elif tag in RAW:
                    pos = len(page)
            continue
        if tag in BLOCK:
            close_open(EMBEDDED, CONTAINER, every=True)
            if tag in CLOSES_P:
                close_open(("p",), SCOPE)
            if tag in SIBLINGS:
                close_open(SIBLINGS[tag], SCOPE)
            flush()
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        top = stack[-1]
        noise, main, names, a = top.noise, top.main, "", {}
        if attrs.strip():
            a = _attributes(attrs)
            names = " ".join(sorted(a.get("class", "").split()))
            name = a.get("id", "")
            if name and not any(c.isdigit() for c in name):  # numbered ids differ from page to page
                names += f"#{name}"
        role = a.get("role", "").lower()
        opens = tag == "main" or role == "main" or (tag == "article" and not seen_main and top.noise != BARRED)
        main = main or tag in MAIN_TAGS or role == "main"
        if opens:
            seen_main = True
            noise = KEPT if noise == NAMED else noise
        elif noise == KEPT and tag not in ("html", "body") and a and noise_name(f"{a.get('class', '')} {a.get('id', '')}"):
            noise = NAMED
        if tag in EMBEDDED or (tag in NOISE_TAGS and not (tag == "header" and top.main)) or (a and (
                role in NOISE_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
                or "display:none" in a.get("style", "").replace(" ", "").lower())):
            noise = BARRED
        path, branch = top.path, top.branch
        if tag in CONTAINER:
            path = _signed(f"{top.path}/{tag}.{names}")
            # what holds the main text is never a branch to remove
            branch = None if tag in MAIN_TAGS or tag == "body" else path
        stack.append(_Node(tag, noise, main, path, branch, top.link or tag == "a"))
        depth[tag] += 1
    flush()
    return out


def by_rule(found: list[Block]) -> list[bool]:
    """Which blocks the rules remove: noise, what lies outside a main element
    that has text, and, without one, runs of short linked blocks (menus; a
    linked sentence stays).  Where that leaves nothing of a page without a main
    element, names are not believed: only what is noise by what it is goes."""
    has_main = any(b.main and not b.noise for b in found)
    short = [not has_main and b.link >= 0.6 and len(b.text.split()) <= 15 and b.text[-1] not in ".!?\u2026" for b in found]
    menu = [s and (short[i - 1] if i else False) or s and i + 1 < len(short) and short[i + 1] for i, s in enumerate(short)]
    out = [bool(b.noise) or m or (has_main and not b.main) for b, m in zip(found, menu)]
    return [b.noise == BARRED for b in found] if all(out) and not any(b.main for b in found) else out


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row values id, url; host, page, blocks, features) of every page; saved
    rows are numbered by ``extract``.

    ``page``: hash of the blocks that no rule removes, so copies share it.
    ``blocks``: text, rule (removed by rule), leaf (hash of the text and the
    innermost branch; NULL without one).  ``features``: of the blocks that no
    rule removes, the page's distinct (innermost branch, kind, value): kind 0
    is the branch itself, kind 1 its shape (number of own blocks), kind 2 a
    leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_type = pa.list_(pa.struct([("text", pa.string()), ("rule", pa.bool_()),
                                         ("leaf", pa.int64())]))
        feature_type = pa.list_(pa.struct([("branch", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())]))
        for batch in batches:
            hosts, copies, texts, features = [], [], [], []
            for url, page in zip(batch.column(1), batch.column(2)):
                found = blocks(page.as_py() or "")
                rows, seen, shape, digest = [], set(), {}, xxhash.xxh64()
                for (text, _, _, _, b), rule in zip(found, by_rule(found)):
                    leaf = None
                    if not rule:
                        digest.update(f"{'' if b is None else b} {text}\n".encode("utf-8", "surrogatepass"))
                    if b is not None and not rule:
                        leaf = xxhash.xxh64_intdigest(f"{b} {text}") - (1 << 63)
                        seen.add((b, 2, leaf))
                        shape[b] = shape.get(b, 0) + 1
                    rows.append({"text": text, "rule": rule, "leaf": leaf})
                seen |= {(b, 0, 0) for b in shape} | {(b, 1, n) for b, n in shape.items()}
                hosts.append(host_of(url.as_py()))
                copies.append(digest.intdigest() - (1 << 63))
                texts.append(rows)
                features.append([{"branch": b, "kind": k, "value": v} for b, k, v in seen])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hosts), pa.array(copies, pa.int64()),
                 pa.array(texts, block_type), pa.array(features, feature_type)],
                ["id", "url", "host", "page", "blocks", "features"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {id_type(pages, id_col)}, url string, host string, page bigint, blocks array<struct<text:"
                                "string,rule:boolean,leaf:bigint>>, features array<struct<branch:bigint,"
                                "kind:int,value:bigint>>")


def style_counts(parsed: DataFrame) -> DataFrame:
    """(host, branch, kind, value, n): the pages that carry each feature."""
    pairs = parsed.select("host", F.explode("features").alias("f")).select("host", "f.branch", "f.kind", "f.value")
    return saved(pairs.groupBy("host", "branch", "kind", "value").agg(F.count(F.lit(1)).alias("n")), "style-counts")


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, branch, pages, importance): the merged tree of each host.

    Content importance of a branch on m pages is 1 less the mean of
    log(n) / log(m) over its own texts, n the pages that carry a text there;
    presentation importance is the entropy, base m, of its shapes.
    """
    return _importance(style_counts(parsed))


def _importance(counts: DataFrame) -> DataFrame:
    pages = counts.filter("kind = 0").select("host", "branch", F.col("n").alias("pages"))
    n, m = F.col("n").cast("double"), F.col("pages").cast("double")
    same = F.when(F.col("kind") == 2, n * F.log(n) / F.log(m))
    shape = F.when(F.col("kind") == 1, -(n / m) * F.log(n / m) / F.log(m))
    return (
        counts.filter("kind > 0").join(pages.filter("pages > 1"), ["host", "branch"])
        .groupBy("host", "branch", "pages").agg(
            (1 - F.sum(same) / F.sum(F.when(F.col("kind") == 2, n))).alias("content"), F.sum(shape).alias("shape"))
        .select("host", "branch", "pages",
                ((1 - PRESENTATION) * F.col("content") + PRESENTATION * F.col("shape")).alias("importance")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            importance: float = IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, url, text) per row of ``pages``: the main text, blocks joined by
    one newline.

    A NULL or empty page has an empty text; a NULL or odd URL belongs to the
    host ""; repeated rows are returned each; pages of a host with the same
    blocks count once in its tree; a page of which the tree would leave nothing
    keeps what the rules leave; other columns are not read; an empty table
    gives an empty result.
    """
    parsed = saved(parse(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "pages-parsed")
    counts = style_counts(parsed.filter(F.size("features") > 0).select("host", "page", "features")
                          .dropDuplicates(["host", "page"]))
    low = _importance(counts).filter((F.col("importance") < importance) & (F.col("pages") >= min_pages))
    # a leaf's own importance is 1 - log(n) / log(pages)
    leaves = counts.filter("kind = 2").join(low, ["host", "branch"]).filter(
        F.log(F.col("n").cast("double")) > (1 - importance) * F.log(F.col("pages").cast("double")))
    noise = saved(leaves.select("host", F.col("value").alias("leaf")), "style-noise")
    # a page meets its host's noise leaf by leaf; what it holds of them (at
    # most its own blocks) is one row
    own = parsed.select("row", "host", F.explode(F.filter("features", lambda f: f["kind"] == 2)["value"]).alias("leaf"))
    found = saved(_join(own, noise, ["host", "leaf"], "inner").groupBy("row").agg(F.collect_set("leaf").alias("noise")),
                  "page-noise")
    none = F.array().cast("array<bigint>")
    left = F.filter("blocks", lambda b: ~b["rule"])
    kept = F.filter("left", lambda b: b["leaf"].isNull() | ~F.array_contains(F.coalesce("noise", none), b["leaf"]))
    return (
        _join(parsed.select("row", "id", "url", left.alias("left")), found, ["row"], "left")
        .select("id", "url", "left", kept.alias("kept"))
        .select("id", "url", F.array_join(F.transform(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("left")),
                                                      lambda b: b["text"]), "\n").alias("text")))


def _join(pages: DataFrame, side: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join to a written table of hosts' or pages' noise, broadcast up to
    ``BROADCAST_BYTES`` and shuffled beyond."""
    wide = F.size("noise") * 8 + 24 if "noise" in side.columns else F.octet_length("host") + 24
    size = side.agg(F.sum(wide.cast("bigint"))).first()[0] or 0
    return pages.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, on, how)
