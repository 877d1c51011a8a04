import html
import random
import re
from html.parser import HTMLParser

import pytest

from equitext.llm import html_styletree as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="x"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Title  &amp;
 more</h1></header><p>First <b>bold</b> &eacute;t&#233; &lt;tag&gt;<p>Second&nbsp;line<br>after break
<ul><li>one<li>two</ul><blockquote>Quote</blockquote><aside>Aside</aside><div class="share">Share</div>
<table><tr><td>a<td>b</table><form><input value="q"><button>Go</button></form><pre>x   y</pre>
<!-- no <p>comment</p> --><div hidden>hid</div><div style="display: none">hid</div><noscript>js</noscript></article>
<section id="comments"><article class="comment"><p>Reader</p></article></section></main>
<div role="complementary">Side</div><footer>&copy; me</footer></body></html>"""


def _texts(page):
    found = H.blocks(page)
    return [b.text for b, rule in zip(found, H.by_rule(found)) if not rule]


def test_rules_on_one_page():
    assert _texts(PAGE) == ["Title & more", "First bold été <tag>", "Second line", "after break", "one", "two", "Quote", "a", "b", "x y"]


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<p>x</b></i></div>", "<article><p>x", "</article></p>", "<script>x", "<!--",
                                  "<a href='x>y", "&amp;&bogus;&#xZZ;", "<p>\x00</p>", "<DIV CLASS=AD>x</DIV>"])
def test_broken_markup_does_not_fail(page):
    H.blocks(page)


def test_long_and_nested_pages():
    assert len(H.blocks("<article>" + "<p>word " * 20_000)) == 20_000
    assert _texts("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == ["deep"]
    assert _texts("<article><p>" + "x " * 200_000 + "</article>") == [" ".join(["x"] * 200_000)]


ARTICLE = "<h1>Head</h1><p>One paragraph of text.</p><p>Another one.</p>"
KEPT = ["Head", "One paragraph of text.", "Another one."]


@pytest.mark.parametrize("page", [
    f'<body><main class="content has-sidebar">{ARTICLE}</main><div class="sidebar">S</div></body>',
    f'<body><article class="post comments-open">{ARTICLE}</article><div id="comments">C</div></body>',
    f'<body><div class="wrap sidebar-right"><article>{ARTICLE}</article></div></body>',
    f'<body><div class="sidebar-right"><main>{ARTICLE}</main></div></body>',
    f'<body><article class="header-image">{ARTICLE}</article></body>',
    f'<body><article class="search">{ARTICLE}</article></body>',
    f'<body><div class="comment-form"><div>{ARTICLE}</div></div></body>',  # all is noise by name: names are not believed
    f'<body><select><option>no<p></p><article>{ARTICLE}</article></body>',
    f'<body><svg><text>no</text><article>{ARTICLE}</article></body>',
    f'<body><object><canvas><main>{ARTICLE}</main></body>',
    f'<body><noscript><article>{ARTICLE}</article></body>',
    f'<body><iframe src=x><article>{ARTICLE}</article><iframe></iframe></body>',
    f'<body><template><nav>x</nav></template><div class="site-header">H</div><div>{ARTICLE}</div><div class="footer-widgets">F</div></body>',
    f'<body><div class=adSlot3>A</div><div>{ARTICLE}</div><div class="share-buttons">B</div><ul class="main-menu"><li>M</ul></body>',
    f'<body><article>{ARTICLE}</article><div class="comment-list"><article class=comment>Reader</article></div></body>',
    f'<body><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul><div>{ARTICLE}</div></body>',
])
def test_names_of_parts(page):
    assert _texts(page) == KEPT


def test_what_is_named_inside_an_article():
    page = '<article><p class="search-engines">On engines.</p><p><a href=x>A sentence that is a link.</a></p><p class=notice>N</p></article>'
    assert _texts(page) == ["On engines.", "A sentence that is a link."]
    assert _texts("<div><p><a href=x>A sentence that is a link.</a></p><p>Text</p></div>") == ["A sentence that is a link.", "Text"]


def test_time_and_memory_follow_the_length():
    import time
    import tracemalloc

    for page in ("<div class=a>" * 100_000 + "deep", "<a '" * 50_000, "<a '" * 50_000 + ">", "<select>" * 20_000,
                 "</p></b>" * 50_000, "<script" * 20_000, "<noscript>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000):
        tracemalloc.start()
        at = time.process_time()
        H.blocks(page)
        took, peak = time.process_time() - at, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert took < 30 and peak < 200 << 20, (page[:10], took, peak)


class _Tree(HTMLParser):
    """An independent reading of well-formed pages as a tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"tag": "", "attrs": {}, "kids": [], "up": None}

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": dict(attrs), "kids": [], "up": self.at}
        self.at["kids"].append(node)
        if tag not in ("br", "img", "hr"):
            self.at = node

    def handle_endtag(self, tag):
        if self.at["tag"] == tag:
            self.at = self.at["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)


_DROP = ("nav", "footer", "aside", "form", "script", "style", "header", "noscript", "button")
_LINES = ("p", "div", "li", "h1", "h2", "td", "blockquote", "article", "section", "ul", "table", "tr", "br", "main", "figure")


def tree_text(page):
    reader = _Tree()
    reader.feed(page)
    mains = []

    def find(node):
        for k in node["kids"]:
            if isinstance(k, dict):
                mains.append(k) if k["tag"] == "main" else find(k)

    find(reader.root)
    lines = [""]

    def walk(node):
        for k in node["kids"]:
            if isinstance(k, str):
                lines[-1] += k
            elif k["tag"] in _DROP or "hidden" in k["attrs"] or k["attrs"].get("class") in ("share", "comments", "ad", "related"):
                lines.append("")
            else:
                if k["tag"] in _LINES:
                    lines.append("")
                walk(k)
                if k["tag"] in _LINES:
                    lines.append("")

    for m in mains:
        walk(m)
        lines.append("")
    return "\n".join(t for t in (" ".join(x.split()) for x in lines) if t)


def _page(r):
    words = lambda n: " ".join(r.choice(["alpha", "be&amp;ta", "g&eacute;", "&#233;t", "<b>bold</b>", "<a href=x>link</a>", "x  y"])
                               for _ in range(n))

    def inner(depth):
        kind = r.choice(["p", "p", "p", "h2", "ul", "div", "blockquote", "table", "section", "drop", "br", "figure"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words(3)}</li>" for _ in range(3)) + "</ul>"
        if kind == "table":
            return f"<table><tr><td>{words(2)}</td><td>{words(2)}</td></tr></table>"
        if kind == "drop":
            return r.choice([f"<aside>{words(4)}</aside>", f'<div class="share">{words(2)}</div>', f"<form>{words(3)}</form>",
                             "<script>if (a<b) x()</script>", f'<div class="ad">{words(5)}</div>', f"<div hidden>{words(2)}</div>"])
        if kind == "br":
            return f"<p>{words(3)}<br>{words(3)}</p>"
        if kind in ("div", "section", "figure") and depth < 4:
            return f"<{kind}>" + "".join(inner(depth + 1) for _ in range(r.randint(1, 3))) + f"</{kind}>"
        return f"<{kind if kind in ('p', 'h2', 'blockquote') else 'p'}>{words(r.randint(1, 12))}</{kind if kind in ('p', 'h2', 'blockquote') else 'p'}>"

    body = "".join(inner(0) for _ in range(r.randint(1, 8)))
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>"
            f"<a href=/>Home</a></li></ul></nav><main><article>{body}</article><div class=comments><article>{words(4)}</article></div>"
            f"</main><footer>Foot</footer></body></html>")


def test_random_pages_match_an_independent_tree(spark):
    r = random.Random(21)
    rows = [(i, f"http://host{i}/", _page(r)) for i in range(300)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = {i: tree_text(page) for i, _, page in rows}
    assert {x["id"]: x["text"] for x in out.collect()} == want


def _site(n):
    """Pages of one host without any naming element: a line that is the same
    everywhere, one of a few, and the page's own text."""
    return [(i, f"http://Site.example/p{i}", f"<body><div class=top>Welcome to the site</div><div class=box>Offer {i % 2}</div>"
             f"<div class=text><p>Page {i} has words of its own</p><p>and more {i * 7}</p></div></body>") for i in range(n)]


def test_style_tree_removes_what_pages_share(spark):
    rows = _site(40) + [(100, "https://other.example/", "<body><div class=top>Welcome to the site</div><p>Alone</p></body>"),
                        (101, None, None), (102, "no url", ""), (102, "no url", ""), (None, "http://Site.example:80/q", _site(1)[0][2])]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, host int")
    out = H.extract(df)
    got = [(r["id"], r["text"]) for r in out.collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert all(by[i] == f"Page {i} has words of its own\nand more {i * 7}" for i in range(40))
    assert by[100] == "Welcome to the site\nAlone" and by[101] == by[102] == "" and by[None].startswith("Page 0 has")
    tree = {(r["branch"], r["host"]): r["importance"] for r in H.style_tree(H.parse(df)).collect()}
    assert min(tree.values()) < 0.05 and max(tree.values()) > 0.8
    assert H.extract(df.limit(0)).count() == 0


def test_importance_by_hand(spark):
    import math

    df = spark.createDataFrame([(i, "http://h/", f"<div class=d>{'same' if i < 6 else i}</div>") for i in range(8)],
                               "page_id long, url string, html string")
    row = H.style_tree(H.parse(df)).first()
    want = 1 - 6 * math.log(6) / math.log(8) / 8
    assert row["pages"] == 8 and abs(row["importance"] - 0.9 * want) < 1e-9


def test_wrappers_keep_their_content(spark):
    menu = "".join(f"<p>Entry {k} of the list of things</p>" for k in range(12))
    own = lambda i: [f"Page {i} says thing {k}" for k in range(4)]
    paragraphs = lambda i: "".join(f"<p>{t}</p>" for t in own(i))
    sites = {
        "wrapped": lambda i: f"<div class=page><div class=top>{menu}</div><div class=body>{paragraphs(i)}</div><div class=end>{menu}</div></div>",
        "ids": lambda i: f"<div id=top>{menu}</div><div id=text>{paragraphs(i)}</div>",
        "numbered": lambda i: f"<div id=a1>{menu}</div><div id=b{i}>{paragraphs(i)}</div>",
        "flat": lambda i: f"<div class=page>{menu}{paragraphs(i)}</div>",
    }
    rows = [(f"{name}{i}", f"http://{name}/{i}", f"<body>{site(i)}</body>") for name, site in sites.items() for i in range(9)]
    out = {r["id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert out == {f"{name}{i}": "\n".join(own(i)) for name in sites for i in range(9)}


def test_copies_of_a_page_are_no_boilerplate(spark):
    page = lambda i, end="": (f"<body><nav>Hit {end}</nav><article><div class=body><p>Article {i} begins</p>"  # noqa: E731
                              f"<p>and ends {i}</p></div></article></body>")
    text = lambda i: f"Article {i} begins\nand ends {i}"
    rows = [(f"all{i}", "http://all/", page(0, i), text(0)) for i in range(8)]
    rows += [(f"mix{i}", "http://mix/", page(max(0, i - 89), i), text(max(0, i - 89))) for i in range(100)]
    # a page that says nothing but what others say keeps it
    rows += [(f"own{i}", "http://own/", f"<div class=a>Said by all</div>{f'<p>Own {i}</p>' if i else ''}",
              f"Own {i}" if i else "Said by all") for i in range(30)]
    out = H.extract(spark.createDataFrame(rows, "page_id string, url string, html string, want string"))
    assert {r["id"]: r["text"] for r in out.collect()} == {r[0]: r[3] for r in rows}


def test_pages_match_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    from equitext.llm.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = QUERIES["op6_html_styletree"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])
