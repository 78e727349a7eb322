import html
import random
import re
from collections import Counter

import pytest

from logsluice.llm.htmlmain import Page, extract_pages, host_of

SCHEMA = "page_id long, url string, html string, text string, host string, trees string"


def text_of(source, templates=()):
    return Page(source).main_text(frozenset(templates))


def plain(source):
    """The article of the given pages: tags out, one block after another."""
    body = re.search(r"<article>(.*?)(</article>|$)", source, re.DOTALL).group(1)
    parts = re.split(r"</?(?:p|h1)>", body)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return " ".join(p for p in parts if p)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r["page_id"]: r for r in pages.collect()}
    found = extract_pages(pages).collect()
    assert len(found) == len(sources)
    for r in found:
        source = sources[r["page_id"]]
        assert r["text"] == plain(source["html"]) and r["url"] == source["url"] and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("just text &lt;b&gt; &amp;amp;", "just text <b> &amp;"),
        ("<p>a&nbsp;&#8364;&#x41; b<br>c</p>d", "a €A b c d"),
        ("<article><p>one<p>two\n three</article><p>out", "one two three"),
        ("<article><p>un<b>bro</b>ken <i>word", "unbroken word"),
        ("<p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
        ("<p>x</p><script>var a='<p>no</p>'</script><style>p{}</style><p>y</p>", "x y"),
        ("<nav>m</nav><header>h</header><main><p>t</p></main><aside>s</aside><footer>f</footer>", "t"),
        ("<div class='post-content'><p>keep</p></div><div id='siteSidebar'>no</div>", "keep"),
        ("<p>a</p><div class='cookie-banner'><p>b</p></div><section id=comments><p>c</p></section>", "a"),
        ("<p>a</p><form><p>b<input></p></form><div hidden>c</div><div style='display:none'>d</div>", "a"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<p title='a > b'>t</p>", "t"),
        ("<p title=it's>one</p><p title=isn't>two</p>", "one two"),
        ("<p title=a\"b>one</p><p data-x = 'a>b' y=\"c>d\">two</p><p \"q>r</p>", "one two r"),
        ("<p title='open>one</p>", "one"),
        ('<div id="page" class="no-sidebar"><p>body</p></div><div class="sidebar">s</div>', "body"),
        ('<div class="content has-sidebar"><p>body</p></div><p>more</p><p>and more</p>', "body more and more"),
        ('<article><p>a</p><div class="article-share-wrap"><p>b</p></div></article>', "a b"),
        ('<article><p>a</p><div class="share-links"><p>b</p></div></article>', "a"),
        ('<div class="header"><h1>Title</h1></div><p>x</p><div class="top-banner">no</div><p>long text</p>', "Title x long text"),
        ('<div class="side"><p>most of the text of a page</p></div><p>rest</p>', "most of the text of a page rest"),
        ('<div class="menu"><article><p>a</p></article></div><p>out</p>', "a"),
        ('<p>a</p><div id="comments"><article><h1>no</h1><p>not a word of this at all</p></article></div>', "a"),
        ('<p data-id="ad" title="x class=ad">kept</p><p>a</p>', "kept a"),
        ("<p>one</p><div class=cookie-banner><p>x</p><div><p>y</p></div></div><p>two three four</p>", "one two three four"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<article><h1>Title &am</h1><p>x</p></article>", "Title &am x"),
        ("<p>cut off <b", "cut off"),
        ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_markup(source, want):
    assert text_of(source) == want


def test_templates_recur_on_a_host(spark):
    rows = []
    for i in range(12):
        box = "<div><p>Read more of our stories</p></div>"
        rows.append((i, f"http://a.example/{i}", f"<body><div><p>Own text {i}</p></div>{box}</body>", "x", "x", "x"))
        article = f"<article><p>Same words</p><p>own {i}</p>{box}</article>"
        rows.append((100 + i, f"http://b.example/{i}", article, "x", "x", "x"))
        rows.append((200 + i, f"http://c{i}.example/", f"<div><p>Alone {i}</p></div>{box}", "x", "x", "x"))
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(12):
        assert got[i] == f"Own text {i}"
        assert got[100 + i] == f"Same words own {i}"  # a repeated paragraph of articles stays
        assert got[200 + i] == f"Alone {i} Read more of our stories"  # on one page of each host only


@pytest.mark.parametrize(
    "page",
    [
        "<body><div><p>Own words</p></div><p>more</p>{}</body>",
        "<article><div><p>Own words</p></div><p>more</p></article>{}",
        "<main><section><p>Own words</p></section><p>more</p></main>{}",
    ],
)
def test_copies_of_a_page_are_one_page(spark, page):
    box = "<div><p>Read more of our stories</p></div>"
    rows = [(i, f"http://a.example/{i}", page.format(""), "x", "x", "x") for i in range(10)]
    # On this host the copies stand among other pages, and what does recur is found still.
    rows += [(100 + i, f"http://b.example/{i}", page.format(box), "x", "x", "x") for i in range(10)]
    for i in range(12):
        source = f"<body><div><p>Text {i}</p></div>{box}</body>"
        rows.append((200 + i, f"http://b.example/n{i}", source, "x", "x", "x"))
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == got[100 + i] == "Own words more" for i in range(10))
    assert all(got[200 + i] == f"Text {i}" for i in range(12))


def test_templates_equal_a_plain_count(spark):
    """Pages made of known trees: which subtrees recur is counted on the trees themselves."""
    rng = random.Random(3)
    boxes = [[f"box {i}", [f"inner {i}"]] for i in range(6)]

    def grown(depth):
        if rng.random() < 0.4:
            return rng.choice(boxes)
        return [f"w{rng.randrange(10**9)}", *(grown(depth - 1) for _ in range(rng.randrange(3) if depth else 0))]

    def source(node):
        return node if isinstance(node, str) else "<div>" + "".join(map(source, node)) + "</div>"

    def below(node):
        return [repr(node), *(x for child in node if not isinstance(child, str) for x in below(child))]

    def kept(node, bad):
        if isinstance(node, str):
            return [node]
        return [] if repr(node) in bad else [x for child in node for x in kept(child, bad)]

    pages = [(h, [grown(2) for _ in range(4)]) for h in range(3) for _ in range(40)]
    pages += rng.choices(pages, k=40)  # copies count once
    rows = [(i, f"http://h{h}/{i}", "".join(map(source, p)), "x", "x", "x") for i, (h, p) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    removed = 0
    for i, (host, page) in enumerate(pages):
        different = {repr(p): p for h, p in pages if h == host}.values()
        counts = Counter(x for p in different for x in {x for node in p for x in below(node)})
        bad = {x for x, n in counts.items() if n >= 5 and n >= 0.2 * len(different)}
        assert got[i] == " ".join(x for node in page for x in kept(node, bad))
        removed += got[i] != " ".join(x for node in page for x in kept(node, set()))
    assert removed > 20


def test_odd_rows(spark):
    rows = [
        (1, None, "<p>a</p>", "x", "x", "x"),
        (2, "no host", None, "x", "x", "x"),
        (None, "http://h/", "", "x", "x", "x"),
        (3, "http://h/", "<p>" + "long " * 200_000 + "</p>", "x", "x", "x"),
        (4, "http://h/", "<p>t</p>", "x", "x", "x"),
        (4, "http://h/", "<p>t</p>", "x", "x", "x"),
    ]
    pages = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r["page_id"] or 0, r["n_chars"]) for r in extract_pages(pages).collect())
    assert found == [(0, 0), (1, 1), (2, 0), (3, 999_999), (4, 1), (4, 1)]
    assert extract_pages(pages.limit(0)).count() == 0


def test_hosts(spark):
    urls = ["http://User@WWW.Example.com:80/x", "//cdn.example/a", "mailto:x", "", None, "https://e.org?q=//z"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in frame.select(host_of(frame["u"])).collect()]
    assert got == ["www.example.com", "cdn.example", None, None, None, "e.org"]
