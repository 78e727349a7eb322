"""Main text of web pages, with site templates found by their recurrence on a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import pick, stored

# A subtree is a site template if it stands on this many pages of the host, and on this share.
MIN_PAGES = 5
MIN_SHARE = 0.2

# Elements of HTML, by what they are.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe object svg canvas math "
    "button select option textarea dialog menu menuitem audio video map".split()
)
BLOCKS = frozenset(
    "p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address details summary hr body html hgroup center".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
# Words of class, id and role names for what is not main text, ...
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside complementary widget "
    "header masthead footer contentinfo copyright share sharing social related recommended pagination pager "
    "toolbar skip search login signup".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
# ... and words that may stand beside them. A name with any other word (no-sidebar,
# article-share-wrap) is not taken for boilerplate.
BESIDE = frozenset(
    "the site page main top bottom left right primary secondary global inner outer user reader "
    "box bar list item items area block section container wrapper wrap content slot unit links link icons buttons "
    "button form group panel row col column inline sticky fixed cc u js posts articles stories thread policy".split()
)
# An element named as boilerplate stays if it holds this share of the page's text.
MOST = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>=]+|=)*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
NAME = re.compile(r"[a-z]+")
HIDING = re.compile(r"display\s*:\s*none", re.IGNORECASE)
SPLIT_NAME = re.compile(r"(?<=[a-z])(?=[A-Z])")
KEPT, NAMED, GONE = range(3)


class Named:
    """An element that its name tells to be boilerplate: how much text it holds, and what speaks against it."""

    __slots__ = ("around", "chars", "comments", "heading", "article", "gone")

    def __init__(self, around: Named | None, comments: bool) -> None:
        self.around, self.comments = around, comments
        self.chars, self.heading, self.article, self.gone = 0, False, False, False


def _decide(named: list[Named], total: int) -> None:
    """Comments always go; other elements not with the main heading, an article or most of the text.

    ``named`` is in page order, so elements come after the one around them.
    """
    for element in reversed(named):
        outer = element.around
        if outer:
            outer.chars += element.chars
            outer.heading |= element.heading
            outer.article |= element.article
    for element in named:
        holds = element.heading or element.article or element.chars > total * MOST
        element.gone = element.comments or not holds or element.around is not None and element.around.gone


class Element:
    """An open element: its text so far, the pieces of text below it, the named element it is in."""

    __slots__ = ("tag", "dropped", "main", "digest", "pieces", "inside", "named")

    def __init__(self, tag: str, dropped: bool, main: bool, inside: bool, named: Named | None) -> None:
        self.tag, self.dropped, self.main, self.inside, self.named = tag, dropped, main, inside, named
        self.digest = xxhash.xxh3_64(tag.encode())
        self.pieces: list[int] = []


def _names(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names is made of these words and of words beside them alone."""
    for name in value.split():
        parts = NAME.findall(SPLIT_NAME.sub(" ", name).lower())
        if not words.isdisjoint(parts) and all(part in words or part in BESIDE for part in parts):
            return True
    return False


def _verdict(tag: str, attributes: str) -> tuple[int, bool]:
    """Whether an element is kept, named as boilerplate or gone; and whether it holds comments."""
    if tag in DROPPED:
        return GONE, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return KEPT, False
    named = comments = False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return GONE, False
        if name == "style" and HIDING.search(value):
            return GONE, False
        if name in ("class", "id", "role"):
            comments |= _names(value, COMMENTS)
            named |= _names(value, BOILERPLATE)
    return (NAMED if named or comments else KEPT), comments


class Page:
    """One pass over a page: its text pieces, and the hashes of its element subtrees.

    An element whose name says boilerplate is left out at the end, when it is known what
    it holds and how much that is of the page.

    A subtree's hash covers its tags and texts, not its attributes. ``blocks`` are
    (subtrees, text, main): the hashes of the block elements a piece of text lies in,
    innermost last. Only container elements can be templates where the page marks
    its article, as an article may repeat a sentence of another.
    """

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[list[int], str, bool]] = []
        self.subtrees: list[tuple[int, bool]] = []
        self._stack = [Element("", False, False, False, None)]
        self._texts: list[str] = []
        self._of: list[list[int]] = []
        self._main: list[bool] = []
        self._all_named: list[Named] = []
        self._named: list[Named | None] = []
        self._articles: list[Named | None] = []
        self._held: list[tuple[int, bool, Named | None]] = []
        self._buffer: list[str] = []
        self.has_main = False
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        size = len(source)
        while at < size:
            found = TOKEN.search(source, at)
            start = found.start() if found else size
            if start > at:
                self._text(source[at:start])
            if not found:
                break
            at = found.end()
            tag = found.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if found.group(1):
                self._close(tag)
                continue
            self._open(tag, found.group(3))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at)
                at = end.start() if end else size
        while len(self._stack) > 1:
            self._pop()
        self._flush()
        _decide(self._all_named, sum(map(len, self._texts)))
        self.has_main = any(not (named and named.gone) for named in self._articles)
        self.subtrees = [(value, text) for value, text, named in self._held if not (named and named.gone)]
        for text, of, main, named in zip(self._texts, self._of, self._main, self._named, strict=True):
            if not (named and named.gone):
                self.blocks.append((of, text, main))

    def _text(self, raw: str) -> None:
        if not self._stack[-1].dropped:
            self._buffer.append(raw)
        elif raw.strip():
            self._stack[-1].digest.update(raw.encode())

    def _flush(self) -> None:
        """Ends a block of text: decoded once, white space to single spaces."""
        if not self._buffer:
            return
        text = " ".join(html.unescape("".join(self._buffer)).split())
        self._buffer = []
        if not text:
            return
        top = self._stack[-1]
        top.digest.update(text.encode())
        top.pieces.append(len(self._texts))
        self._texts.append(text)
        self._of.append([])
        self._main.append(top.inside)
        self._named.append(top.named)
        if top.named:
            top.named.chars += len(text)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "hr":
            self._buffer.append(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return
        top = self._stack[-1]
        verdict, comments = (GONE, False) if top.dropped else _verdict(tag, attributes)
        if tag in BLOCKS or verdict != KEPT:
            self._flush()
            if tag in BLOCKS:
                self._imply(tag)
                top = self._stack[-1]
        else:
            return  # inline elements neither part texts nor make subtrees
        dropped = top.dropped or verdict == GONE
        named = top.named
        if verdict == NAMED:
            named = Named(top.named, comments)
            self._all_named.append(named)
        main = tag in ("article", "main") and not dropped
        if named and not dropped:
            named.heading |= tag == "h1"
            named.article |= main
        if main:
            self._articles.append(named)
        self._stack.append(Element(tag, dropped, main, top.inside or main, named))

    def _imply(self, tag: str) -> None:
        """A block tag ends an open p; li, dt, dd, td, th, tr and option end their own kind."""
        if self._stack[-1].tag == "p":
            self._pop()
        kinds = {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr"}.get(tag)
        if kinds and self._stack[-1].tag in kinds.split():
            self._pop()

    def _close(self, tag: str) -> None:
        if all(e.tag != tag for e in self._stack[1:]):
            return
        self._flush()
        while self._stack[-1].tag != tag:
            self._pop()
        self._pop()

    def _pop(self) -> None:
        self._flush()
        element = self._stack.pop()
        value = element.digest.intdigest() - (1 << 63)
        parent = self._stack[-1]
        parent.digest.update(value.to_bytes(8, "little", signed=True))
        parent.pieces += element.pieces
        for i in element.pieces:
            self._of[i].append(value)
        text_block = element.tag in TEXT_BLOCKS
        if element.pieces and not element.main and element.tag not in ("html", "body"):
            self._held.append((value, text_block, element.named))

    def candidates(self) -> list[int]:
        """Hashes of the subtrees that may be templates, each once."""
        return sorted({value for value, text_block in self.subtrees if not (text_block and self.has_main)})

    def main_text(self, templates: frozenset[int]) -> str:
        """Texts in page order: those of the article if one is marked, without templates."""
        kept = [
            text
            for of, text, main in self.blocks
            if (main or not self.has_main) and not (templates and any(value in templates for value in of))
        ]
        return " ".join(kept)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, tree): each candidate of a page with the hash of its main text; one row of a page has no tree."""
    for batch in batches:
        hosts, contents, values = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(source.as_py())
            found = [None, *page.candidates()]
            values += found
            hosts += [host] * len(found)
            contents += [xxhash.xxh3_64(page.main_text(frozenset()).encode()).intdigest() - (1 << 63)] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(values, pa.int64())],
            ["host", "content", "tree"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, sources, templates = (batch.column(i) for i in range(4))
        texts = []
        for source, trees in zip(sources, templates, strict=True):
            texts.append(Page(source.as_py() or "").main_text(frozenset(trees.as_py() or ())))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null without one."""
    host = F.lower(F.regexp_extract(url, r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, tree) of the element subtrees that recur across many different pages of a host.

    Pages with the same main text (of the article, where one is marked) are copies and count once,
    in the pages of a host as in those of a subtree: a page's own content is no template,
    however often the page stands there. Every page tells each of its subtrees once; they are made
    distinct by content and counted by host and hash, with partial sums before each shuffle, so a
    large host is spread over its subtrees.
    """
    base = pages.select(host_of(F.col("url")).alias("host"), "html").where("host IS NOT NULL AND html IS NOT NULL")
    told = base.mapInArrow(_subtrees, "host string, content long, tree long").distinct()
    counts = stored(told.groupBy("host", "tree").count().where(F.col("count") >= min_pages), "subtree-counts")
    sizes = counts.where("tree IS NULL").select("host", F.col("count").alias("pages"))
    return (
        counts.where("tree IS NOT NULL")
        .join(sizes, "host")
        .where(F.col("count") >= F.col("pages") * min_share)
        .select("host", "tree")
    )


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The main text of every page.

    Needs ``page_id``, ``url`` and ``html``; other columns are ignored. Returns page_id,
    url, text and n_chars. Left out are elements that are never main text (nav, header,
    footer, aside, form, script, style, ...), hidden ones, elements that a name in class, id or
    role tells to be boilerplate with all its words (menus, adverts, notices; not "no-sidebar")
    and that hold neither a main heading (h1), an article nor most of the page's text, those
    so named as reader comments whatever they hold, everything
    beside the article where one is marked, and site templates: subtrees of
    container elements that recur on at least ``min_pages`` different pages and
    ``min_share`` of the different pages of the host; copies of a page, those with the same
    main text, are one. A repeated paragraph of an article is no template. Of a host at most 1 / min_share subtrees a page can recur so
    often, so the list that joins a page is bounded.

    A null html, or one without text, gives an empty text. A null url or one without a
    host has no site templates. Repeated rows are extracted one by one; broken or cut
    off markup is read to its end. An empty table gives no rows.
    """
    base = pick(pages, page_id="long", url="string", html="string")
    templates = stored(site_templates(base, min_pages, min_share), "site-templates")
    lists = templates.groupBy(F.col("host").alias("__host")).agg(F.collect_set("tree").alias("trees"))
    found = (
        base.withColumn("host", host_of(F.col("url")))
        .join(stored(lists, "template-lists"), F.col("host") == F.col("__host"), "left")
        .select("page_id", "url", "html", "trees")
        .mapInArrow(_texts, "page_id long, url string, text string")
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
