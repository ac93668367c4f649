"""Main text of HTML pages: elements that recur across the pages of a host are removed as its template.

A page is parsed into a tree; each block element of its article has a hash of
its tags and text.  Spark counts, per host, on how many different articles each
hash appears.  Hashes on many are candidates, and template are those that stand
on many articles which differ otherwise: of the text outside of candidates, most
stands in few other articles.  Edited copies of an article share its words, so
together they count about once; this is looked at on pages with candidates only.
The last pass parses again, deletes those subtrees and the elements that HTML or
their names mark as no part of an article, and joins the blocks that remain.

Copies of a page are one article, so a page that a host serves a thousand times
is not taken for its own template.  Work is in proportion to a page's length,
however its tags are nested.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import hash_runs, mix, text_batches, utf8, words
from tidemark.session import written

#: A subtree is template when it stands on so many articles of a host that differ otherwise.
MIN_ARTICLES = 8
#: An article says what is template only if this part of its text at least is outside of all candidates.
OWN_SHARE = 0.2
#: Words in a shingle, and minimum hashes of a block's shingles, by which edited copies of a block are known.
SHINGLE, MARKS = 5, 8
#: Numbers (8 bytes each) in a table that may be broadcast; a shuffled join serves beyond.
BROADCAST_NUMBERS = 2_000_000
#: An article is where the text is if it holds this part of that of the main element around or beside it.
ARTICLE_SHARE = 0.5

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are no part of an article.
DROPPED = frozenset("head script style noscript template nav aside footer form button select option input textarea label fieldset iframe object embed svg math canvas audio video map dialog menu noembed noframes xmp".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags before which HTML implies the end of an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Parts of lists and tables, the elements that they end and the ones that stop the search for these.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SIBLINGS = {tag: (ends.split(), stops.split()) for tag, (ends, stops) in SIBLINGS.items()}
#: Words in class, id or role that mark what surrounds an article.
SURROUNDINGS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners promo promos promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay toast "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar toolbar footer bottombar copyright "
    "sidebar sidebars aside widget widgets rail related recommended recommendations trending popular "
    "comment comments commentlist disqus respond replies reply discussion "
    "share sharing social follow newsletter subscribe subscription signup login search searchbox form complementary contentinfo "
    "skip skiplink".split()
)
#: Words that turn such a name into a remark about the layout, or into a part of the article.
LAYOUT = frozenset("has with without no layout".split())
PARTS = {"header": frozenset("article entry post story content".split()), "widget": frozenset("text editor content".split())}
#: Words that mark even an article element as no part of the article, as readers' comments are.
NO_ARTICLE = frozenset("comment comments reply replies respond related recommended ad ads advert sponsored promo".split())
#: Words that mark an article element as one of a list, which points to articles elsewhere.
LISTED = frozenset("card cards teaser teasers tile preview excerpt".split())
#: Whole names that mark a part of an article element as none of it; their words alone may belong to its subject.
NO_PART = frozenset(
    "ad ads advert adverts advertisement advertisements ad-box ad-slot ad-unit ad-container ad-banner text-ad adsbygoogle sponsored sponsored-content promo promotion "
    "banner cookie-banner cookie-notice cookie-consent notice popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc "
    "sidebar widget related related-posts related-articles related-links related-content recommended recommendations read-more "
    "comment comments comment-list commentlist comments-area comment-form disqus-thread respond replies "
    "share share-bar share-buttons share-links sharing social social-share social-links social-bar follow-us newsletter newsletter-signup newsletter-form subscribe subscription signup login "
    "skip-link skiplink".split()
)
#: Roles of what surrounds an article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())

# a quote matters right after an equals sign only
_TOKEN = re.compile(
    r"<!--(?:.*?(?:-->|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"
    r"<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WHITE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
_MARKED = ("article", "main")


class Element:
    """An element of a page: tag, attributes as written, children (elements and text), whether it stands inside an article or main element or holds one."""

    __slots__ = ("tag", "attributes", "children", "inside", "holds", "out", "size", "hash")

    def __init__(self, tag: str, attributes: str = "", inside: bool = False):
        self.tag, self.attributes, self.inside = tag, attributes, inside
        self.children: list[Element | str] = []
        self.holds = False
        self.out: bool | None = None  # what surrounding() found
        self.size = self.hash = 0


def parse(page: str) -> Element:
    """The tree of a page; missing end tags are implied as HTML does for paragraphs, lists and tables.

    Where the open elements of each tag stand is kept, so no tag searches for its
    like, however many are open.
    """
    root = Element("#root")
    open_, depth_of, block_at = [root], {}, [0]  # block_at: depths of open blocks
    marked = 0

    def close(depth: int) -> None:
        """Close all open elements from a depth on."""
        nonlocal marked
        while len(open_) > depth:
            e = open_.pop()
            depth_of[e.tag].pop()
            marked -= e.tag in _MARKED
            if block_at[-1] == len(open_):
                block_at.pop()

    at, end, search = 0, len(page), _TOKEN.search
    while at < end:
        m = search(page, at)
        if m is None:
            open_[-1].children.append(page[at:])
            break
        if m.start() > at:
            open_[-1].children.append(page[at : m.start()])
        at = m.end()
        kind = m.lastgroup
        if kind == "end":
            tag = m["end"].lower()
            if own := depth_of.get(tag):
                close(own[-1])
            elif tag == "br":
                open_[-1].children.append(Element("br"))
            continue
        if kind != "attributes":
            if kind == "cdata":
                open_[-1].children.append(m["cdata"])
            continue
        tag, attributes = m["start"].lower(), m["attributes"]
        if tag in ENDS_PARAGRAPH and open_[block_at[-1]].tag == "p":
            close(block_at[-1])
        if tag in SIBLINGS:
            ends, stops = SIBLINGS[tag]
            floor = max((own[-1] for s in stops if (own := depth_of.get(s))), default=0)
            above = [own[k] for e in ends if (own := depth_of.get(e)) and (k := bisect_right(own, floor)) < len(own)]
            if above:
                close(min(above))
        child = Element(tag, attributes, marked > 0)
        open_[-1].children.append(child)
        if tag in _MARKED and not surrounding(child):
            for e in reversed(open_):
                if e.holds:
                    break
                e.holds = True
        if tag in VOID or tag in ("svg", "path") and attributes.endswith("/"):
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            child.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        depth_of.setdefault(tag, []).append(len(open_))
        if tag in BLOCKS:
            block_at.append(len(open_))
        marked += tag in _MARKED
        open_.append(child)
    return root


def surrounding(element: Element) -> bool:
    """Whether tag or attributes mark an element as no part of an article.

    Outside of article and main elements a telling word in a name is enough,
    unless such an element stands inside; within them only whole names count.
    """
    tag = element.tag
    if tag in DROPPED or tag == "header" and not element.inside:  # an article may have a header of its own
        return True
    if not element.attributes or tag in ("html", "body") or not _TELLING.search(element.attributes):
        return False
    named = False
    for name, *values in _ATTRIBUTE.findall(element.attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _INVISIBLE.search(value):
            return True
        if name == "role":
            named = named or bool(set(value.lower().split()) & ROLES)
        elif name in ("class", "id"):
            for word in value.split():
                if word.lower() == "hidden":
                    named = True
                elif element.inside and tag not in _MARKED:
                    named = named or word.lower().replace("_", "-") in NO_PART
                else:
                    parts = set(_WORD.findall(_CAMEL.sub(" ", word).lower()))
                    own = parts & (NO_ARTICLE if tag in _MARKED else SURROUNDINGS)
                    named = named or bool(own) and not parts & LAYOUT and any(not parts & PARTS.get(w, frozenset()) for w in own)
    return named and not element.holds


def _out(element: Element) -> bool:
    """surrounding(), found once; the page has been parsed."""
    if element.out is None:
        element.out = surrounding(element)
    return element.out


def _measure(root: Element) -> None:
    """The size of each element: its characters that are no white space and not in surroundings."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if not isinstance(c, str) and not _out(c)]
    for e in reversed(order):
        e.size = sum(c.size if not isinstance(c, str) else len(c.strip()) for c in e.children)


def _listed(element: Element) -> bool:
    return any(set(_WORD.findall("".join(values).lower())) & LISTED for name, *values in _ATTRIBUTE.findall(element.attributes) if name.lower() in ("class", "id"))


def article_root(root: Element) -> list[Element]:
    """Where the main text is: the outermost article elements or the main ones; else the body, or the page.

    Articles of a list count only where there is nothing else.  With a main
    element, it is one article that holds most of its text, else the main element.
    """
    found: dict[str, list[Element]] = {"article": [], "listed": [], "main": [], "body": []}
    _measure(root)
    stack = [(root, False, False)]
    while stack:
        e, in_article, in_main = stack.pop()
        if e.tag == "article" and not in_article:
            found["listed" if _listed(e) else "article"].append(e)
        elif e.tag == "main" and not in_main or e.tag == "body" and not found["body"]:
            found[e.tag].append(e)
        below = (in_article or e.tag == "article", in_main or e.tag == "main")
        stack += [(c, *below) for c in reversed(e.children) if not isinstance(c, str) and not _out(c)]
    size = {tag: sum(e.size for e in own) for tag, own in found.items()}
    if found["main"] and not (len(found["article"]) == 1 and size["article"] >= ARTICLE_SHARE * size["main"]):
        return found["main"]
    return found["article"] or found["listed"] or found["body"] or [root]


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def hash_tree(roots: list[Element]) -> list[Element]:
    """Hash every subtree of an article by its tags and text, white space made even and surroundings left out; the elements, children first."""
    order, stack = [], list(roots)
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if not isinstance(c, str) and not _out(c)]
    order.reverse()
    for e in order:
        inner = [e.tag]
        for c in e.children:
            if not isinstance(c, str):
                if not _out(c):
                    inner.append(f"\x00{c.hash}")
            elif text := " ".join(c.split()):
                inner.append(text)
        e.hash = _digest("\x02".join(inner))
    return order


def blocks(roots: list[Element], template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The blocks of text of an article, in page order, white space made one space, without template subtrees and surroundings."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            if text := _WHITE.sub(" ", entities.unescape("".join(line))).strip():
                out.append(text)
            line.clear()

    for start in roots:
        stack: list[Element | str | None] = [start]  # None: the end of a block
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                line.append(e)
            elif e is None:
                close()
            elif e is not start and (_out(e) or template and e.tag in BLOCKS and e.hash in template):
                if e.tag in BLOCKS:
                    close()
            elif e.tag in ("br", "wbr"):
                line.append("\n" if e.tag == "br" else "")
            else:
                if e.tag in BLOCKS:
                    close()
                    stack.append(None)
                stack += reversed(e.children)
        close()
    return out


def extract(page: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The main text of one page, blocks joined by line feeds."""
    if not page:
        return ""
    roots = article_root(parse(page))
    if template:
        hash_tree(roots)
    return "\n".join(blocks(roots, template))


def article_hashes(page: str | None) -> tuple[int, list[int]]:
    """The hash of a page's article, by which copies are one, and the different hashes of the block elements with text in it."""
    if not page:
        return 0, []
    roots = article_root(parse(page))
    order = hash_tree(roots)
    starts = set(map(id, roots))
    return _digest(" ".join(str(e.hash) for e in roots)), sorted({e.hash for e in order if e.size and e.tag in BLOCKS and id(e) not in starts})


def own_blocks(page: str, candidates: set[int]) -> tuple[int, list[tuple[bool, str]]]:
    """The hash of a page's article and its blocks: whether each stands outside of all candidates, and its text as written."""
    roots = article_root(parse(page))
    hash_tree(roots)
    starts, found = set(map(id, roots)), []
    stack = [(e, True) for e in roots]
    while stack:
        e, own = stack.pop()
        own = own and not (id(e) not in starts and e.tag in BLOCKS and e.hash in candidates)
        if text := " ".join(c for c in e.children if isinstance(c, str)).strip():
            found.append((own, text))
        stack += [(c, own) for c in e.children if not isinstance(c, str) and not _out(c)]
    return _digest(" ".join(str(e.hash) for e in roots)), found


_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_PLACES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_TURNS = mix(np.arange(1, MARKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def block_marks(texts: list[str]) -> np.ndarray:
    """The MARKS minimum hashes of the shingles of each text, a row each; texts of fewer words than a shingle are one."""
    data, offsets = utf8(pa.array([t + " x" * (not t.strip()) for t in texts], pa.large_string()))
    starts, ends, before = words(data, offsets, _SOLID)
    own = hash_runs(data, starts, ends)
    count = np.diff(before)
    padded = np.r_[own, np.zeros(SHINGLE, dtype=np.uint64)]
    row_end = np.repeat(before[1:], count)
    place, full = np.arange(len(own)), np.zeros(len(own), dtype=np.uint64)
    for k in range(SHINGLE):  # words beyond the row's end are none
        full += np.where(place + k < row_end, padded[k : k + len(own)], np.uint64(0)) * _PLACES[k]
    whole = (place + SHINGLE <= row_end) | (place == np.repeat(before[:-1], count))
    full, first = mix(full[whole]), np.searchsorted(np.flatnonzero(whole), before[:-1])
    return np.stack([np.minimum.reduceat(mix(full * turn), first) for turn in _TURNS], axis=1).view(np.int64) if len(texts) else np.zeros((0, MARKS), dtype=np.int64)


def host_of(url: object) -> object:
    """The lower-case host of a URL column; an empty text without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _near(table: DataFrame, numbers: int) -> DataFrame:
    """A table to be joined, broadcast if it holds few numbers."""
    return F.broadcast(table) if numbers <= BROADCAST_NUMBERS else table


def template_of(blocks_: DataFrame, candidates: DataFrame, number: int, min_articles: int = MIN_ARTICLES) -> DataFrame:
    """(host, hash) of the template, from the blocks of articles with candidates: (host, article, hashes, blocks of own, size and marks).

    An article with n near copies has its marks in n articles and counts as an nth of one.
    """
    each = blocks_.select("host", "article", F.posexplode("blocks").alias("place", "b")).select("host", "article", "b.own", "b.size", "b.marks")
    whole = each.groupBy("host", "article").agg(F.sum("size").alias("whole"), F.sum(F.when(F.col("own"), F.col("size")).otherwise(0)).alias("rest"))
    telling = whole.where((F.col("rest") > 0) & (F.col("rest") >= OWN_SHARE * F.col("whole"))).select("host", "article")
    marks = each.select("host", "article", "own", "size", F.explode("marks").alias("mark"))
    spread = marks.select("host", "article", "mark").distinct().groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    copies = marks.where("own").join(spread, ["host", "mark"]).groupBy("host", "article").agg(F.percentile("n", F.lit(0.5), F.col("size")).alias("copies"))
    weights = telling.join(copies, ["host", "article"]).select("host", "article", (1 / F.col("copies")).alias("weight"))
    nodes = blocks_.select("host", "article", F.explode("hashes").alias("hash")).join(_near(candidates, 2 * number), ["host", "hash"], "left_semi")
    support = nodes.join(weights, ["host", "article"]).groupBy("host", "hash").agg(F.sum("weight").alias("s"))
    return support.where(F.col("s") >= min_articles - 1e-6).select("host", "hash")


_BLOCK = "struct<own: boolean, size: long, marks: array<long>>"


def extract_text(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, min_articles: int = MIN_ARTICLES, text: str = "text") -> DataFrame:
    """The columns `keep` (all but the html, unless given) and the main text of each page; a column named like `text` is replaced.

    Null, empty and markup-only pages have an empty text.  A null or malformed
    URL belongs to the host "".  Repeated pages get equal texts and count once.
    Pages of any length and nesting are read whole, in time proportional to their
    length; an empty table gives an empty one.  Hashes are pre-aggregated inside
    tasks, so a host with a third of all pages is a sum over tasks and not a group
    in one of them.  Input columns named __html, __key and __template are lost.
    """
    text_batches(df.sparkSession)
    kept = [c for c in (keep if keep is not None else [c for c in df.columns if c != html]) if c not in (text, "__html", "__key", "__template")]
    host = host_of(F.col(url))
    keyed = df.select(host.alias("host"), F.col(html).alias("html"), F.xxhash64(host, F.col(html)).alias("key"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [article_hashes(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array([a for a, _ in got], pa.int64()), pa.array([h for _, h in got], pa.list_(pa.int64()))], names=["host", "key", "article", "hashes"])

    found = written(keyed.mapInArrow(hashes, "host string, key long, article long, hashes array<long>"), "subtrees")
    nodes = found.select("host", "article", F.explode("hashes").alias("hash")).distinct()
    candidates = written(nodes.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_articles).select("host", "hash"), "candidates")
    number = candidates.count()
    pages_with, numbers = None, 0
    if number:
        each = found.select("host", "article", "key", F.explode("hashes").alias("hash")).join(_near(candidates, 2 * number), ["host", "hash"], "left_semi")
        holding = written(each.groupBy("host", "article", "key").agg(F.collect_set("hash").alias("hashes")), "pages-with-candidates")
        # one page of each article tells what stands beside its candidates
        firsts = written(holding.groupBy("host", "article").agg(F.min(F.struct("key", "hashes")).alias("f")).select(F.col("f.key").alias("key"), F.col("f.hashes").alias("hashes")), "articles-with-candidates")
        size = firsts.agg(F.sum(F.size("hashes") + 1)).first()[0]

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [own_blocks(page, set(marks)) for page, marks in zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist(), strict=True)]
                texts = [t for _, own in got for _, t in own]
                marks = iter(block_marks(texts).tolist())
                rows = [[{"own": own, "size": len(t), "marks": next(marks)} for own, t in page] for _, page in got]
                kind = pa.list_(pa.struct([("own", pa.bool_()), ("size", pa.int64()), ("marks", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([a for a, _ in got], pa.int64()), batch.column("hashes"), pa.array(rows, kind)], names=["host", "article", "hashes", "blocks"])

        # first() of equal articles: their blocks are the same
        rows = keyed.join(_near(firsts, size), "key").select("host", "html", "hashes").mapInArrow(beside, f"host string, article long, hashes array<long>, blocks array<{_BLOCK}>")
        blocks_ = written(rows.groupBy("host", "article").agg(F.first("hashes").alias("hashes"), F.first("blocks").alias("blocks")), "blocks")
        template = written(template_of(blocks_, candidates, number, min_articles), "template")
        each = holding.select("host", "key", F.explode("hashes").alias("hash")).join(_near(template, 2 * template.count()), ["host", "hash"], "left_semi")
        pages_with = written(each.groupBy("key").agg(F.collect_set("hash").alias("__template")), "pages-with-template")
        numbers = pages_with.agg(F.sum(F.size("__template") + 1)).first()[0] or 0
    source = df.select(*kept, F.col(html).alias("__html"), F.xxhash64(host, F.col(html)).alias("__key"))
    if numbers:
        source = source.join(_near(pages_with.withColumnRenamed("key", "__key"), numbers), "__key", "left")
    else:
        source = source.withColumn("__template", F.lit(None).cast("array<long>"))
    schema = df.select(*kept).withColumn(text, F.lit("")).schema

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(page, frozenset(marks or ())) for page, marks in zip(batch.column("__html").to_pylist(), batch.column("__template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, pa.string())], names=[*kept, text])

    return source.mapInArrow(texts, schema)
