"""Main text of web pages: structure first, then site template removal.

Every element's subtree is hashed. Spark counts on how many distinct pages of a
host each subtree stands; those on a good part of them are the site's template
and are deleted, wherever they stand in the page, within a paragraph too. Pages
of a host with the same main text are one page, so copies of a page make no
template of its article. What HTML itself marks as no part of the article
(navigation, footers, forms, scripts, adverts, comments) goes page by page,
since such parts often differ from page to page. A class name, or the id of a
box, marks one if all its words do. An article without a heading of its own
gets the first heading that stands before it.

A page is parsed once, into a flat run of marks: where elements begin and end,
their hashes, and the texts between. Counts combine before their shuffle. A
host has few recurring subtrees: each stands on at least ``share`` of the
distinct pages, so there are at most 1/share times as many as a page has
elements on average. Where a page bears some, its text is put together without
them from the marks.

Defined results: a null or empty page gives an empty text; a null URL belongs
to the host ``''``; repeated pages each have their row, but count once for the
template, by the one with the least list of subtrees; a subtree on just
``share`` of the pages is template; pages of any length and depth are read, in
time that grows with their length; unclosed quotes end with the tag, and a tag,
comment or script that never ends takes the rest of the page; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .html_tree import BLOCK, SPACE, Element, parse
from .url_filter import host_and_path

#: A subtree is template on this share of a host's distinct pages, from this many distinct pages on.
SHARE = 0.5
LEAST_PAGES = 10

_DROP_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg canvas object embed button select textarea input dialog menu search audio video title annotation annotation-xml".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class names and ids that mark what is no part of an article.
_DROP_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored sponsors promo banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe signup signin login sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "comment comments commentlist disqus popup modal pagination pager toolbar copyright".split()
)
#: These say so of boxes only; on a paragraph, heading or phrase they may speak of its content.
_BOX_WORDS = frozenset(
    "promotion promoted notification alert subscription register rail discussion replies reply respond share sharing social related recommended recommendations popular trending overlay widget widgets skip".split()
)
_BOXES = frozenset("div section ul ol dl table figure details".split())
_HEADER_WORDS = frozenset(["header", "pageheader", "siteheader"])
#: Words that say where a part stands or how it is built: beside a word from above they change nothing, as in ``site-footer``.
_PLACE_WORDS = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer center big small sticky fixed first last box block bar wrap wrapper container content panel section row column col "
    "area list item items link links text title heading body inline mobile desktop form button icon label slot unit zone module component region group the my js is has".split()
)
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _dropped(e: Element, in_article: bool) -> bool:
    if e.tag in _DROP_TAGS:
        return True
    if e.tag == "header" and not in_article:
        return True
    a = e.attrs
    if not a or e.tag in ("body", "html"):
        return False
    if a.get("role", "").lower() in _DROP_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    # An id names what a heading or paragraph is about, as an anchor does; of a box it says what it is.
    names = a.get("class", "").split() + (a.get("id", "").split() if e.tag in _BOXES else [])
    if not names:
        return False
    marking = _DROP_WORDS | _BOX_WORDS if e.tag in _BOXES else _DROP_WORDS
    return any(_marks(n, marking) or not in_article and _marks(n, _HEADER_WORDS) for n in names)


@lru_cache(1 << 16)
def _marks(name: str, marking: frozenset[str]) -> bool:
    """Whether a name, taken whole, is one of these words: each of its parts is, or says a place, as in ``cookie-notice`` and not in ``notice-period``."""
    words = [w for w in _WORDS.findall(_CAMEL.sub(r"\1 \2", name).lower()) if not w.isdigit()]
    return any(w in marking for w in words) and all(w in marking or w in _PLACE_WORDS or w in _DROP_WORDS for w in words)


def _digest(e: Element) -> int:
    """Hash of tag, class and content; white space in text counts once."""
    parts = [e.tag, "\x01", e.attrs.get("class", "")]
    for x in e.items:
        parts.append("\x02" + SPACE.sub(" ", x).strip() if isinstance(x, str) else f"\x03{x.digest}")
    return xxhash.xxh3_64_intdigest("".join(parts).encode("utf-8", "surrogatepass"))


def _walk(root: Element):
    """All elements, children before parents."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [x for x in e.items if not isinstance(x, str)]
    return reversed(order)


def _articles(root: Element) -> list[Element]:
    """The outermost articles that aren't dropped; else main parts; else the page."""
    for want in (lambda e: e.tag == "article", lambda e: e.tag == "main" or e.attrs.get("role") == "main"):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if want(e):
                found.append(e)
                continue
            todo += [x for x in reversed(e.items) if not isinstance(x, str) and not _dropped(x, False)]
        if found:
            return found
    return [root]


def _title(root: Element, article: Element) -> Element | None:
    """The heading before an article that has none of its own, in the main part if there is one."""
    if any(e.tag == "h1" for e in _walk(article)):
        return None
    found, todo = None, [(root, False)]
    while todo:
        e, in_main = todo.pop()
        if e is article:
            return found
        if e.tag == "h1":
            found = e
            continue
        if e.tag == "main" and not in_main:
            in_main, found = True, None
        todo += [(x, in_main) for x in reversed(e.items) if not isinstance(x, str) and not _dropped(x, in_main)]
    return None


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


#: Elements that hold the article, so are no template themselves.
_FRAMES = frozenset(["html", "body", "article", "main"])


def read_page(source: str | None) -> tuple[str, list[int], list[str]]:
    """A page's main part: marks, hashes and texts.

    Marks: ``[`` and ``]`` around a block, ``(`` and ``)`` around an element
    within a line, ``t`` for a text, ``|`` where a block was dropped. Elements
    have a hash each, in order, texts likewise; the hash of a frame is 0.
    """
    if not source:
        return "", [], []
    root = parse(source)
    for e in _walk(root):
        e.digest = _digest(e)
    marks: list[str] = []
    hashes: list[int] = []
    texts: list[str] = []
    tops = _articles(root)
    title = _title(root, tops[0]) if tops[0].tag == "article" else None
    for top in tops if title is None else [title, *tops]:
        inside = top.tag in ("article", "main")
        todo: list = [("in", top)]
        while todo:
            kind, x = todo.pop()
            if kind == "text":
                marks.append("t")
                texts.append(x)
            elif kind == "mark":
                marks.append(x)
            elif x is not top and _dropped(x, inside):
                if x.tag in BLOCK:
                    marks.append("|")
            elif x.tag == "br":
                marks.append("t")
                texts.append(" ")
            else:
                block = x.tag in BLOCK or x is top
                marks.append("[" if block else "(")
                hashes.append(0 if x is top or x.tag in _FRAMES else _signed(x.digest))
                todo.append(("mark", "]" if block else ")"))
                todo += [("text", y) if isinstance(y, str) else ("in", y) for y in reversed(x.items)]
    return "".join(marks), hashes, texts


def join_text(marks: str, hashes: list[int], texts: list[str], gone=frozenset()) -> str:
    """The text of a page's marks without the subtrees whose hash is ``gone``."""
    blocks: list[str] = []
    run: list[str] = []
    hash_of, text_of = iter(hashes), iter(texts)
    deep = 0  # elements open within a subtree that goes
    for m in marks:
        if m == "t":
            text = next(text_of)
            if not deep:
                run.append(text)
            continue
        if m in "[(":
            goes = next(hash_of) in gone
            ends = not deep and m == "["
            deep += bool(deep) or goes
        elif m in "])":
            deep -= bool(deep)
            ends = not deep and m == "]"
        else:
            ends = not deep
        if ends and run:
            if text := SPACE.sub(" ", "".join(run)).strip():
                blocks.append(text)
            run = []
    if text := SPACE.sub(" ", "".join(run)).strip():
        blocks.append(text)
    return " ".join(blocks)


_PARSED = "page_id long, url string, marks string, hashes array<bigint>, texts array<string>, main long"


def _parse_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pages = [read_page(h) for h in part.column("html").to_pylist()]
            main = [_signed(xxhash.xxh3_64_intdigest(join_text(*p).encode("utf-8", "surrogatepass"))) for p in pages]
            columns = [pa.array([p[0] for p in pages], pa.string()), pa.array([p[1] for p in pages], pa.list_(pa.int64())), pa.array([p[2] for p in pages], pa.list_(pa.string())), pa.array(main, pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *columns], ["page_id", "url", "marks", "hashes", "texts", "main"])


def _text_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = zip(*(part.column(c).to_pylist() for c in ("marks", "hashes", "texts", "gone")))
            text = [join_text(m, h, t, frozenset(g or ())) for m, h, t, g in rows]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])


def site_templates(parsed: DataFrame, share: float, least_pages: int) -> DataFrame:
    """(host, template): hashes of the subtrees that recur on the host's distinct pages."""
    distinct = parsed.groupBy("host", "main").agg(F.min("hashes").alias("hashes"))
    # The 0 that is put to each page counts the host's pages.
    each = F.array_union(F.array(F.lit(0).cast("bigint")), "hashes")
    counts = materialize(distinct.select("host", F.explode(each).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages), "subtree-counts")
    sizes = counts.where("h = 0").select("host", F.col("n").alias("pages"))
    recurring = counts.where("h <> 0").join(sizes, "host").where(F.col("n") >= F.col("pages") * share)
    return materialize(recurring.groupBy("host").agg(F.collect_list("h").alias("template")), "site-templates")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    need = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host, _ = host_and_path(F.col("url"))
    parsed = materialize(need.mapInArrow(_parse_batches, _PARSED).withColumn("host", host), "parsed-pages")
    templates = site_templates(parsed, share, least_pages)
    gone = F.array_intersect("hashes", "template").alias("gone")
    out = parsed.drop("main").join(templates, "host", "left").select("page_id", "url", "marks", "hashes", "texts", gone)
    return out.mapInArrow(_text_batches, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
