"""A small tolerant HTML reader: blocks of text, each with its enclosing elements.

One pattern finds tags, comments and raw-text elements; a stack of open
elements does the rest, with the implied ends that browsers apply.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
#: What a start tag ends first: (open elements it ends, elements where the search stops).
_LISTS = frozenset("ul ol menu dir".split())
_TABLE = frozenset(["table"])
_ENDS = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), _TABLE),
    "td": (frozenset(["td", "th"]), _TABLE | {"tr"}),
    "th": (frozenset(["td", "th"]), _TABLE | {"tr"}),
    "thead": (frozenset(["thead", "tbody", "tfoot"]), _TABLE),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), _TABLE),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), _TABLE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
_IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
#: An open paragraph ends where a block begins, but not through these.
_PARAGRAPH_STOPS = frozenset("article aside body button caption div figure footer form header html li main nav section table td th object".split())

#: Attributes up to the end of a tag. Every repeat is possessive, so no input makes the pattern try twice.
_ATTRS = r"(?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+"
#: What is still open at the end of the page takes the rest of it, as in browsers.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|--!>|\Z)|<(?P<raw>script|style|textarea|xmp|iframe|noembed|noframes)(?=[\s/>])(?P<rawattrs>{_ATTRS})(?:>(?P<body>.*?)(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?P<shut>>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.S)
SPACE = re.compile(r"[\s]+")


def attributes(text: str | None) -> dict[str, str]:
    if not text or not text.strip():
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class Element:
    __slots__ = ("tag", "attrs", "parent", "items", "digest")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[str | Element] = []  # text and elements in order
        self.digest = 0


def parse(source: str) -> Element:
    """The tree of a page under a root element without a tag.

    The places of open elements are known by tag, so neither an end tag without
    a start nor a block deep inside others searches the stack.
    """
    root = Element("", {}, None)
    stack, at = [root], 0
    places: dict[str, list[int]] = {}

    def close(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((w[-1] for t in tags if (w := places.get(t))), default=0)

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            stack[-1].items.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if raw := m["raw"]:
            inner = Element(raw.lower(), attributes(m["rawattrs"]), stack[-1])
            inner.items.append(m["body"] or "")
            stack[-1].items.append(inner)
            continue
        tag = m["tag"]
        if not tag or not m["shut"]:
            continue
        tag = tag.lower()
        if m["end"]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            floor = last(stops)
            if first := min((w[bisect_right(w, floor)] for t in ends if (w := places.get(t)) and w[-1] > floor), default=0):
                close(first)
        if tag in BLOCK and places.get("p") and places["p"][-1] > last(_PARAGRAPH_STOPS):
            close(places["p"][-1])
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        new = Element(tag, attributes(m["attrs"]), stack[-1])
        stack[-1].items.append(new)
        if tag not in VOID and not m["attrs"].endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(new)
    if at < len(source):
        stack[-1].items.append(html.unescape(source[at:]))
    return root
