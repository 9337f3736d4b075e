"""Blocks of text of a page, with the place of each in the page's tree of styles."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import xxhash

#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of the main text.
APART = frozenset(
    "nav footer aside form script style noscript template iframe object button select textarea input label svg canvas "
    "head title menu dialog audio video map".split()
)
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id attributes that name what is not main text.
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay sidebar widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs topbar header masthead footer copyright disclaimer comment comments reply replies discussion "
    "disqus respond share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login search form pagination pager toolbar".split()
)
MAIN_ROLES = frozenset(("main", "article"))
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre table tbody thead tr td th figure figcaption".split())
#: An opening tag ends the open elements of the same group, up to the nearest of the fences.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("html body div article main section ul ol dl table td th nav aside footer header form blockquote".split())
_NAMES = re.compile("[a-z]+")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Element:
    tag: str
    path: int
    apart: bool
    main: bool
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    text: str
    feature: int
    main: bool
    kept: bool
    """Whether only text elements stand between it and the main element."""
    nodes: tuple[int, ...]
    """Paths of the elements around it, from the outermost in."""


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


def _apart(tag: str, attributes: dict[str, str | None], main: bool) -> bool:
    if tag in APART or (tag == "header" and not main):
        return True
    if tag in ("html", "body", "article", "main"):
        return bool(tag == "article" and "comment" in (attributes.get("class") or ""))
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style") or ""):
        return True
    if (attributes.get("role") or "").lower() in APART_ROLES:
        return True
    for name in ("class", "id"):
        words = set(_NAMES.findall(_CAMEL.sub(" ", attributes.get(name) or "").lower()))
        if words & APART_NAMES and not words & {"with", "has", "no"} and not (main and words <= {"header", *TEXT_ELEMENTS}):
            return True
    return False


class Page(HTMLParser):
    """Elements as paths of tags and classes; text in blocks, furniture left out. Missing end tags are made up for."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack = [Element("", 0, False, False)]
        self.blocks: list[Block] = []
        self.styles: list[tuple[int, int]] = []  # path, hash of the children's styles
        self.held: list[str] = []
        self.feed(html)
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._leave()

    def _flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            top = self.stack[-1]
            chain = tuple(e.path for e in self.stack[1:])
            inside = [e for e in self.stack if e.main]
            kept = bool(inside) and all(e.tag in TEXT_ELEMENTS for e in inside[1:])
            if not any(e.apart for e in self.stack):
                self.blocks.append(Block(text, _hash(top.path, text), top.main, kept, chain))

    def _leave(self) -> None:
        element = self.stack.pop()
        if not (element.apart or any(e.apart for e in self.stack)):
            self.styles.append((element.path, _hash(*element.children)))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = dict(attrs)
        if tag in ("br", "wbr", "img", "hr"):
            self.held.append(" " if tag != "wbr" else "")
            if tag == "hr":
                self._flush()
            return
        if tag in INLINE:
            apart = tag != "a" and _apart(tag, attributes, self.stack[-1].main)
            if not apart:
                return
        if tag in VOID:
            return
        self._flush()
        if tag not in INLINE:
            self._end_open(("p",), FENCES)
        if tag in CLOSES:
            self._end_open(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")) | {"article", "body"})
        parent = self.stack[-1]
        style = f"{tag}.{' '.join(sorted((attributes.get('class') or '').split()))}"
        parent.children.append(style)
        main = parent.main or tag in ("article", "main") or (attributes.get("role") or "").lower() in MAIN_ROLES
        main = main or (attributes.get("itemprop") or "").lower() == "articlebody"
        self.stack.append(Element(tag, _hash(parent.path, style), _apart(tag, attributes, parent.main), main))

    def _end_open(self, tags: tuple[str, ...], fences: frozenset) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self._leave()
                return
            if self.stack[k].tag in fences:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.held.append(" ")
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._flush()
                while len(self.stack) > k:
                    self._leave()
                return
            if tag == "p" and self.stack[k].tag in FENCES:
                break
        if tag not in INLINE:
            self._flush()

    def handle_data(self, data: str) -> None:
        self.held.append(data)
