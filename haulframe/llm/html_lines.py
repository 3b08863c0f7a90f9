"""Text lines of an HTML page, each with the part of the page that its markup puts it in.

A line is what stands between two block boundaries, with character references decoded and white space
turned into single blanks. Markup may be broken: unclosed and stray tags, cut pages, unquoted attributes.
"""

from __future__ import annotations

import re
from html import unescape

OPEN, MAIN, ARTICLE, ASIDE = range(4)  # parts of a page; ASIDE is never main text

# Element names of the HTML standard, by what they mean for text.
_UNSEEN = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "canvas", "select", "button", "xmp"}
_ASIDE = {"nav", "footer", "aside", "form", "head", "dialog", "menu"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BREAKS = {"br", "hr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input",
}
_ONE_OPEN = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}  # closed by the next of its kind
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu"}
# words of class names and ids that mark what is no article
_ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "sidebar", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "disqus",
    "newsletter", "subscribe", "popup", "modal", "pagination", "pager", "related", "share", "sharing", "social", "skip",
}
_ASIDE_WORDS_OUTSIDE = {"header", "masthead", "banner", "menu", "nav", "topbar"}  # outside an article only

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_END = {name: re.compile(rf"</{name}(?=[\s/>])|\Z", re.I) for name in _UNSEEN}


def _part(name: str, attributes: str, around: int) -> int:
    """The part of the page that an element's text belongs to, inside the part ``around``."""
    if around == ASIDE or name in _ASIDE:
        return ASIDE
    inside = around == ARTICLE
    part = around
    if name == "article":
        part = ARTICLE
    elif name == "main":
        part = max(around, MAIN)
    elif name == "header" and not inside:
        return ASIDE
    if attributes and name not in ("html", "body"):
        for found in _NAMED.finditer(attributes):
            kind, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
            if kind == "role":
                if value in _ASIDE_ROLES and name not in ("article", "main"):
                    return ASIDE
                part = ARTICLE if value == "article" else max(part, MAIN) if value == "main" else part
            elif kind == "itemprop":
                part = ARTICLE if value == "articlebody" else part
            elif name != "main":
                words = set(re.split(r"[\s_-]+", value))
                if words & _ASIDE_WORDS or (not inside and name != "article" and words & _ASIDE_WORDS_OUTSIDE):
                    return ASIDE
    return part


def lines_of(html: str) -> list[tuple[str, int]]:
    """(text, part) of all lines of a page that are not empty, in order."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    part = OPEN

    def add(text: str) -> None:
        if text:
            held.append(unescape(text) if "&" in text else text)

    def close() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, part))

    def pop() -> None:
        name, _ = stack.pop()
        count[name] -= 1

    at, end = 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        if tag is None:
            add(html[at:])
            break
        add(html[at:tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:  # a comment or declaration
            continue
        ends, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        inline = name in _INLINE
        if not inline:
            close()
        if ends:
            if count.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
                around = stack[-1][1] if stack else OPEN
                if around != part:
                    close()
                part = around
            continue
        if name in _UNSEEN:
            if not attributes.endswith("/"):
                at = _END[name].search(html, at).start()
            continue
        if name in _VOID:
            continue
        if name == "body" and count.get("head"):
            while count["head"]:
                pop()
            part = stack[-1][1] if stack else OPEN
        if stack and not inline:
            top = stack[-1][0]
            if top == "p" or top == name and name in _ONE_OPEN or {top, name} == {"dt", "dd"} or {top, name} == {"td", "th"}:
                pop()
                part = stack[-1][1] if stack else OPEN
        own = _part(name, attributes, part)
        if inline and own == part and not count.get(name):
            continue  # a mark inside a line: nothing depends on where it ends
        if inline and own != part:
            close()
        stack.append((name, own))
        count[name] = count.get(name, 0) + 1
        part = own
    close()
    return out
