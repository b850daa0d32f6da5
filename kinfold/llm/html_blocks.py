"""Leaf blocks of an HTML page: text runs between block-level tags, with the path of tags that holds them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: A tag up to its end, with attributes as HTML reads them: quotes count only where a value starts, and an open one runs
#: on to the end of the page. Nothing is ever read twice.
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)))?+)*+)(>?)"""
)
_COMMENT_END = re.compile("--!?>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Tags without content, tags that stay within a block, and tags that a new one of the same kind ends (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
#: Elements whose content is no page text, those of them that only their end tag ends, and those that hold text alone.
DROPPED = frozenset("script style noscript template svg iframe object noembed noframes xmp math".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
TEXT_ONLY = frozenset("title textarea".split())
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in DROPPED | TEXT_ONLY}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())


#: Open elements that a page can have at most; as in browsers, what would lie deeper ends the innermost one.
DEPTH = 512


@dataclass
class Block:
    """text with single spaces, the names on its path (tags, and words of class, id and role), share of its text in links."""

    text: str
    path: tuple[str, ...]
    linked: float


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag's names: the tag itself, and the words of its class, id and role, marked as such."""
    found = ["<" + tag]
    if "=" in attributes:
        for groups in _NAMES.findall(attributes):
            found += ["." + w.lower() for w in _WORDS.findall("".join(groups))]
    return tuple(found)


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, "", "", "") and ("", slash, tag, attributes) in page order, in one pass over the page.

    As in HTML, a "<" starts a tag only before a letter, or a slash and a letter; a tag, comment or raw element that
    never ends takes the rest of the page with it.
    """
    start = at = 0
    absent: set[str] = set()
    while (i := page.find("<", at)) >= 0:
        m = _TAG.match(page, i)
        if m is None and page[i + 1 : i + 2] not in ("!", "?", "/"):
            at = i + 1  # a "<" of the text
            continue
        if start < i:
            yield page[start:i], "", "", ""
        if m is None:
            if page.startswith("<!--", i):
                end = i + 5 if page.startswith(">", i + 4) else i + 6 if page.startswith("->", i + 4) else e.end() if (e := _COMMENT_END.search(page, i + 4)) else 0
            else:
                end = page.find(">", i) + 1
            if not end:
                return
            start = at = end
            continue
        if not m[4]:
            return
        start = at = m.end()
        tag = m[2].lower()
        if not m[1] and tag in _ENDS and not (tag in ("svg", "math") and m[3].endswith("/")):
            close = None if tag in absent else _ENDS[tag].search(page, at)
            if close is None:
                absent.add(tag)
                if tag in RAW:
                    return
            elif tag in DROPPED:
                start = at = close.start()
                continue
            if tag in TEXT_ONLY:
                yield "", "", tag, m[3]
                at = close.start() if close else len(page)
                yield page[start:at], "", "", ""
                start = at
                continue
            if tag in DROPPED:
                continue
        if tag not in DROPPED:
            yield "", m[1], tag, m[3]
    if start < len(page):
        yield page[start:], "", "", ""


def blocks(page: str) -> list[Block]:
    """All leaf blocks of a page in order, boilerplate included; scripts, styles and comments are no text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    links = [0, 0]
    anchors = 0
    place: tuple[str, ...] = ()
    opened: dict[str, int] = {}

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def end_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, place, links[1] / max(1, links[0])))
            held.clear()
        links[:] = [0, 0]

    def add(raw: str) -> None:
        nonlocal place
        if raw:
            if not held or not place:
                place = tuple(n for tag, names in stack if tag not in INLINE for n in names)
            held.append(raw)
            links[0] += len(raw)
            links[1] += len(raw) if anchors else 0

    for text, slash, tag, attributes in tokens(page):
        if not tag:
            add(text)
            continue
        if tag in INLINE:
            if tag == "a":
                anchors = 0 if slash else 1
            if tag in ("input", "img"):
                add(" ")
            continue
        if tag == "br":
            if held:
                held.append(" ")
            continue
        end_block()
        anchors = 0
        if slash:
            if opened.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if stack and (stack[-1][0] == "p" and tag in ENDS_P or stack[-1][0] == tag and tag in ENDS_ITSELF):
            pop()
        if not attributes.endswith("/") or tag in ("p", "div"):
            if len(stack) == DEPTH:
                pop()
            stack.append((tag, names_of(tag, attributes)))
            opened[tag] = opened.get(tag, 0) + 1
    end_block()
    return out
