"""Blocks of text, block elements and their hashes in one HTML page.

A small helper without Spark: a forgiving reading of tags that closes what HTML lets authors leave open.
It never fails on bad markup, and works in one pass, so a page of n bytes needs memory of a few n.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary "
    "table tbody tfoot thead title tr ul".split()
)
CELLS = frozenset(["td", "th", "br", "option", "img", "input"])
#: Elements that hold a piece of running text rather than a part of the page.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption tr summary address".split())
WHOLE = frozenset(["html", "body", "main", "article"])
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
# What isn't article text, by element, by word of a class or id, and by role.
DROPPED = frozenset(
    "head script style title noscript template nav footer aside form button select textarea iframe object embed svg "
    "math canvas audio video map dialog menu search datalist noembed noframes xmp".split()
)
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar aside widget widgets ad ads advert "
    "adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promoted promotion cookie "
    "cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations comment comments disqus respond "
    "reply replies pagination pager toolbar topbar skip login search copyright disclaimer".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Kinds of DROPPED_WORDS and elements in which an article element isn't the page's own.
OTHER_VOICES = frozenset("aside sidebar widget widgets related recommended recommendations comment comments respond reply replies".split())
NEGATED = frozenset(["no", "not", "has", "with", "without"])

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")


class Block(NamedTuple):
    text: str
    ruled: bool  # menu, header, advert ... by element, class, id or role
    scope: int  # 3 in an article, 2 a main heading beside it, 1 in a main part, 0 elsewhere


class Element(NamedTuple):
    """A block element that may be part of the site's template, as the range of blocks it covers."""

    hash: int
    first: int
    end: int
    leaf: bool


class Page(NamedTuple):
    blocks: list[Block]
    elements: list[Element]
    has_article: bool
    has_main: bool


def _hash(parts: list[bytes]) -> bytes:
    return blake2b(b"\x1f".join(parts), digest_size=8).digest()


def class_words(value: str) -> list[str]:
    words = [w.lower() for w in _WORD.findall(value)]
    return [w for i, w in enumerate(words) if not (i and words[i - 1] in NEGATED)]


def _rules(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Is the element dropped by a rule; is what is in it another voice; is it the main part."""
    dropped, other = tag in DROPPED, tag == "aside"
    main = tag == "main"
    if tag == "header" and not in_main:
        dropped = True
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id") and tag != "main":
                words = class_words(unescape(value))
                dropped = dropped or not DROPPED_WORDS.isdisjoint(words) or ("header" in words and not in_main and tag not in ("h1", "article"))
                other = other or not OTHER_VOICES.isdisjoint(words)
            elif name == "role":
                role = value.lower()
                dropped = dropped or (role in DROPPED_ROLES and not (role == "banner" and in_main))
                main = main or role == "main"
            elif name == "itemprop":
                main = main or value.lower() == "articlebody"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                dropped = True
            elif name == "style" and _HIDDEN.search(value.lower()):
                dropped = True
    return dropped, other, main


class _Open:
    __slots__ = ("tag", "block", "parts", "first", "dropped", "other", "article", "main")

    def __init__(self, tag, block, first, dropped, other, article, main):
        self.tag, self.block, self.first = tag, block, first
        self.dropped, self.other, self.article, self.main = dropped, other, article, main
        self.parts: list[bytes] = []


def read_page(html: str) -> Page:
    blocks: list[Block] = []
    elements: list[Element] = []
    root = _Open("", True, 0, False, False, False, False)
    stack = [root]
    buffer: list[str] = []
    block_owner = root  # innermost open block element: it gets the hashes of its text
    seen_article = seen_main = False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                of = block_owner
                scope = 3 if of.article else 2 if of.main and of.tag == "h1" else 1 if of.main else 0
                blocks.append(Block(text, of.dropped, scope))
                block_owner.parts.append(text.encode("utf-8", "surrogatepass"))

    def close_to(depth: int) -> None:
        """Close all open elements from `depth` on."""
        nonlocal block_owner
        while len(stack) > depth:
            if stack[-1].block:
                flush()
                done = stack.pop()
                block_owner = next(o for o in reversed(stack) if o.block)
                if done.parts:
                    done.parts.append(done.tag.encode())
                    digest = _hash(done.parts)
                    block_owner.parts.append(digest)
                    covers = len(blocks) > done.first
                    leaf = done.tag in LEAVES
                    if covers and done.tag not in WHOLE and not (leaf and (done.article or done.main)):
                        elements.append(Element(int.from_bytes(digest, "little", signed=True), done.first, len(blocks), leaf))
            else:
                stack.pop()

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        to = found.start() if found else end
        if to > at and (block_owner.dropped or not stack[-1].dropped):
            text = html[at:to]
            buffer.append(unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                buffer.append(found[0][9:-3] if found[0].endswith("]]>") else found[0][9:])
            continue
        tag = tag.lower()
        if found[1]:
            if tag in CELLS:
                buffer.append(" ")
            block = tag in BLOCKS
            if block:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
                if not block and stack[depth].block:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag in CELLS:
            buffer.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            if tag in BLOCKS:
                flush()
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = closing.end() if closing else end
            continue
        block = tag in BLOCKS
        if block:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].block:
                    break
        if tag in CLOSED_BY:
            closes, within = CLOSED_BY[tag]
            lowest = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in within:
                    break
                if stack[depth].tag in closes:
                    lowest = depth
            if lowest:
                close_to(lowest)
        top = stack[-1]
        dropped, other, main = _rules(tag, found[3], top.main or top.article)
        article = tag == "article"
        if (article or main) and not dropped and not top.other and not (seen_article or (main and seen_main)):
            # The page's own article, also where a menu or advert before it was left open.
            inherited = False
        else:
            inherited = top.dropped
        own = not (inherited or dropped)
        if main and not block:
            flush()
            block = True
        seen_article = seen_article or (article and own)
        seen_main = seen_main or (main and own)
        element = _Open(
            tag, block, len(blocks), inherited or dropped, top.other or other, (top.article or article) and own, (top.main or main) and own
        )
        stack.append(element)
        if block:
            block_owner = element
    flush()
    close_to(1)
    return Page(blocks, elements, seen_article, seen_main)
