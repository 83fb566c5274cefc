"""Pages as sequences of text blocks, each with the path of tags that leads to it.

A block is the text between two tags that break lines; inline tags (``b``, ``a``, ``span`` ...) don't end it. Tags need not be
closed or well nested: an end tag closes what is open inside it, one without a start is ignored, and ``p``, ``li``, ``td`` and their like are
closed by the next of their kind. Scripts, styles, titles and comments hold no text. Every scan moves forward only, so broken markup
costs no more than sound markup.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

#: HTML's inline and empty elements, and those whose content is not marked-up text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
#: A start tag of the key ends the open element of the listed kinds, looked for no further out than ``FENCES``.
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
ENDS = {**{t: ("p",) for t in _BLOCKS}, "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr",), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
FENCES = frozenset("html body table ul ol dl div section article aside main nav header footer form fieldset blockquote td th select button".split())

#: A path holds so many words at most, the innermost; a page may nest as deep as it likes.
PATH_WORDS = 64

_TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/><"'=]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)(>)?)""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


@dataclass
class Block:
    path: tuple[str, ...]   # a word for each tag, and for each word of its class, id or role, outermost first
    text: str
    linked: int             # characters inside links
    label: int = 0


def _words(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes and "=" in attributes:
        for _, a, b, c in _ATTRIBUTE.findall(attributes):
            out += ["." + w for w in _PART.findall((a or b or c).lower())]
    return tuple(out)


def _innermost(stack: list[tuple[str, tuple[str, ...]]], wanted) -> int:
    return next(k for k in range(len(stack) - 1, -1, -1) if wanted(stack[k][0]))


def blocks(html: str, labelled: bool = False) -> list[Block]:
    """The blocks of a page, in order. With ``labelled``, comments ``<!--y1-->`` and ``<!--y0-->`` set the label of the blocks that follow."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []   # open elements that break lines, each with its whole path
    now_open: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, label, at, size = 0, 0, 0, 0, len(html)
    nowhere: set[str] = set()  # what is known not to occur any more

    def find(what: str, start: int) -> int:
        if what in nowhere:
            return -1
        k = html.find(what, start)
        if k < 0:
            nowhere.add(what)
        return k

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            clean = " ".join(unescape("".join(parts)).split())
            if clean:
                out.append(Block(stack[-1][1] if stack else (), clean, min(linked, len(clean)), label))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        now_open.subtract(t for t, _ in stack[k:])
        del stack[k:]

    while at < size:
        begin = find("<", at)
        if begin < 0:
            break
        m = _TAG.match(html, begin)
        if m is None:
            text(html[at:begin + 1])
            at = begin + 1
            continue
        text(html[at:begin])
        if m[1]:
            stop = find("-->", begin + 4)
            if labelled and html[begin + 4:begin + 5] == "y":
                flush()
                label = int(html[begin + 5])
            at = size if stop < 0 else stop + 3
            continue
        if m[2]:
            stop = find(">", begin)
            at = size if stop < 0 else stop + 1
            continue
        tag, attributes, at = m[4].lower(), m[5], m.end()
        if not m[6]:  # a quoted value holds < or >, or the tag is broken off
            while at < size and html[at] != ">":
                quote = html[at]
                stop = find(quote, at + 1) if quote in "\"'" else -1
                at = stop + 1 if stop >= 0 else at + 1
            attributes, at = html[m.start(5):at], at + 1
        if m[3]:
            if tag == "a":
                links = 0
            if tag in INLINE:
                continue
            if now_open[tag]:
                flush()
                close(_innermost(stack, lambda t: t == tag))
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in RAW:
            flush()
            stop = None if tag in nowhere else _RAW_END[tag].search(html, at)
            if stop is None:
                at = size
                break
            stop = find(">", stop.end())
            at = size if stop < 0 else stop + 1
            continue
        if tag == "a":
            links = 1
        if tag in INLINE:
            continue
        flush()
        if tag in EMPTY:
            continue
        ends = ENDS.get(tag)
        if ends and any(now_open[e] for e in ends):
            k = _innermost(stack, lambda t: t in ends or t in FENCES)
            if stack[k][0] in ends:
                close(k)
        if not attributes.endswith("/"):
            links = 0
            stack.append((tag, (*(stack[-1][1] if stack else ()), *_words(tag, attributes))[-PATH_WORDS:]))
            now_open[tag] += 1
    if at < size:
        if find("<", at) < 0:
            text(html[at:])
    flush()
    return out
