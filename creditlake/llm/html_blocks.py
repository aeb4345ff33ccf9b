"""HTML to leaf blocks: the text between block-level tags, with the tag path
of its first character and the share of it inside links.

A forgiving reader for raw pages: comments, scripts, styles and other raw
elements vanish, unclosed elements end where a block or an ancestor ends, a
missing end tag or a cut page is no error; an empty-element tag such as
``<svg/>`` has no content (of scripts and other text elements in XHTML pages
only).  Character references are decoded
and white space inside a block is one space.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: fixed lists of HTML element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|object|svg|math|canvas|title|textarea"
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: an opening tag of these ends an open one of the second kind
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table select body html".split())

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?:{RAW})(?=[\s/>])[^>]*>.*?(?:</(?:{RAW})\s*>|\Z)|<[!?][^>]*>?"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>?""",
    re.S | re.I)
RAW_OPEN = re.compile(rf"""<({RAW})(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+>)?""", re.I)
#: an unquoted value takes the slash
EMPTY = re.compile(r"""(?<!=)/\s*>\Z""")
UNQUOTED = re.compile(r"""=\s*[^\s"'>]+>\Z""")
EMPTY_RAW = frozenset("svg math object iframe".split())
XHTML = re.compile(r"""<\?xml\b|<!doctype\b[^>]*\bxhtml\b|<html\b[^>]*\bxmlns\s*=\s*["']?http://www\.w3\.org/1999/xhtml""", re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]     # per open element its tag and its class, id and role words
    link_chars: int


def _is_xhtml(html: str) -> bool:
    """By what stands up to the first start tag, this one included."""
    at = 0
    while (lt := html.find("<", at)) >= 0:
        m = TOKEN.match(html, lt)
        at = m.end() if m else lt + 1
        if m and (m[2] or m[5] or RAW_OPEN.match(html, lt)):
            break
    return bool(XHTML.search(html, 0, at))


def _raw_end(html: str, m: re.Match) -> int | None:
    """A raw element ends at its own end tag, not at another raw element's."""
    name = RAW_OPEN.match(html, m.start())
    if not name:
        return None
    rest = name[2] or ""
    if EMPTY.search(rest) and not UNQUOTED.search(rest) and (name[1].lower() in EMPTY_RAW or _is_xhtml(html)):
        return name.end()
    end = re.compile(rf"</{name[1]}\s*>", re.I).search(html, m.start())
    return end.end() if end else len(html)


def _element(tag: str, attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return tag
    words = [w for g in NAMES.findall(attributes) for w in re.split(r"[^a-z0-9]+", "".join(g).lower()) if w]
    return " ".join([tag, *words])


def blocks(html: str | None) -> list[Block]:
    """Blocks with some text, in page order."""
    out: list[Block] = []
    names: list[str] = []
    stack: list[str] = []
    text: list[str] = []
    path: tuple[str, ...] = ()
    links = in_link = 0

    def flush():
        nonlocal links
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, path, links))
            text.clear()
        links = 0

    def add(s):
        nonlocal path, links
        if not text:
            if s.isspace():
                return
            path = tuple(stack)
        text.append(s)
        if in_link:
            links += len(s)

    html = html or ""
    at = 0
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        m = TOKEN.match(html, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            at = _raw_end(html, m) or at
            continue
        closing = m[1] or m[4]
        if tag in BLOCK:
            flush()
        elif tag == "br":
            if text:
                text.append(" ")
        if closing:
            if tag in names:
                while names:
                    gone = names.pop()
                    stack.pop()
                    in_link -= gone == "a"
                    if gone == tag:
                        break
        elif tag not in VOID:
            ends = ENDS.get(tag, frozenset()) | ({"p"} if tag in BLOCK else frozenset())
            if ends:
                for k in range(len(names) - 1, -1, -1):
                    if names[k] in ends:
                        in_link -= names[k:].count("a")
                        del names[k:], stack[k:]
                        break
                    if names[k] in SCOPES:
                        break
            names.append(tag)
            stack.append(_element(tag, m[3] if m[2] else m[6]))
            in_link += tag == "a"
    flush()
    return out
