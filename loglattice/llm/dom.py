"""A small reader of HTML for one page: a tree of blocks, runs and texts that survives what pages get wrong.

It follows the rules that matter for where text stands: elements without an end, ends that are left out (paragraphs, items,
cells), raw text of scripts and styles, character references. Reading is linear in the page.
"""

from __future__ import annotations

import html
import re

#: Fixed by HTML: elements without content, elements whose content is raw text, elements that stay inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture".split())
#: A start of one of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split()
)
#: element: (elements that its start ends, elements beyond which it does not look)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "body": (("head",), ()),
}
#: Elements nested deeper than this become siblings, as in browsers.
DEPTH = 150

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|</[^>]*>", re.S)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Text:
    """A run of text; ``norm`` has its white space as single spaces and is empty for white space alone."""

    __slots__ = ("text", "norm", "number", "shape", "whole")
    tag = label = "#text"

    def __init__(self, text: str):
        self.text, self.norm = text, " ".join(text.split())
        self.number = self.shape = self.whole = -1


class Node:
    """An element; ``kids`` are nodes and texts in order, ``names`` the words of class and id in lower case."""

    __slots__ = ("tag", "kids", "names", "role", "label", "number", "shape", "whole")

    def __init__(self, tag: str):
        self.tag, self.kids, self.names, self.role, self.label = tag, [], (), "", tag
        self.number = self.shape = self.whole = -1


def _read_attributes(node: Node, raw: str) -> None:
    names: list[str] = []
    for m in _ATTRIBUTE.finditer(raw):
        key = m.group(1).lower()
        if key in ("class", "id", "role", "itemprop", "aria-hidden", "hidden"):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id"):
                names += (x.lower() for x in _WORD.findall(value))
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                node.role = "hidden"
            elif not node.role:
                node.role = value.lower()
    if names:
        node.names = tuple(dict.fromkeys(names))
        node.label = node.tag + "." + ".".join(node.names)


def parse(page: str) -> Node:
    """The tree of a page under a root of its own."""
    root = Node("#root")
    stack = [root]
    # What follows the last ">" cannot hold a whole tag: a tag cut off there goes, as in browsers. So each search below ends soon.
    at, end = 0, page.rfind(">") + 1
    tail = _CUT_OFF.split(page[end:], maxsplit=1)[0]
    search = _TOKEN.search
    while at < end:
        m = search(page, at, end)
        if m is None:
            _add_text(stack[-1], page[at:end])
            break
        if m.start() > at:
            _add_text(stack[-1], page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            _close(stack, tag)
            continue
        node = _open(stack, tag, m.group(3))
        if tag in RAW and not m.group(3).endswith("/"):
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag in ("title", "textarea"):
                _add_text(node, page[at : found.start() if found else end])
            at = found.end() if found else end
            if not found:
                tail = ""
            if stack[-1] is node:
                stack.pop()
    if tail:
        _add_text(stack[-1], tail)
    return root


def _add_text(node: Node, raw: str) -> None:
    node.kids.append(Text(html.unescape(raw) if "&" in raw else raw))


def _open(stack: list[Node], tag: str, raw: str) -> Node:
    if tag in ENDS_P:
        _end_paragraph(stack)
    if tag in ENDS:
        ended, beyond = ENDS[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ended:
                del stack[k:]
                if tag != "tr":
                    break
            elif stack[k].tag in beyond:
                break
    node = Node(tag)
    if raw and not raw.isspace():
        _read_attributes(node, raw)
    stack[-1].kids.append(node)
    if tag not in VOID and len(stack) < DEPTH:
        stack.append(node)
    return node


def _end_paragraph(stack: list[Node]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        tag = stack[k].tag
        if tag == "p":
            del stack[k:]
            return
        if tag not in INLINE:
            return


def _close(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].kids.append(Node("br"))
        return
    inline = tag in INLINE
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if inline and stack[k].tag not in INLINE:  # an end of a run does not end the block that began inside it
            return
        if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main"):
            return
