"""HTML pages as trees of blocks, tolerant of unclosed, misnested and cut-off markup.

``parse`` reads tags with one pattern, keeps a stack of open elements, closes what
HTML closes by itself (paragraphs, list items, rows, cells, options) and ignores
end tags of what is not open.  Elements that are inline and carry no class, id or
role belong to the block around them.  Character references are decoded.  Nothing
recurses, no step walks the stack but to close what it passes, and a tag that never
ends is read once: as in HTML, the rest of the page is inside it.  Work is linear in
the page's length, whatever it holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: A value is quoted only right behind its "="; any other quote is a plain character.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|(?![\"'])))*+)>|<[!?][^>]*+>", re.S)
CUT = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Facts of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag closes an open element of the second set, if none of the third was opened since.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Never text of a page.
SILENT = frozenset("script style template noscript head title textarea select option iframe object svg math canvas audio video datalist".split())
SCOPES = frozenset("table td th article section div main aside nav header footer form ul ol blockquote body html".split())


@dataclass
class Page:
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    #: (node, text, whether inside a link); a node of -1 stands for a block border.
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)


def _attributes(text: str) -> tuple[list[str], int]:
    words, label = [], -1
    if text and not text.isspace():
        for name, a, b, c in ATTRIBUTE.findall(text):
            name = name.lower()
            if name in ("class", "id", "role"):
                words.extend(w.lower() for w in WORD.findall(a or b or c))
            elif name == "data-y":
                label = int(a or b or c)
    return words, label


def parse(html: str) -> Page:
    page = Page()
    parent, depth, tags, words, labels, pieces = page.parent, page.depth, page.tag, page.words, page.label, page.pieces

    def node(tag: str, above: int, own: list[str], label: int) -> int:
        parent.append(above)
        depth.append(depth[above] + 1 if above >= 0 else 0)
        tags.append(tag)
        words.append(own)
        labels.append(label if label >= 0 or above < 0 else labels[above])
        return len(tags) - 1

    root = node("#page", -1, [], 0)
    stack: list[tuple[str, int]] = []  # open elements with the node that their text belongs to
    opened: dict[str, list[int]] = {}  # places in the stack of each open element
    links = silent = 0
    at, begun, end, last = 0, 0, len(html), html.rfind(">")

    def close() -> None:
        nonlocal links, silent
        name, _ = stack.pop()
        opened[name].pop()
        links -= name == "a"
        silent -= name in SILENT
        if name not in INLINE:
            pieces.append((-1, "", False))

    def add(text: str) -> None:
        if text and not silent:
            pieces.append((stack[-1][1] if stack else root, unescape(text) if "&" in text else text, links > 0))

    def close_back(names: set[str], stop: set[str] | frozenset[str]) -> None:
        """Close the last open element of ``names``, unless one of ``stop`` was opened since."""
        place = max((opened[n][-1] for n in names if opened.get(n)), default=-1)
        if place >= 0 and all(opened[n][-1] < place for n in stop if opened.get(n)):
            while len(stack) > place:
                close()

    while at < end:
        at = html.find("<", at)
        m = TAG.match(html, at) if 0 <= at <= last or at >= 0 and html.startswith("<!--", at) else None
        if m is None:
            if at >= 0 and not (CUT.match(html, at) or at > last and html[at + 1 : at + 2] in ("/", "!", "?")):
                at += 1
                continue
            add(html[begun:at] if at >= 0 else html[begun:])  # a tag that never ends takes the rest of the page
            break
        add(html[begun:at])
        at = begun = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                while stack[-1][0] != name:
                    close()
                close()
            elif name == "p":
                pieces.append((-1, "", False))
            continue
        if name in CLOSES_P and opened.get("p"):
            close_back({"p"}, SCOPES)
        if name in CLOSES:
            close_back(*CLOSES[name])
        if name not in INLINE or name == "br":
            pieces.append((-1, "", False))
        if name in VOID:
            continue
        own, label = _attributes(m[3])
        above = stack[-1][1] if stack else root
        mine = above if name in INLINE and not own and label < 0 else node(name, above, own, label)
        stack.append((name, mine))
        opened.setdefault(name, []).append(len(stack) - 1)
        links += name == "a"
        silent += name in SILENT
        if name in RAW:
            done = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at, last + 1)  # an end tag before the last ">" ends
            at = begun = done.end() if done else end
            close()
        elif m[3].endswith("/") and name in ("svg", "path"):
            close()
    return page


def text_of(page: Page, kept: list[bool]) -> str:
    """Text of the kept nodes: white space in a block is one space, blocks are joined by one space."""
    parts = [" " if n < 0 else t for n, t, _ in page.pieces if n < 0 or kept[n]]
    return SPACE.sub(" ", "".join(parts)).strip()
