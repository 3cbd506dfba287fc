"""A tolerant reading of HTML into block nodes and pieces of text, for the main-text extractor."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
UNSEEN = set("head script style template noscript svg iframe object audio video canvas select textarea button title".split())
RAW = set("script style textarea title iframe noscript".split())
#: Blocks that hold text of their own; other blocks put loose text into a node without a name.
HOLDERS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary legend address".split())
GROUPS = set("html body div section main article aside nav header footer form fieldset ul ol menu dl table thead tbody tfoot tr figure details dialog center hgroup search".split())
BLOCKS = HOLDERS | GROUPS
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
#: An open element of these ends the search for one that a start tag closes.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Page:
    """Nodes in page order (each before its descendants), and pieces (node, block, text)."""

    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)

    def add(self, tag: str, tokens: tuple[str, ...], parent: int) -> int:
        k = len(self.tag)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.parent.append(parent)
        self.end.append(k + 1)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.at.append(self.children[parent] if parent >= 0 else 0)
        self.children.append(0)
        self.chars.append(0)
        self.linked.append(0)
        self.marks.append(0)
        if parent >= 0:
            self.children[parent] += 1
        return k


def attribute_tokens(text: str) -> tuple[str, ...]:
    """Words of the class, id, role and itemprop of a tag, lower-cased."""
    return tuple(t.lower() for m in NAMES.finditer(text) for t in TOKEN.findall(m[2])) if "=" in text else ()


def parse(html: str) -> Page:
    """The page's blocks. Start tags close what the language says they close, end tags without
    a start are passed over, and what is open at the end stays open. Inline elements belong to
    the block around them, unless they have attribute tokens: then they are nodes, too, but
    don't break the block."""
    page = Page()
    root = page.add("", (), -1)
    stack: list[tuple[str, int]] = [("", root)]  # name and node of the open elements
    block, unseen, links, loose, place = 0, 0, 0, -1, 0

    def holder(node: int) -> int:
        """The node that takes text written in ``node``."""
        nonlocal loose
        if page.tag[node] and page.tag[node] not in GROUPS:
            return node
        if loose < 0 or page.parent[loose] != node:
            loose = page.add("text", (), node)
        return loose

    def leave(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal unseen, links
        links -= sum(name == "a" for name, _ in stack[k:])
        unseen -= sum(name in UNSEEN for name, _ in stack[k:])
        del stack[k:]

    while True:
        m = MARKUP.search(html, place)
        if not unseen and (text := html[place:m.start() if m else len(html)]):
            node = stack[-1][1]
            if not text.isspace():
                node = holder(node)
                page.chars[node] += len(text)
                page.linked[node] += len(text) if links else 0
                page.marks[node] += sum(map(text.count, ".,;:!?"))
            page.pieces.append((node, block, text))
        if m is None:
            break
        place = m.end()
        if m[2] is None:
            continue
        name, rest = m[2].lower(), m[3]
        if name in VOID:
            if name in ("br", "hr") and not unseen:
                page.pieces.append((stack[-1][1], block, " "))
        elif m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    leave(k)
                    if name in BLOCKS:
                        block, loose = block + 1, -1
                    break
                if stack[k][0] in BLOCKS and name not in BLOCKS or stack[k][0] in ("td", "th") and name in HOLDERS:
                    break  # an inline end tag closes nothing beyond its block, nor a block's beyond its cell
        else:
            if name in BLOCKS:
                block, loose = block + 1, -1
                closed, scope = {"p"} | CLOSES.get(name, set()), SCOPES.get(name, GROUPS)
                lowest = len(stack)
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        lowest = k
                    elif stack[k][0] in scope:
                        break
                leave(lowest)
                if name in ("html", "body") and any(s[0] == name for s in stack):
                    continue
            node = stack[-1][1]
            if not unseen and name not in UNSEEN:
                tokens = attribute_tokens(rest) if rest else ()
                if name in BLOCKS:
                    node = page.add(name, tokens, node)
                elif tokens:
                    node = page.add(name, tokens, holder(node))
            links += name == "a"
            unseen += name in UNSEEN
            stack.append((name, node))
            if name in RAW:
                low = re.compile(f"</{name}", re.I).search(html, place)
                place = low.start() if low else len(html)
    for k in range(len(page.tag) - 1, 0, -1):
        page.end[page.parent[k]] = max(page.end[page.parent[k]], page.end[k])
    return page
