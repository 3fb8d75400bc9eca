"""A small lenient HTML parser: block-level trees with the text of each block.

Inline elements are part of their block's text; a block's own text is cut where a block inside it begins. Elements whose
content is not prose (scripts, styles, forms, ...) stay in the tree without text. Elements may be nested to any depth, and no
markup takes more than a time in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is text for the parser, up to the end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements whose content never is prose of the page.
MUTE = frozenset("script style textarea title noscript iframe noembed noframes template svg math canvas audio video object head select button datalist input meter progress map".split())
#: An open element of the first kind ends where a start tag of the second comes.
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
_STARTS = {n: _ENDS.get(n, set()) | ({"p"} if n in _CLOSES_P else set()) for n in _CLOSES_P | _ENDS.keys()}
_WALLS = frozenset("ul ol dl menu table td th div section article main aside nav footer header form body html blockquote figure fieldset select".split())

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|))*+)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: What no end follows swallows the rest.
_OPEN = re.compile(r"<[!?]")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attributes", "children", "link", "name", "parent", "texts")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        #: Block children and, between them, own text: strings and nodes in page order.
        self.children: list[Node | str] = []
        self.texts: list[str] = []
        self.link = 0

    def flush(self) -> None:
        if self.texts:
            text = _SPACE.sub(" ", entities.unescape("".join(self.texts))).strip()
            self.texts = []
            if text:
                self.children.append(text)

    def blocks(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def parse(html: str) -> Node:
    """The page as a tree of block-level nodes."""
    root = Node("#page", {}, None)
    stack: list[tuple[str, Node]] = [("#page", root)]  # inline elements stand for the block that they are in
    opened: defaultdict[str, int] = defaultdict(int)
    mute = links = 0
    at = 0

    def pop(to: int) -> None:
        nonlocal mute, links
        while len(stack) > to:
            name, node = stack.pop()
            opened[name] -= 1
            if name in INLINE:
                links -= name == "a"
            else:
                node.flush()
                mute -= name in MUTE

    def push(name: str, node: Node) -> None:
        stack.append((name, node))
        opened[name] += 1

    def add(text: str) -> None:
        if text and not mute:
            node = stack[-1][1]
            node.texts.append(text)
            if links:
                node.link += len(text)

    stop = html.rfind(">") + 1  # no tag ends later, so none is looked for from each start there
    while at < stop and (m := _TAG.search(html, at, stop)):
        add(html[at : m.start()])
        at = m.end()
        if at == stop and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>", "<!--->")):
            at = len(html)  # a comment without an end
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        pop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif name == "br":
                add(" ")
            elif opened[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        pop(i)
                        break
                    if name in ("p", "li", "dt", "dd") and stack[i][0] in _WALLS:
                        break
            continue
        if name in VOID:
            add(" ")
            if name == "hr":
                stack[-1][1].flush()
            continue
        if name in ("html", "body") and opened[name]:
            continue
        if name in INLINE:
            if name == "a":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "a":
                        pop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
                links += 1
            push(name, stack[-1][1])
            continue
        if name in _CLOSES_P or name in _ENDS:
            ends = _STARTS[name]
            for i in range(len(stack) - 1, 0, -1) if any([opened[e] for e in ends]) else ():
                if stack[i][0] in ends:
                    pop(i)
                    if "p" not in ends or len(ends) == 1:
                        break
                elif stack[i][0] in _WALLS:
                    break
        if name == "body" and opened["head"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "head":
                    pop(i)
                    break
        block = stack[-1][1]
        block.flush()
        attributes = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3] or "")} if m[3] and m[3].strip() else {}
        node = Node(name, attributes, block)
        block.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if m[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        push(name, node)
        mute += name in MUTE
    open_ = _OPEN.search(html, at)
    add(html[at : open_.start()] if open_ else html[at:])
    pop(0)
    root.flush()
    return root
