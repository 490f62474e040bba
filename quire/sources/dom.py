"""Document trees and their translatable blocks.

A strict reader (for packaged books) and a tolerant one (for raw pages) build the
same small tree. One walk from the leaves up gathers what every rule needs, so no
subtree is looked at twice.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from html.parser import HTMLParser

XHTML = "http://www.w3.org/1999/xhtml"
#: Tag classes and hints of the block rules.
HIDDEN = {"script", "style"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"p", "li", "blockquote", "dd", "div"}
STRUCTURES = {"table", "thead", "tbody", "tr", "th", "td", "caption", "ul", "ol", "dl", "img", "svg", "nav"}
HEADING_CLASSES = ("head", "title", "subhead")
BOLD_TAGS, BOLD_CLASSES = {"b", "strong"}, ("bold",)
BIBLIOGRAPHY = {"bibliography", "references", "works cited", "参考文献", "参考书目"}
MAX_HEADING_CHARS = 120
INLINE = {"a", "abbr", "b", "cite", "code", "em", "font", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags that a new block closes when pages leave them open, with what is open inside them.
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    def find(self, tag: str) -> Node | None:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                return node
            stack += reversed(node.children)
        return None


def local(name: str) -> str:
    return name.rpartition("}")[2].lower()


def from_xml(text: str) -> Node:
    """Raises ET.ParseError on what is no XML."""

    top = ET.fromstring(text)
    made = lambda e: Node(local(e.tag) if isinstance(e.tag, str) else "", {local(k): v for k, v in e.attrib.items()})
    root = made(top)
    stack = [(top, root)]  # trees may be deeper than Python's own stack
    while stack:
        e, node = stack.pop()
        if e.text and isinstance(e.tag, str):
            node.parts.append(e.text)
        for child in e:
            node.parts.append(made(child))
            stack.append((child, node.parts[-1]))
            if child.tail:
                node.parts.append(child.tail)
    return root


class _Pages(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        i = len(self.open) - 1
        while self.open[i].tag in INLINE:
            i -= 1
        if tag in CLOSED_BY.get(self.open[i].tag, ()):
            del self.open[i:]
        node = Node(tag, {local(k.rpartition(":")[2]): v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def from_html(text: str) -> Node:
    page = _Pages()
    page.feed(text)
    page.close()
    return page.root


def tidy(raw: str) -> str:
    """Lines with collapsed white space, without blank lines at either end."""
    return "\n".join(" ".join(line.split()) for line in raw.split("\n")).strip("\n")


def bold(node: Node) -> bool:
    return node.tag in BOLD_TAGS or any(h in node.attrs.get("class", "").lower() for h in BOLD_CLASSES)


def toc_nav(node: Node) -> bool:
    return node.tag == "nav" and ("toc" in node.attrs.get("type", "").lower().split() or "doc-toc" in node.attrs.get("role", "").lower().split())


def reads_as_heading(rest: str) -> bool:
    """What follows the bold part of a heading: punctuation, digits or capitals."""
    letters = [c for c in rest if c.isalpha()]
    return not letters or (any(c.lower() != c.upper() for c in letters) and rest.upper() == rest)


class Open:
    """A node on the way: what it stands in, and what the nodes below it told."""

    def __init__(self, node: Node, shut: bool, strong: bool, start: int):
        self.node, self.start = node, start
        self.dark = node.tag in HIDDEN
        self.shut = shut or self.dark or toc_nav(node)
        self.strong = strong or bold(node)
        self.has_bold = bold(node)
        self.tags: set[str] = set()
        self.inner_block = self.after_break = False
        self.rest, self.at = iter(node.parts), -1


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[int, ...]
    tag: str


def blocks(body: Node) -> list[Block]:
    """Leaf blocks of prose, in order: no headings, no scripts, no table of contents."""
    found: list[Block] = []
    # what is shown so far, piece by piece, and whether it stands in bold; a node's text
    # is a range of pieces, joined only for nodes that may be blocks
    pieces: list[tuple[str, bool]] = []

    def text_of(me: Open, bold_too: bool = True) -> str:
        return tidy("".join(p for p, strong in pieces[me.start :] if bold_too or not strong))

    def heading(me: Open, text: str) -> bool:
        if any(h in me.node.attrs.get("class", "").lower() for h in HEADING_CLASSES):
            return True
        plain = not me.tags & (BLOCKS | STRUCTURES | HEADINGS)
        return me.node.tag == "div" and len(text) <= MAX_HEADING_CHARS and me.has_bold and plain and reads_as_heading("".join(text_of(me, False).split()))

    def leave(me: Open, above: Open | None) -> None:
        node = me.node
        if me.dark:
            del pieces[me.start :]
        if node.tag in BLOCKS and not me.shut and not me.inner_block:
            text = text_of(me)
            if text and not heading(me, text) and not (node.tag == "div" and me.tags & STRUCTURES):
                found.append(Block(text, tuple(x.at for x in stack), node.tag))
        if above is None:
            return
        above.tags |= me.tags | {node.tag}
        above.has_bold |= me.has_bold
        above.inner_block |= me.inner_block or (node.tag in BLOCKS and any(p.strip() for p, _ in pieces[me.start :]))
        above.after_break = node.tag == "br"
        if above.after_break:
            pieces[me.start :] = [("\n", above.strong)]

    stack = [Open(body, False, False, 0)]
    while stack:
        me = stack[-1]
        part = next(me.rest, None)
        if part is None:
            leave(stack.pop(), stack[-1] if stack else None)
        elif isinstance(part, str):
            pieces.append((part.lstrip() if me.after_break else part, me.strong))
            me.after_break = False
        else:
            me.at += 1
            stack.append(Open(part, me.shut, me.strong, len(pieces)))
    return found


def shown(node: Node) -> str:
    """The text of a node as a reader sees it."""
    out: list[str] = []
    stack = [(node, iter(() if node.tag in HIDDEN else node.parts))]
    after_break = False
    while stack:
        part = next(stack[-1][1], None)
        if part is None:
            after_break = False
            stack.pop()
        elif isinstance(part, str):
            out.append(part.lstrip() if after_break else part)
            after_break = False
        elif part.tag == "br":
            out.append("\n")
            after_break = True
        else:
            after_break = False
            if part.tag not in HIDDEN:
                stack.append((part, iter(part.parts)))
    return "".join(out)


def is_bibliography(body: Node) -> bool:
    """Marked as one, or its only heading comes before any prose and is a known title."""
    if "bibliography" in body.attrs.get("type", "").split() or "doc-bibliography" in body.attrs.get("role", "").split():
        return True
    order: list[Node | str] = []
    stack = [(x, False) for x in reversed(body.parts)]  # a part, and whether it stands in a heading
    while stack:
        part, inside = stack.pop()
        if isinstance(part, str):
            order.extend([part] if part.strip() and not inside else [])
            continue
        if part.tag in HEADINGS:
            order.append(part)
        below = inside or part.tag in HEADINGS
        stack += [(x, below) for x in reversed(part.parts)]
    heads = [x for x in order if isinstance(x, Node)]
    return len(heads) == 1 and order[0] is heads[0] and tidy(shown(heads[0])).casefold() in BIBLIOGRAPHY


def is_toc_path(path: str | None) -> bool:
    name = (path or "").rpartition("/")[2].lower()
    return "toc" in name or "contents" in name


def book_blocks(xhtml: str, path: str | None) -> list[Block]:
    """Blocks of one document of a book; none for tables of contents, bibliographies
    and documents without a body."""
    if is_toc_path(path):
        return []
    body = from_xml(xhtml).find("body")
    return [] if body is None or is_bibliography(body) else blocks(body)


def page_blocks(html: str | None) -> list[Block]:
    root = from_html(html or "")
    return blocks(root.find("body") or root)


# ---------------------------------------------------------------- patching

STYLE_ID, TRANSLATION_CLASS = "quire-style", "quire-translation"
STYLE = f".{TRANSLATION_CLASS} {{ margin-top: 0.2em; }}"


def patch(xhtml: str, translations: list[str], path: str | None) -> str:
    """The document with each block's translation after it: inside its list item, as
    ``dd`` in a definition list, else as a paragraph. There must be one for each block."""
    found = book_blocks(xhtml, path)
    if len(found) != len(translations):
        raise ValueError(f"{path}: {len(found)} blocks and {len(translations)} translations")
    if not found:
        return xhtml
    ET.register_namespace("", XHTML)
    root = ET.fromstring(xhtml)
    body = next(e for e in root.iter() if isinstance(e.tag, str) and local(e.tag) == "body")
    space = body.tag.rpartition("}")[0] + "}" if "}" in body.tag else ""
    for block, text in reversed(list(zip(found, translations))):  # from the end, so that paths stay right
        parent, node = None, body
        for i in block.path:
            parent, node = node, node[i]
        if parent is None:
            continue
        nested = local(parent.tag) in ("ul", "ol")
        new = ET.Element(space + ("dd" if local(parent.tag) == "dl" else "p"), {"class": TRANSLATION_CLASS})
        first, *more = text.split("\n")
        new.text = first
        for line in more:
            ET.SubElement(new, space + "br").tail = line
        if nested:
            node.append(new)
        else:
            parent.insert(block.path[-1] + 1, new)
    head = next((e for e in root.iter() if isinstance(e.tag, str) and local(e.tag) == "head"), None)
    if head is not None and not any(local(e.tag) == "style" and e.get("id") == STYLE_ID for e in head if isinstance(e.tag, str)):
        ET.SubElement(head, space + "style", {"id": STYLE_ID, "type": "text/css"}).text = STYLE
    return ET.tostring(root, encoding="unicode")
