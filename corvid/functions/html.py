"""HTML to text with the standard library's parser, as plain Python functions of one page.

These specify our own text form; they do not claim the bytes of any other converter.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "header", "footer", "nav", "aside", "body", "html", "form", "dl", "figure"}
HIDDEN = {"script", "style", "noscript", "template"}
#: Closed implicitly by the same tag.
SIBLING = {"li", "p", "td", "th", "tr", "dt", "dd", "option"}


class Node:
    """An element (tag, attrs, children) or, with tag None, a text."""

    __slots__ = ("tag", "attrs", "children", "text", "parent")

    def __init__(self, tag: str | None, attrs: dict | None = None, text: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.text, self.parent, self.children = tag, attrs or {}, text, parent, []

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        if tag in SIBLING and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, parent=self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(Node(None, text=data, parent=self.at))


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def select(root: Node, selector: str) -> Node | None:
    """First element of 'tag.class', '.class' (a div), '#id' or 'tag'; None if there is none."""
    if selector.startswith("#"):
        return next((n for n in root.walk() if n.attrs.get("id") == selector[1:]), None)
    tag, _, cls = selector.partition(".")
    tag = tag or "div"
    return next((n for n in root.walk() if n.tag == tag and (not cls or cls in n.classes)), None)


def drop(root: Node, tags: set[str]) -> Node:
    for n in list(root.walk()):
        n.children = [c for c in n.children if c.tag not in tags]
    return root


def text_of(node: Node, sep: str = "") -> str:
    """Texts below a node; with ``sep`` each is stripped and empty ones fall out."""
    texts = [n.text for n in node.walk() if n.tag is None and not (n.parent and n.parent.tag in HIDDEN)]
    return sep.join(t.strip() for t in texts if t.strip()) if sep else "".join(texts)


def markdown_of(node: Node) -> str:
    """Markdown-like text: headings, list marks, table rows and fenced code; links and images leave their text only."""
    out: list[str] = []

    def go(n: Node, pre: bool, depth: int) -> None:
        if n.tag is None:
            out.append(n.text if pre else re.sub(r"\s+", " ", n.text))
            return
        if n.tag in HIDDEN or n.tag == "img":
            return
        if re.fullmatch("h[1-6]", n.tag or ""):
            out.append("\n\n" + "#" * int(n.tag[1]) + " ")
        elif n.tag == "li":
            out.append("\n" + "  " * max(0, depth - 1) + "* ")
        elif n.tag == "tr":
            out.append("\n")
        elif n.tag in ("td", "th"):
            out.append("| ")
        elif n.tag == "br":
            out.append("\n")
        elif n.tag == "pre":
            out.append("\n\n```\n")
        elif n.tag == "code" and not pre:
            out.append("`")
        elif n.tag in BLOCK:
            out.append("\n\n")
        for c in n.children:
            go(c, pre or n.tag == "pre", depth + (n.tag in ("ul", "ol")))
        if n.tag == "pre":
            out.append("\n```\n\n")
        elif n.tag == "code" and not pre:
            out.append("`")
        elif n.tag == "tr":
            out.append("|")
        elif n.tag in ("td", "th"):
            out.append(" ")
        elif re.fullmatch("h[1-6]", n.tag or "") or n.tag in BLOCK:
            out.append("\n\n")

    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        go(node, False, 0)
    finally:
        sys.setrecursionlimit(limit)
    text = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def page_content(html: str | None, selectors=("main", "div.td-content", "div.content", "#content", "article", "div.main-content")) -> str:
    """The crawler's page text: the first selector that hits, else the body; without scripts, styles, nav, header
    and footer; lines of more than ten characters joined by blank lines."""
    root = parse(html)
    region = next((r for r in (select(root, s) for s in selectors) if r), None) or select(root, "body") or root
    drop(region, {"script", "style", "nav", "header", "footer"})
    lines = (x.strip() for x in text_of(region, "\n").split("\n"))
    return "\n\n".join(x for x in lines if len(x) > 10)
