"""A small element tree with text as ordered children, built from XML or HTML, well-formed or not."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree.ElementTree import ParseError, XMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        """An attribute by its local name."""
        for k, v in self.attrs.items():
            if k == name or k.endswith("}" + name) or k.endswith(":" + name):
                return v
        return None

    @property
    def classes(self) -> str:
        return self.get("class") or ""

    def nodes(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def walk(self) -> Iterator[Node]:
        """Itself and all nodes below in document order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([c for c in n.children if isinstance(c, Node)]))

    def find(self, *path: str) -> Node | None:
        """The first node along a path of child tags."""
        n: Node | None = self
        for tag in path:
            n = next((c for c in n.nodes() if c.tag == tag), None)
            if n is None:
                return None
        return n

    def first(self, test: Callable[[Node], bool] | str) -> Node | None:
        """The first node below that has the tag or passes the test."""
        ok = (lambda n: n.tag == test) if isinstance(test, str) else test
        return next((n for n in self.walk() if n is not self and ok(n)), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def without(self, test: Callable[[Node], bool]) -> Node:
        """A copy without the subtrees that pass the test; the text around them stays in its place."""
        root = Node(self.tag, self.attrs)
        stack = [(self, root)]
        while stack:
            old, new = stack.pop()
            for c in old.children:
                if isinstance(c, str):
                    new.children.append(c)
                elif not test(c):
                    copy = Node(c.tag, c.attrs)
                    new.children.append(copy)
                    stack.append((c, copy))
        return root


class _Target:
    """Receives expat's events."""

    def __init__(self):
        self.root, self.open = None, []

    def start(self, tag, attrs):
        n = Node(tag.rpartition("}")[2], dict(attrs))
        if self.open:
            self.open[-1].children.append(n)
        elif self.root is None:
            self.root = n
        self.open.append(n)

    def end(self, tag):
        self.open.pop()

    def data(self, text):
        if self.open:
            self.open[-1].children.append(text)

    def close(self):
        return self.root


class _Lenient(HTMLParser):
    """Builds what it can: unknown ends are ignored, missing ones implied."""

    def __init__(self, as_html: bool):
        super().__init__(convert_charrefs=True)
        self.html, self.root = as_html, Node("", {})
        self.open = [self.root]
        if not as_html:
            self.CDATA_CONTENT_ELEMENTS = self.RCDATA_CONTENT_ELEMENTS = ()

    def handle_starttag(self, tag, attrs):
        local = tag if self.html else tag.rpartition(":")[2]
        if self.html:
            if local in _BLOCK and any(n.tag == "p" for n in self.open):
                self.handle_endtag("p")
            while self.open[-1].tag in _CLOSES.get(local, ()):
                self.open.pop()
        n = Node(local, dict(attrs))
        self.open[-1].children.append(n)
        if not (self.html and local in _VOID):
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if not self.html and len(self.open) > depth:
            self.open.pop()

    def handle_endtag(self, tag):
        local = tag if self.html else tag.rpartition(":")[2]
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == local:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def _lenient(text: str, as_html: bool) -> Node | None:
    p = _Lenient(as_html)
    p.feed(text)
    p.close()
    return p.root if any(True for _ in p.root.nodes()) else None


_ENTITY = re.compile(rb"&([A-Za-z][A-Za-z0-9]*);")


def _numeric(m: re.Match) -> bytes:
    name = m.group(1).decode()
    if name in ("amp", "lt", "gt", "quot", "apos"):
        return m.group(0)
    return "".join(f"&#{ord(c)};" for c in html.unescape(f"&{name};") if c not in "&;" or len(name) < 2).encode() if f"{name};" in html.entities.html5 else b""


def parse_xml(data: bytes | str | None) -> Node | None:
    """The root of an XML document, repaired as far as possible; None if there is no element in it."""
    raw = (data.encode() if isinstance(data, str) else data) or b""
    raw = bytes(raw)
    target = _Target()
    parser = XMLParser(target=target)
    try:
        parser.feed(_ENTITY.sub(_numeric, raw))
        return parser.close()
    except (ParseError, ValueError, LookupError):
        root = _lenient(raw.decode("utf-8", "replace"), False)
        return next(root.nodes()) if root is not None else None


def parse_html(data: bytes | str | None) -> Node | None:
    """A node that holds an HTML page; None if there is no element in it."""
    text = bytes(data).decode("utf-8", "replace") if isinstance(data, (bytes, bytearray, memoryview)) else data or ""
    return _lenient(text, True)
