"""A small HTML tree on the standard library's parser, with the selectors that page adapters need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

#: Elements whose text is left out, and those that stand on lines of their own (fixed values).
DROPPED = frozenset({"script", "style", "nav", "footer", "header", "button", "form", "aside", "noscript"})
BLOCKS = frozenset({"address", "article", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "main", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: Elements that a start tag closes, which HTML lets authors leave open.
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPES = frozenset({"table", "ul", "ol", "dl", "div", "article", "section", "body"})


class Node:
    __slots__ = ("tag", "attrs", "children", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.children: list[Node | str] = []

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements inside, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def above(self) -> Iterator[Node]:
        n = self.up
        while n is not None:
            yield n
            n = n.up

    def all(self, selector: str) -> list[Node]:
        wanted = compiled(selector)
        return [n for n in self.walk() if any(fits(n, steps) for steps in wanted)]

    def one(self, *selectors: str) -> Node | None:
        """The first match of the first selector that has any."""
        for s in selectors:
            wanted = compiled(s)
            for n in self.walk():
                if any(fits(n, steps) for steps in wanted):
                    return n
        return None

    def drop(self) -> None:
        if self.up is not None:
            self.up.children = [c for c in self.up.children if c is not self]

    def raw(self) -> str:
        return "".join(c if isinstance(c, str) else c.raw() for c in self.children)

    def text(self) -> str:
        """H2: visible text, a line break only between blocks."""
        parts: list[str] = []
        todo: list[tuple[Node | str, bool]] = [(c, self.tag == "pre") for c in reversed(self.children)]
        while todo:
            n, pre = todo.pop()
            if isinstance(n, str):
                parts.append(n if pre else re.sub(r"\s+", " ", n))
            elif n.tag not in DROPPED:
                if n.tag in BLOCKS:
                    parts.append("\n")
                    todo.append(("\n", True))
                todo += [(c, pre or n.tag == "pre") for c in reversed(n.children)]
        return clean("".join(parts))


def clean(text: str) -> str:
    """H1: lines with single spaces, empty ones left out."""
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in text.splitlines())
    return "\n".join(x for x in lines if x)


def text_of(node: Node | None) -> str:
    return node.text() if node is not None else ""


STEP = re.compile(r"([>\s]*)((?:[\w-]+|\*)?(?:[.#][\w-]+|\[[^\]]+\])*)")
PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


@lru_cache(maxsize=512)
def compiled(selector: str) -> tuple:
    """Alternatives of steps (is child, tag, classes, attributes), outermost first."""
    out = []
    for alternative in selector.split(","):
        steps = []
        for m in STEP.finditer(alternative.strip()):
            if not m[2]:
                continue
            tag = re.match(r"[\w-]*", m[2])[0].lower()
            parts = PART.findall(m[2])
            attrs = [("id", i) for _, i, _, _ in parts if i] + [(a.lower(), v if f"{a}=" in m[2] else None) for _, _, a, v in parts if a]
            steps.append((">" in m[1], tag, tuple(c for c, _, _, _ in parts if c), tuple(attrs)))
        if steps:
            out.append(tuple(steps))
    return tuple(out)


def _own(n: Node, step: tuple) -> bool:
    _, tag, classes, attrs = step
    return (not tag or n.tag == tag) and (not classes or set(classes) <= set(n.classes)) and all(a in n.attrs and (v is None or n.attrs[a] == v) for a, v in attrs)


def fits(n: Node, steps: tuple) -> bool:
    if not _own(n, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-1][0]:
        return n.up is not None and fits(n.up, steps[:-1])
    return any(fits(a, steps[:-1]) for a in n.above())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#document", {}, None)

    def handle_starttag(self, tag, attrs):  # type: ignore[no-untyped-def]
        n = self.now
        while n.up is not None and tag in CLOSES and n.tag not in SCOPES - CLOSES[tag]:  # left open before
            if n.tag in CLOSES[tag]:
                self.now = n.up
                break
            n = n.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):  # type: ignore[no-untyped-def]
        self.now.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):  # type: ignore[no-untyped-def]
        n = self.now
        while n.up is not None:
            if n.tag == tag:
                self.now = n.up
                return
            n = n.up

    def handle_data(self, data):  # type: ignore[no-untyped-def]
        self.now.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root
