"""Per-page helper run inside tasks: find marked elements of one page and read their texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without an end tag, and elements whose content is not text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}


@dataclass(frozen=True)
class Selector:
    """An element test: tag name, and an attribute that equals, contains or just exists."""

    tag: str | None = None
    attr: str | None = None
    equals: str | None = None
    contains: str | None = None
    also: "Selector | None" = None
    text: str | None = None

    def hits(self, node: "Node") -> bool:
        if self.tag and node.tag != self.tag:
            return False
        if self.attr:
            value = node.attrs.get(self.attr)
            if value is None or (self.equals is not None and value != self.equals):
                return False
            if self.contains is not None and self.contains not in value:
                return False
        if self.text and not re.match(self.text, node.joined(), re.IGNORECASE):
            return False
        return self.also is None or self.also.hits(node)


@dataclass(frozen=True)
class Field:
    """A value of a card: the first alternative found, each a path of selectors.

    An empty path is the card itself. ``take`` names an attribute to read, or ``#count``
    for the number of elements found; otherwise the text is read.
    """

    name: str
    paths: tuple[tuple[Selector, ...], ...]
    take: str | None = None
    glue: str = ""


@dataclass(frozen=True)
class Profile:
    """How a page's cards are marked up. ``page_fields`` are read once per page."""

    cards: tuple[Selector, ...]
    fields: tuple[Field, ...]
    page_fields: tuple[Field, ...] = ()
    required: str = "text_positive"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    content: list = field(default_factory=list)

    def walk(self):
        """Descendants in document order."""
        stack = [c for c in reversed(self.content) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.content) if isinstance(c, Node))

    def texts(self):
        """Stripped, non-blank texts in document order."""
        stack = list(reversed(self.content))
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                if item.tag not in SILENT:
                    stack.extend(reversed(item.content))
            elif item.strip():
                yield item.strip()

    def joined(self, glue: str = "") -> str:
        return glue.join(self.texts())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].content.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].content.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].content.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _find(start: Node, path: tuple[Selector, ...]) -> list[Node]:
    found = [start]
    for step, selector in enumerate(path):
        matches = [n for f in found for n in f.walk() if selector.hits(n)]
        found = matches[:1] if step < len(path) - 1 else matches
    return found


def read_field(start: Node, spec: Field) -> str | None:
    for path in spec.paths:
        found = _find(start, path)
        if spec.take == "#count":
            if found:
                return str(len(found))
        elif found and spec.take:
            if spec.take in found[0].attrs:
                return found[0].attrs[spec.take]
        elif found:
            return found[0].joined(spec.glue)
    return None


def read_cards(html: str | None, profile: Profile) -> list[dict[str, str | None]]:
    """One dict per card with the required field; a card that fails is left out alone, a page that is no markup has none."""
    if not html:
        return []
    try:
        page = parse(html)
    except (ValueError, AssertionError, RecursionError):  # as the parser raises for broken declarations
        return []
    cards: list[Node] = []
    for selector in profile.cards:
        cards = _find(page, (selector,))
        if cards:
            break
    shared = {f.name: read_field(page, f) for f in profile.page_fields}
    out = []
    for card in cards:
        try:
            row = {**shared, **{f.name: read_field(card, f) for f in profile.fields}}
        except (ValueError, AttributeError, RecursionError):
            continue
        if row.get(profile.required):
            out.append(row)
    return out
