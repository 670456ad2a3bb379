"""A small document tree over the standard library's HTML parser: enough for evidence, no more.

An end tag closes everything down to its match; tags that never have content have none. Nothing is
closed implicitly, so an unclosed <b> holds what follows it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Text(str):
    """A string of the document with its parent; comment tells comments and declarations apart."""

    parent: Node
    comment = False


class Node:
    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | Text] = []

    def get(self, key: str, default: str = "") -> str:
        return self.attributes.get(key, default)

    def walk(self) -> Iterator[Node | Text]:
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            yield item
            if isinstance(item, Node):
                stack.extend(reversed(item.children))

    def all(self, *names: str) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node) and x.name in names)

    def strings(self, comments: bool = False) -> Iterator[Text]:
        return (x for x in self.walk() if isinstance(x, Text) and (comments or not x.comment))

    def text(self) -> str:
        return " ".join(x for x in (str(s).strip() for s in self.strings()) if x)

    def up(self) -> Iterator[Node]:
        at: Node | None = self
        while at is not None:
            yield at
            at = at.parent

    @property
    def marks(self) -> str:
        return f"{self.get('id')} {self.get('class')}"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        for node in self.at.up():
            if node.name == tag and node.parent is not None:
                self.at = node.parent
                return

    def _string(self, data: str, comment: bool) -> None:
        item = Text(data)
        item.parent, item.comment = self.at, comment
        self.at.children.append(item)

    def handle_data(self, data: str) -> None:
        self._string(data, False)

    def handle_comment(self, data: str) -> None:
        self._string(data, True)

    def handle_decl(self, decl: str) -> None:
        self._string(decl, True)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
