"""A small HTML tree and the selectors that run on it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element; ``children`` holds elements and strings."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attrs, self.children, self.parent = name, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order. A stack, not recursion: pages nest without limit."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack.extend(reversed(c.children))

    def text(self, separator: str = "", strip: bool = False) -> str:
        parts = [s.strip() if strip else s for s in self.strings()]
        return separator.join(p for p in parts if p or not strip)

    def first(self, name: str, **attrs: str) -> Node | None:
        return next((n for n in self.walk() if n.name == name and all(n.attrs.get(k) == v for k, v in attrs.items())), None)

    def every(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def html_length(self) -> int:
        """About the length of the element's own markup and text."""
        tags = sum(2 * len(n.name) + 5 + sum(len(k) + len(v) + 4 for k, v in n.attrs.items()) for n in [self, *self.walk()])
        return tags + sum(map(len, self.strings()))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.open = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = Node(tag, first, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open = self.open.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node is not self.root and node.name != tag:
            node = node.parent
        # An end tag without a start is passed over; one that skips open elements closes them.
        if node is not self.root:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        if data:
            self.open.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of any text; comments and declarations are left out."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def to_html(node: Node, without: Callable[[Node], bool] = lambda n: False) -> str:
    """The markup of an element and all below, but for elements ``without`` which it is asked for; of the document what is below only."""
    out, stack = [], [node]
    while stack:
        c = stack.pop()
        if isinstance(c, tuple):
            out.append(c[0])
        elif isinstance(c, str):
            out.append(escape(c, quote=False))
        elif not without(c):
            if c.name != "[document]":
                out.append(f"<{c.name}" + "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items()) + ">")
                if c.name in VOID:
                    continue
                stack.append((f"</{c.name}>",))
            stack.extend(reversed(c.children))
    return "".join(out).strip()


_SIMPLE = re.compile(
    r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<b>[^\s\]]+))\s*(?P<i>i)?\s*)?\]"""
)
_TESTS = {
    "=": lambda have, want: have == want,
    "*=": lambda have, want: want != "" and want in have,
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


class SelectorError(ValueError):
    """A selector outside the supported grammar."""


@lru_cache(maxsize=2000)
def compile_selector(text: str) -> list[list[tuple[str, list]]]:
    """Comma list of chains; a chain is (combinator, tests) from left to right. Tags, ids, classes, attributes, descendants and children."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", text):
        chain, combinator = [], " "
        for token in re.findall(r"""(?:\[[^\]]*\]|[^\s>\[])+|>""", alternative.strip()):
            if token == ">":
                combinator = ">"
                continue
            tests, at = [], 0
            while at < len(token):
                m = _SIMPLE.match(token, at) if at else _SIMPLE.match(token)
                if not m or m.end() == at or (m["tag"] and at):
                    raise SelectorError(text)
                tests.append(m)
                at = m.end()
            chain.append((combinator, [_test(m) for m in tests]))
            combinator = " "
        if not chain or combinator == ">":
            raise SelectorError(text)
        out.append(chain)
    return out


def _test(m: re.Match):
    if m["tag"]:
        name = m["tag"].lower()
        return lambda n: name == "*" or n.name == name
    if m["id"]:
        wanted = m["id"]
        return lambda n: n.attrs.get("id") == wanted
    if m["cls"]:
        wanted = m["cls"]
        return lambda n: wanted in n.classes()
    attr, op = m["attr"].lower(), m["op"]
    if not op:
        return lambda n: attr in n.attrs
    want = next(v for v in (m["d"], m["s"], m["b"]) if v is not None)
    if m["i"]:
        return lambda n: attr in n.attrs and _TESTS[op](n.attrs[attr].lower(), want.lower())
    return lambda n: attr in n.attrs and _TESTS[op](n.attrs[attr], want)


def _fits(node: Node, chain: list[tuple[str, list]]) -> bool:
    combinator, tests = chain[-1]
    if not all(t(node) for t in tests):
        return False
    if len(chain) == 1:
        return True
    above = [node.parent] if combinator == ">" and node.parent else [] if combinator == ">" else node.ancestors()
    return any(_fits(a, chain[:-1]) for a in above)


def select(root: Node, selector: str) -> list[Node]:
    chains = compile_selector(selector)
    return [n for n in root.walk() if any(_fits(n, c) for c in chains)]


def fits_any(node: Node, selectors: list[str]) -> bool:
    return any(_fits(node, c) for s in selectors for c in compile_selector(s))


def firsts(root: Node, selectors: list[str]) -> list[Node | None]:
    """The first match of each selector, found in one walk."""
    chains, found = [compile_selector(s) for s in selectors], [None] * len(selectors)
    for n in root.walk():
        for k, own in enumerate(chains):
            if found[k] is None and any(_fits(n, c) for c in own):
                found[k] = n
    return found


def select_first(root: Node, selector: str) -> Node | None:
    chains = compile_selector(selector)
    return next((n for n in root.walk() if any(_fits(n, c) for c in chains)), None)
