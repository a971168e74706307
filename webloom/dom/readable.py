"""Readability: the part of a page that reads like an article, found by scoring its paragraphs on the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from webloom.dom.tree import Node

# Words in ids and classes, and element names, that speak for or against text to read.
UNLIKELY = re.compile(r"combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter", re.IGNORECASE)
MAYBE = re.compile(r"and|article|body|column|main|shadow", re.IGNORECASE)
POSITIVE = re.compile(r"article|body|content|entry|hentry|main|page|pagination|post|text|blog|story", re.IGNORECASE)
NEGATIVE = re.compile(r"combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget", re.IGNORECASE)
NAME_SCORES = {name: 5 for name in ("div", "article")} | {name: 3 for name in ("pre", "td", "blockquote")}
NAME_SCORES |= {name: -3 for name in "address ol ul dl dd dt li form aside".split()} | {name: -5 for name in "h1 h2 h3 h4 h5 h6 th header footer nav".split()}
#: Elements that make what holds them more than a paragraph.
BLOCKS = frozenset("a blockquote dl div img ol p pre table ul article section".split())
SILENT = frozenset("script style noscript template head title".split())
#: Words that a summary needs to be taken, characters that a paragraph needs to count, and a result under which unlikely elements get another chance.
LEAST_WORDS, LEAST_CHARS, RETRY_CHARS = 80, 25, 250


def weight(node: Node) -> int:
    """25 for each of class and id that speaks for the element, less 25 for each that speaks against it."""
    out = 0
    for value in (node.attrs.get("class"), node.attrs.get("id")):
        if value:
            out += 25 * bool(POSITIVE.search(value)) - 25 * bool(NEGATIVE.search(value))
    return out


def unlikely(node: Node) -> bool:
    named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return len(named) > 1 and node.name not in ("html", "body", "article") and bool(UNLIKELY.search(named)) and not MAYBE.search(named)


@dataclass
class Measure:
    """Of an element and all below: characters without repeated white space, those in links, and commas."""

    chars: int = 0
    linked: int = 0
    commas: int = 0

    def density(self) -> float:
        return self.linked / max(1, self.chars)


def after_children(root: Node, out: set[int]) -> Iterator[Node]:
    """Elements of ``root`` but for those in ``out`` and what they hold, children before what holds them."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            yield node
        elif id(node) not in out and node.name not in SILENT:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))


def measures(root: Node, out: set[int]) -> dict[int, Measure]:
    """All elements' measures by one walk; links within links count once."""
    found: dict[int, Measure] = {}
    for node in after_children(root, out):
        own = Measure()
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                own.chars += len(text)
                own.commas += text.count(",")
            elif id(c) in found:
                below = found[id(c)]
                own.chars, own.linked, own.commas = own.chars + below.chars, own.linked + below.linked, own.commas + below.commas
        if node.name == "a":
            own.linked = own.chars
        found[id(node)] = own
    return found


def is_paragraph(node: Node) -> bool:
    """Elements that hold text themselves: paragraphs, cells, and boxes without blocks inside."""
    if node.name in ("p", "pre", "td", "blockquote"):
        return True
    return node.name in ("div", "section", "article") and not any(isinstance(c, Node) and c.name in BLOCKS for c in node.children)


def scores(root: Node, measured: dict[int, Measure], out: set[int]) -> dict[int, float]:
    """Candidates by id of the element. A paragraph gives its points to its parent and half of them to its grandparent; names and
    words in classes count once an element; then links take their share off."""
    found: dict[int, tuple[Node, float]] = {}
    for node in after_children(root, out):
        own = measured[id(node)]
        if not is_paragraph(node) or own.chars < LEAST_CHARS or node.parent is None:
            continue
        points = 1 + own.commas + 1 + min(own.chars // 100, 3)
        for above, share in ((node.parent, 1), (node.parent.parent, 2)):
            if above is not None and id(above) in measured and above.name != "[document]":
                start = found[id(above)][1] if id(above) in found else NAME_SCORES.get(above.name, 0) + weight(above)
                found[id(above)] = (above, start + points / share)
    return {key: score * (1 - measured[key].density()) for key, (_, score) in found.items()}


def joined(best: Node, score: dict[int, float], measured: dict[int, Measure]) -> list[Node]:
    """The best candidate with those beside it that belong to it: good candidates, long paragraphs with few links, and short ones that are sentences."""
    if best.parent is None:
        return [best]
    bar, kept = max(10.0, score[id(best)] * 0.2), []
    for c in best.parent.children:
        if not isinstance(c, Node) or id(c) not in measured:
            continue
        own = measured[id(c)]
        sentence = c.name == "p" and ((own.chars > 80 and own.density() < 0.25) or (0 < own.chars <= 80 and own.linked == 0 and re.search(r"\.( |$)", c.text(" ").strip())))
        if c is best or score.get(id(c), 0.0) >= bar or sentence:
            kept.append(c)
    return kept


def tidy(root: Node, measured: dict[int, Measure], score: dict[int, float], out: set[int]) -> None:
    """Takes out of a summary what is not to be read: silent and unlikely elements, forms and frames, and lists, tables and boxes that are
    mostly links, fields or pictures."""
    for node in list(root.walk()):
        if node.parent is None:
            continue
        if id(node) in out or node.name in SILENT or node.name in ("form", "iframe", "object", "embed", "textarea", "button", "input", "select"):
            node.remove()
        elif node.name in ("table", "ul", "ol", "div", "section", "aside", "header", "footer", "nav") and id(node) in measured:
            own, value = measured[id(node)], weight(node)
            if value + min(0.0, score.get(id(node), 0.0)) < 0:
                node.remove()
            elif own.commas < 10:
                n = {name: 0 for name in ("p", "img", "li", "input")}
                for below in node.walk():
                    if below.name in n:
                        n[below.name] += 1
                few = own.chars < LEAST_CHARS and not 0 < n["img"] <= 2
                listed = n["li"] > n["p"] and node.name not in ("ul", "ol")
                if n["input"] > n["p"] / 3 and n["input"] or n["img"] > 1 + n["p"] * 1.3 or listed and own.density() > 0.2 or few or own.density() > (0.2 if value < 25 else 0.5):
                    node.remove()


def summary(root: Node) -> Node | None:
    """What a page has to read, in a new element; None if nothing scores. The tree keeps its shape, but what is in the summary loses
    what ``tidy`` takes out. Unlikely elements are left out first; if little is found, they may take part."""
    for lenient in (False, True):
        out = set() if lenient else {id(n) for n in root.walk() if unlikely(n)}
        measured = measures(root, out)
        score = scores(root, measured, out)
        if not score:
            continue
        top = max(score.values())
        best = next(n for n in root.walk() if score.get(id(n)) == top)
        kept = joined(best, score, measured)
        if not lenient and sum(measured[id(n)].chars for n in kept) < RETRY_CHARS:
            continue
        whole = Node("div")
        whole.children = kept
        tidy(whole, measured, score, out)
        whole.children = [n for n in kept if n.parent is not None]
        return whole
    return None
