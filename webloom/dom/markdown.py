"""Markdown of a tree: ATX headings, dashes, tables, absolute links."""

from __future__ import annotations

import re

from webloom.dom import extract as E
from webloom.dom.sites import PREPROCESSORS, prepare  # noqa: F401 - the list is what callers extend
from webloom.dom.tree import Node, parse

BLOCKS = frozenset("p div section article main body html header footer nav aside figure figcaption details summary address dl dt dd fieldset center [document]".split())
_WIDE = re.compile(r"[ \t\r\f\v]+")


def to_markdown(node: Node, base: str = "") -> str:
    out = _block(node, base, 0)
    out = re.sub(r"[ \t]+\n", "\n", out)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def convert(html: str | None, base: str = "", only_main: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, mode: float = 0.5, query: str | None = None) -> str:
    """A page as markdown: exclusions first, then the included elements if any match, else main content or the whole body."""
    root = parse(html)
    prepare(root)
    if only_main or include:
        return main_markdown(root, base, only_main, include, exclude, mode, query)[0]
    E.exclude(root, exclude or [])
    return full_markdown(root, base)


def full_markdown(root: Node, base: str = "") -> str:
    """The whole body of a prepared tree, which loses its scripts and styles."""
    for n in root.every("script", "style", "noscript", "template"):
        n.remove()
    return to_markdown(root.first("body") or root, base)


def main_markdown(root: Node, base: str = "", only_main: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, mode: float = 0.5, query: str | None = None) -> tuple[str, str]:
    """The included elements of a prepared tree, else its main content, and how it was found (``E.main_content``; include and page where the
    caller's selectors or the whole page decide); the tree loses exclusions and furniture."""
    E.exclude(root, exclude or [])
    picked = E.include(root, include) if include else None
    if picked is not None:
        return to_markdown(picked, base), "include"
    if not only_main:
        return full_markdown(root, base), "page"
    found, how = E.main_content(root, mode, query)
    return to_markdown(found, base), how


#: Elements nested deeper than this are read as plain text.
DEEPEST = 120


def _inline(node: Node, base: str, depth: int = 0) -> str:
    if depth > DEEPEST:
        return node.text(" ", strip=True)
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(_WIDE.sub(" ", c.replace("\n", " ")))
        elif c.name in ("strong", "b"):
            out.append(_around(_inline(c, base, depth + 1), "**"))
        elif c.name in ("em", "i"):
            out.append(_around(_inline(c, base, depth + 1), "*"))
        elif c.name == "code":
            out.append(_around(c.text(), "`"))
        elif c.name == "br":
            out.append("  \n")
        elif c.name == "a":
            out.append(_link(c, base, depth + 1))
        elif c.name == "img":
            out.append(_image(c, base))
        elif c.name in BLOCKS or c.name in ("ul", "ol", "table", "pre", "blockquote") or re.fullmatch("h[1-6]", c.name):
            out.append("\n\n" + _block(c, base, depth + 1).strip() + "\n\n")
        elif c.name not in ("script", "style", "head", "title", "meta", "link"):
            out.append(_inline(c, base, depth + 1))
    return "".join(out)


def _around(text: str, mark: str) -> str:
    bare = text.strip()
    return text if not bare else text[: len(text) - len(text.lstrip())] + mark + bare + mark + text[len(text.rstrip()) :]


def _link(a: Node, base: str, depth: int = 0) -> str:
    text, href = _inline(a, base, depth).strip(), a.attrs.get("href", "").strip()
    if not href or href.lower().startswith("javascript:"):
        return text
    if base and not E._netloc(href) and not href.startswith(("mailto:", "tel:")):
        href = E._resolved(base, href)
    title = a.attrs.get("title")
    return f'[{text}]({href} "{title}")' if title and text else f"[{text}]({href})" if text else ""


def _image(n: Node, base: str) -> str:
    src, alt, title = n.attrs.get("src", ""), n.attrs.get("alt", ""), n.attrs.get("title", "")
    if not src:
        return ""
    src = E._resolved(base, src) if base and not E._netloc(src) else src
    return f'![{alt}]({src} "{title}")' if title else f"![{alt}]({src})"


def _block(node: Node, base: str, depth: int) -> str:
    if depth > DEEPEST:
        return node.text(" ", strip=True)
    name = node.name
    if re.fullmatch("h[1-6]", name):
        text = re.sub(r"\s+", " ", _inline(node, base, depth)).strip()
        return f"\n\n{'#' * int(name[1])} {text}\n\n" if text else ""
    if name in ("ul", "ol"):
        return "\n\n" + _list(node, base, depth) + "\n\n"
    if name == "pre":
        code = node.first("code")
        language = next((c[9:] for c in (code.classes() if code else []) if c.startswith("language-")), "")
        return f"\n\n```{language}\n" + node.text().strip("\n") + "\n```\n\n"
    if name == "blockquote":
        return "\n\n" + "\n".join("> " + line if line else ">" for line in _group(node, base, depth).strip().split("\n")) + "\n\n"
    if name == "table":
        return "\n\n" + _table(node, base, depth) + "\n\n"
    if name == "hr":
        return "\n\n---\n\n"
    return "\n\n" + _group(node, base, depth) + "\n\n"


def _group(node: Node, base: str, depth: int) -> str:
    """Runs of inline content are paragraphs between the blocks."""
    out, run = [], Node("span")
    special = ("ul", "ol", "pre", "blockquote", "table", "hr")
    for c in node.children:
        if isinstance(c, Node) and (c.name in BLOCKS or c.name in special or re.fullmatch("h[1-6]", c.name)):
            out += [_inline(run, base, depth + 1).strip(), _block(c, base, depth + 1)]
            run = Node("span")
        else:
            run.children.append(c)
    out.append(_inline(run, base, depth + 1).strip())
    return "\n\n".join(p for p in out if p.strip())


def _list(node: Node, base: str, depth: int) -> str:
    out, n = [], int(node.attrs["start"]) if node.attrs.get("start", "").isdigit() else 1
    for item in node.children:
        if isinstance(item, Node) and item.name == "li":
            mark = f"{n}. " if node.name == "ol" else "- "
            n += 1
            body = re.sub(r"\n{2,}", "\n", _group(item, base, depth + 1).strip())
            out.append(mark + body.replace("\n", "\n" + " " * len(mark)))
    return "\n".join(out)


def _table(node: Node, base: str, depth: int) -> str:
    rows = []
    for tr in node.every("tr"):
        cells = [c for c in tr.children if isinstance(c, Node) and c.name in ("td", "th")]
        rows.append([re.sub(r"\s+", " ", _inline(c, base, depth + 1)).strip().replace("|", "\\|") for c in cells])
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])
