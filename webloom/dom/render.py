"""What a page shows, from its markup: the text that a reader sees, by the rules of inner text, and counts of its structure."""

from __future__ import annotations

import re

from webloom.dom.tree import Node, firsts

# Elements that are not rendered, that make blocks, and that leave an empty line around them. Fixed values.
HIDDEN = frozenset("script style template noscript head title meta link base iframe object embed audio video canvas svg math datalist textarea select option input button area param source track".split())
BLOCKS = frozenset(
    """html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu
    nav ol p plaintext pre search section summary table tbody tfoot thead tr caption ul xmp""".split()
)
APART = frozenset(["p"])
# Where a page's main text is looked for, in order. Fixed values.
MAIN = ["main", "article", "[role='main']", ".mw-parser-output", "#content"]
COUNTED = {"headings": ("h1", "h2", "h3", "h4", "h5", "h6"), "tables": ("table",), "code": ("pre", "code"), "images": ("img",), "links": ("a",)}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)


def shown(node: Node) -> bool:
    """Whether an element is rendered, by its name, attributes and own style."""
    return node.name not in HIDDEN and "hidden" not in node.attrs and not _HIDES.search(node.attrs.get("style", ""))


def inner_text(root: Node) -> str:
    """The text of an element as a reader sees it: white space is collapsed but in preformatted text, blocks are on lines of their own, paragraphs have an empty line
    around them, cells a tab between them. Walks with a stack, so that pages may nest without limit."""
    out: list[str | int] = []  # texts, and how many line ends have to be there at least
    stack: list[tuple[str, object]] = [("open", root)]
    kept = 0  # how many elements keep white space
    while stack:
        what, c = stack.pop()
        if what == "text":
            _add(out, c if kept else _SPACE.sub(" ", c), bool(kept))
        elif what == "break":
            out.append(c)
        elif what == "raw":
            _add(out, c, True)
        elif what == "unkeep":
            kept -= 1
        elif c is root or shown(c):
            if c.name == "br":
                _add(out, "\n", True)
                continue
            ends = 2 if c.name in APART else 1 if c.name in BLOCKS and c is not root else 0
            if ends:
                out.append(ends)
                stack.append(("break", ends))
            if c.name in ("td", "th") and _later_cell(c):
                stack.append(("raw", "\t"))
            if c.name == "pre" or re.search(r"white-space\s*:\s*(?:pre|break-spaces)", c.attrs.get("style", "")):
                kept += 1
                stack.append(("unkeep", None))
            for x in reversed(c.children):
                stack.append(("text", x) if isinstance(x, str) else ("open", x))
    return _joined(out)


def _later_cell(cell: Node) -> bool:
    row = [x for x in cell.parent.children if isinstance(x, Node) and x.name in ("td", "th") and shown(x)] if cell.parent else []
    return bool(row) and row[-1] is not cell


def _add(out: list[str | int], text: str, keep: bool) -> None:
    """Appends a text; collapsed white space goes after white space and at the beginning of a line."""
    if not keep and text.startswith(" ") and (not out or isinstance(out[-1], int) or out[-1].endswith((" ", "\n", "\t"))):
        text = text[1:]
    if text:
        out.append(text)


def _joined(out: list[str | int]) -> str:
    parts: list[str] = []
    ends = 0
    for x in out:
        if isinstance(x, int):
            if parts:
                parts[-1] = parts[-1].rstrip(" ") if ends == 0 else parts[-1]
            ends = max(ends, x)
        elif x.strip(" ") or x == " ":
            if ends and not x.strip(" "):
                continue
            if ends and parts:
                parts.append("\n" * ends)
            ends = 0
            parts.append(x)
    return re.sub(r" +\n", "\n", "".join(parts)).strip(" ").removesuffix("\n")


def reference(root: Node) -> dict:
    """Main and whole text of a page, and how much it has of what."""
    body = root.first("body") or root
    main = next((n for n in firsts(root, MAIN) if n is not None), body)
    counts = dict.fromkeys(COUNTED, 0)
    for n in root.walk():
        for kind, names in COUNTED.items():
            counts[kind] += n.name in names
    return {"main_text": inner_text(main), "full_text": inner_text(body), **counts}
