"""Rewrites of pages whose generator hides structure from a converter: documentation with permalinks, code tables, notes and tabs; lists numbered by styles;
blogs with their navigation between posts."""

from __future__ import annotations

from webloom.dom.tree import Node, select, select_first

# What a blog's theme puts around a post, and where its title and main content are, in order. Fixed values.
BLOG_PARTS = [
    ".fixed-nav", ".fixed-nav-prev", ".fixed-nav-next", ".post-navigation", ".nav-links", ".post-pager", ".share-simple-wrapper", ".sharedaddy", ".social-share", ".related-posts", ".section-post-related",
    ".yarpp-related", ".rich-reviews", ".feedback-form", "[class*='rating']", "[class*='review-form']",
]
BLOG_TITLES = ["#Subheader h1.title", ".entry-title", ".page-title", "header h1"]
BLOG_MAIN = ["main", "article", "#Content", ".entry-content"]
#: Siblings that may lie between two items of one list.
BETWEEN = 10


def generator(root: Node, mark: str) -> bool:
    return any(m.attrs.get("name") == "generator" and mark in m.attrs.get("content", "").lower() for m in root.every("meta"))


def element(name: str, *children: Node | str, **attrs: str) -> Node:
    """A new element that holds ``children``."""
    out = Node(name, attrs)
    for c in children:
        out.children.append(c)
        if isinstance(c, Node):
            c.parent = out
    return out


def put_instead(node: Node, new: Node) -> None:
    """``new`` at the place of ``node``."""
    above = node.parent
    if above is not None:
        above.children = [new if c is node else c for c in above.children]
        new.parent, node.parent = above, None


def is_documentation(root: Node) -> bool:
    return generator(root, "mkdocs") or any("md-content" in n.classes() for n in root.walk())


def documentation(root: Node) -> None:
    """Permalinks go, tables of line numbers and code become code blocks in their language, notes quotations with a bold title, and tabs headed parts."""
    for n in root.every("a"):
        if "headerlink" in n.classes():
            n.remove()
    for table in select(root, "table.highlighttable"):
        code = select_first(table, "td.code code")
        if code is not None:
            around = next((a for a in table.ancestors() if a.name == "div" and "highlight" in a.classes()), None)
            language = next((c for c in (around.classes() if around else []) if c.startswith("language-")), None)
            put_instead(table, element("pre", element("code", code.text(), **({"class": language} if language else {}))))
    for note in select(root, "div.admonition"):
        kind = next((c.capitalize() for c in note.classes() if c != "admonition"), "Note")
        title = select_first(note, "p.admonition-title")
        heading = title.text(strip=True) if title is not None else kind
        if title is not None:
            title.remove()
        parts = [" ".join((c.text() if isinstance(c, Node) else c).split()) for c in note.children]
        put_instead(note, element("blockquote", element("p", element("strong", f"{heading}:"), " " + " ".join(p for p in parts if p))))
    for tabs in select(root, "div.tabbed-set"):
        labels = [t for n in select(tabs, "div.tabbed-labels label") if (t := n.text(strip=True))]
        box = element("div")
        for k, part in enumerate(select(tabs, "div.tabbed-block")):
            for c in (element("h4", labels[k] if k < len(labels) else f"Tab {k + 1}"), *part.children):
                box.children.append(c)
                if isinstance(c, Node):
                    c.parent = box
        put_instead(tabs, box)


def _level(item: Node) -> int:
    text = item.attrs.get("data-list-level", "").strip()
    return int(text) if text.lstrip("+-").isdigit() else 1


def _numbered_by_style(n: Node) -> bool:
    return "counter-reset" in n.attrs.get("style", "") or "counter" in " ".join(n.classes())


def is_counter_list(root: Node) -> bool:
    return any("data-list-level" in n.attrs for n in root.every("p")) or any(_numbered_by_style(n) for n in root.every("ul"))


def counter_lists(root: Node) -> None:
    """Paragraphs with a list level become items of nested numbered lists, those not far from one another of one list; lists that a style numbers become numbered
    ones."""
    for n in root.every("ul"):
        if _numbered_by_style(n):
            n.name = "ol"
    seen: set[int] = set()
    for first in [n for n in root.every("p") if "data-list-level" in n.attrs]:
        if id(first) in seen or first.parent is None:
            continue
        beside = [c for c in first.parent.children if isinstance(c, Node)]
        place = {id(c): k for k, c in enumerate(beside)}
        group = [first]
        for c in beside[place[id(first)] + 1 :]:
            if place[id(c)] - place[id(group[-1])] > BETWEEN:
                break
            if c.name == "p" and "data-list-level" in c.attrs:
                group.append(c)
        seen.update(map(id, group))
        _nest(group)


def _nest(items: list[Node]) -> None:
    """One list of all items, each level below the last item of the nearest level above it; it stands where the first item was."""
    top = element("ol")
    open_lists = [(min(map(_level, items)), top)]
    for item in items:
        level = _level(item)
        while len(open_lists) > 1 and open_lists[-1][0] > level:
            open_lists.pop()
        if open_lists[-1][0] < level:
            above = open_lists[-1][1]
            below = element("ol")
            holder = above.children[-1] if above.children else above
            holder.children.append(below)
            below.parent = holder
            open_lists.append((level, below))
        entry = element("li", *item.children)
        entry.parent = open_lists[-1][1]
        open_lists[-1][1].children.append(entry)
    put_instead(items[0], top)
    for item in items[1:]:
        item.remove()


def is_blog(root: Node) -> bool:
    named = lambda n: any("wp-" in c or "post-" in c or c in ("hentry", "entry-content") for c in n.classes())
    return generator(root, "wordpress") or any(named(n) for n in root.walk())


def blog(root: Node) -> None:
    """The title comes first in the main content; navigation between posts, sharing, related posts, ratings and placeholders of pictures go; block wrappers are plain boxes."""
    title = next((n for s in BLOG_TITLES if (n := select_first(root, s)) is not None), None)
    main = next((n for s in BLOG_MAIN if (n := select_first(root, s)) is not None), None)
    if title is not None and main is not None and title.text(strip=True):
        heading = element("h1", title.text(strip=True))
        if any(a is main for a in title.ancestors()):
            title.remove()
        heading.parent = main
        main.children.insert(0, heading)
    for s in BLOG_PARTS:
        for n in select(root, s):
            n.remove()
    for n in root.every("img"):
        if n.attrs.get("src", "").startswith("data:image/svg+xml"):
            n.remove()
    for n in root.every("figure", "div"):
        if any(c.startswith("wp-block-") for c in n.classes()):
            n.name = "div"


#: (name, detects, rewrites); extend by appending.
PREPROCESSORS: list = [("mkdocs", is_documentation, documentation), ("css_counters", is_counter_list, counter_lists), ("wordpress", is_blog, blog)]


def prepare(root: Node) -> list[str]:
    """Runs the preprocessors that recognise the page; their names."""
    done = []
    for name, detects, rewrites in PREPROCESSORS:
        if detects(root):
            rewrites(root)
            done.append(name)
    return done
