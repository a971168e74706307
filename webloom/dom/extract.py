"""What a page's tree holds: metadata, links, images, structured data, branding, main content, sections."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from urllib.parse import urljoin, urlsplit

from webloom.dom import readable
from webloom.dom.tree import Node, SelectorError, firsts, fits_any, parse, select, to_html

# Tags and selectors of page furniture, and where main content is looked for, in order. Fixed values.
ALWAYS_DROP = "script style noscript iframe svg canvas template object embed form button input select textarea".split()
STRUCTURAL_DROP = "nav header footer aside".split()
PROTECTED = ("main", "content", "article", "post", "entry")
BOILERPLATE = [
    "[role='navigation']", "[role='banner']", "[role='contentinfo']", ".navigation", ".nav-menu", ".navbar", ".menu", ".sidebar", ".toc", ".table-of-contents",
    "[class*='site-footer']", "[id*='site-footer']", ".footer", "#footer", "[class*='cookie']", "[id*='cookie']", "[class*='consent']", "[id*='consent']",
    "[class*='gdpr']", "[class*='privacy-banner']", "[class*='popup']", "[class*='modal']", "[class*='overlay']", "[class*='advertisement']", "[class*='ad-wrapper']",
    "[class*='sponsored']", "[class*='promo']", "[class*='social-share']", "[class*='share-buttons']", "[class*='social-links']", "img[width='1']", "img[height='1']",
    "[style*='display:none']", "[style*='display: none']", "[hidden]", ".hidden", "[class*='related-']", "[class*='recommended']", "[class*='also-read']",
    "[class*='comment']", "#comments", ".disqus",
]
MAIN_CONTENT = [
    "#mw-content-text", ".mw-parser-output", ".rst-content", ".document", ".markdown-body", ".notion-page-content", "#documentation_body_pagelet", "._4-u2",
    "main[role='main']", "main#content", "main.content", "main", "article.post-content", "article.entry-content", "article.content", "article", "[role='main']",
    "#main-content", "#content", "#main", "#article", "#post", ".main-content", ".content", ".post-content", ".article-content", ".entry-content", ".page-content", ".body-content",
]
CLEAN_DROP = "script style nav footer header noscript iframe".split()
CLEAN_MAIN = ["main", "article", "[role='main']", ".content", "#content"]
GENERIC_FONTS = {"serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui"}
COLOR_ROLES = [
    ("primary", ["primary", "main", "brand"]), ("secondary", ["secondary", "accent-2"]), ("accent", ["accent", "highlight"]),
    ("background", ["background", "bg", "surface"]), ("text_primary", ["text", "foreground", "fg"]),
]
LOGO_IMAGES = ["img.logo", "img#logo", "[class*='logo'] img", ".navbar-brand img", ".site-logo img", "[role='img'][aria-label*='logo']", "img[alt*='logo' i]"]
URL_VALUES = {"a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "iframe": "src", "track": "src", "object": "data"}
SECTION_TAGS = {"h2", "h3", "section", "article"}
_BACKGROUND = re.compile(r"""background(?:-image)?\s*:[^;]*url\(\s*(['"]?)(.*?)\1\s*\)""")
_ZONE = re.compile(r"\b(?:Africa|America|Antarctica|Arctic|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Z][a-zA-Z_]+(?:/[A-Z][a-zA-Z_]+)?\b")


def metadata(page: str | Node | None) -> dict[str, str | None]:
    """Title, description and so on from the head of a page's text or tree: the page's own, then Open Graph, then Twitter. Without a head element the whole
    page is read."""
    root = page if isinstance(page, Node) else parse(page)
    head = root.first("head") or root
    metas = head.every("meta")
    by = lambda key, value: next((m.attrs.get("content") for m in metas if m.attrs.get(key) == value), None)
    title, whole = head.first("title"), root.first("html")
    canonical = next((n for n in head.every("link") if "canonical" in n.attrs.get("rel", "").split()), None)
    own = title.text(strip=True) if title else None
    return {
        "title": own or by("property", "og:title") or by("name", "twitter:title"),
        "description": by("name", "description") or by("property", "og:description") or by("name", "twitter:description"),
        "language": whole.attrs.get("lang") if whole else None,
        "keywords": by("name", "keywords"),
        "robots": by("name", "robots"),
        "canonical_url": canonical.attrs.get("href") if canonical else None,
        "og_title": by("property", "og:title"),
        "og_description": by("property", "og:description"),
        "og_image": by("property", "og:image") or by("name", "twitter:image"),
        "og_url": by("property", "og:url"),
        "og_site_name": by("property", "og:site_name"),
        "timezone": timezone(head),
    }


def timezone(root: Node) -> str | None:
    """An IANA zone from linked data, else from a meta tag named for it."""
    for block in json_ld(root):
        stack = [block]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                for k, v in x.items():
                    if isinstance(v, str) and ("timezone" in k.lower() or k.lower() == "tz") and (m := _ZONE.search(v)):
                        return m[0]
                    stack.append(v)
            elif isinstance(x, list):
                stack.extend(x)
    for m in root.every("meta"):
        name, content = (m.attrs.get("name") or m.attrs.get("property") or "").lower(), m.attrs.get("content", "")
        if content and ("timezone" in name or name == "tz"):
            if z := _ZONE.search(content):
                return z[0]
            if "/" in content and len(content) < 40:
                return content.strip()
    return None


def links(root: Node, base: str) -> list[str]:
    """Absolute http links in document order, repeats kept."""
    out = []
    for a in root.every("a"):
        href = a.attrs.get("href", "").strip()
        if href:
            url = href if _netloc(href) else _resolved(base, href)
            if url.startswith("http"):
                out.append(url)
    return out


def _netloc(url: str) -> str:
    try:
        return urlsplit(url).netloc
    except ValueError:
        return ""


def _resolved(base: str, url: str) -> str:
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def images(root: Node, base: str) -> list[str]:
    """Image urls of img, source and css backgrounds, without inline data and trackers; sorted, once each."""
    found = []
    for n in root.walk():
        if n.name in ("img", "source"):
            found.append(n.attrs.get("src", ""))
            found += [part.split()[0] for part in n.attrs.get("srcset", "").split(",") if part.strip()]
        css = n.attrs.get("style", "") + (n.text() if n.name == "style" else "")
        found += [m[2].strip() for m in _BACKGROUND.finditer(css)] if css else []
    urls = {_resolved(base, u) for u in found if u and not u.startswith("data:")}
    return sorted(u for u in urls if not any(t in u.lower() for t in ("1x1", "pixel", "tracking", "analytics")))


def json_ld(root: Node) -> list:
    """Linked-data objects, lists and graphs flattened, broken blocks skipped."""
    out = []
    for s in root.every("script"):
        if s.attrs.get("type", "").lower() == "application/ld+json":
            try:
                stack = [json.loads(s.text())]
            except ValueError:
                continue
            while stack:
                x = stack.pop(0)
                if isinstance(x, list):
                    stack = x + stack
                elif isinstance(x, dict) and isinstance(x.get("@graph"), list):
                    stack = x["@graph"] + stack
                elif x is not None:
                    out.append(x)
    return out


def open_graph(root: Node) -> dict[str, str]:
    """The first value of every og: property."""
    out: dict[str, str] = {}
    for m in root.every("meta"):
        name, content = m.attrs.get("property", ""), m.attrs.get("content", "")
        if name.startswith("og:") and content:
            out.setdefault(name, content)
    return out


def next_data(root: Node) -> dict | None:
    node = next((s for s in root.every("script") if s.attrs.get("id") == "__NEXT_DATA__"), None)
    try:
        data = json.loads(node.text()) if node else None
    except ValueError:
        return None
    return data if isinstance(data, dict) else None


def microdata(root: Node, base: str | None = None) -> list[dict]:
    """Top-level items with their properties; nested items are values, repeated names lists."""
    return [_item(n, base) for n in root.walk() if "itemscope" in n.attrs and not any("itemscope" in a.attrs for a in n.ancestors())]


def _item(scope: Node, base: str | None) -> dict:
    item: dict = {"type": scope.attrs["itemtype"]} if scope.attrs.get("itemtype") else {}
    props: dict = {}
    stack = [c for c in reversed(scope.children) if isinstance(c, Node)]
    while stack:
        n = stack.pop()
        nested = "itemscope" in n.attrs
        if n.attrs.get("itemprop"):
            name = n.attrs["itemprop"].split()[0] if n.attrs["itemprop"].split() else n.attrs["itemprop"]
            value = _item(n, base) if nested else _item_value(n, base)
            if name in props:
                props[name] = [*(props[name] if isinstance(props[name], list) else [props[name]]), value]
            else:
                props[name] = value
        if not nested:
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    if props:
        item["properties"] = props
    return item


def _item_value(n: Node, base: str | None) -> str | None:
    if n.name == "meta":
        return n.attrs.get("content")
    if n.name in URL_VALUES:
        raw = n.attrs.get(URL_VALUES[n.name])
        return _resolved(base, raw) if raw is not None and base else raw
    if n.name == "time" and "datetime" in n.attrs:
        return n.attrs["datetime"]
    if n.name in ("data", "meter") and "value" in n.attrs:
        return n.attrs["value"]
    return n.text(strip=True) or None


def structured_data(root: Node, base: str | None = None) -> dict:
    return {"json_ld": json_ld(root), "microdata": microdata(root, base), "opengraph": open_graph(root), "next_data": next_data(root)}


def branding(root: Node, base: str) -> dict:
    """Colours by role, fonts, type sizes, spacing, logo and icons, all from the page's own css and marks."""
    css = "\n".join(n.text() for n in root.every("style"))
    variables = {k: v.strip() for k, v in re.findall(r"--([a-zA-Z0-9-]+)\s*:\s*([^;]+);", css)}
    colors: dict[str, str] = {}
    for name, value in variables.items():
        low = name.lower()
        role = next((r for r, marks in COLOR_ROLES if "color" in low and any(m in low for m in marks)), None)
        if role:
            colors.setdefault(role, value)
    theme = next((m.attrs.get("content") for m in root.every("meta") if m.attrs.get("name") == "theme-color"), None)
    if theme:
        colors.setdefault("primary", theme)
    fonts = [f.strip().strip("\"'") for line in re.findall(r"font-family\s*:\s*([^;]+);", css) for f in line.split(",")]
    for n in root.every("link"):
        href = n.attrs.get("href", "")
        if ("fonts.googleapis.com" in href or "fonts.gstatic.com" in href) and (m := re.search(r"family=([^:&]+)", href)):
            fonts.append(m[1].replace("+", " "))
    sizes = {}
    for element in ("h1", "h2", "h3", "body"):
        if m := re.search(element + r"\s*{[^}]*font-size\s*:\s*([^;]+);", css):
            sizes[element] = m[1].strip()
    spacing = {k: v for k, v in variables.items() if any(w in k.lower() for w in ("spacing", "gap", "margin"))}
    if m := re.search(r"border-radius\s*:\s*([^;]+);", css):
        spacing["borderRadius"] = m[1].strip()
    pictures = {}
    for key, rel in (("favicon", "icon"), ("appleTouchIcon", "apple-touch-icon")):
        if n := next((n for n in root.every("link") if rel in n.attrs.get("rel", "").split() and n.attrs.get("href")), None):
            pictures[key] = _resolved(base, n.attrs["href"])
    if og := open_graph(root).get("og:image"):
        pictures["ogImage"] = _resolved(base, og)
    return {
        "colors": colors, "fonts": list(dict.fromkeys(f for f in fonts if f and f.lower() not in GENERIC_FONTS))[:10], "font_sizes": sizes, "spacing": spacing,
        "images": pictures, "logo": logo(root, base), "color_scheme": color_scheme(root, css),
    }


def color_scheme(root: Node, css: str) -> str:
    if re.search(r"color-scheme\s*:\s*dark", css) or any(m.attrs.get("name") == "color-scheme" and "dark" in m.attrs.get("content", "") for m in root.every("meta")):
        return "dark"
    return "light"


def logo(root: Node, base: str) -> str | None:
    """The likeliest logo: named images, an image that links home, named backgrounds, then the page's own picture."""
    for n in firsts(root, LOGO_IMAGES):
        if n:
            src = n.attrs.get("src") or next((i.attrs.get("src") for i in n.every("img")), None)
            if src and not src.startswith("data:"):
                return _resolved(base, src)
    for a in root.every("a"):
        if a.attrs.get("href") == "/" and (src := next((i.attrs.get("src") for i in a.every("img")), None)) and not src.startswith("data:"):
            return _resolved(base, src)
    for n in firsts(root, [".logo", "#logo", "[class*='logo']", ".navbar-brand", ".site-logo"]):
        if n and (m := _BACKGROUND.search(n.attrs.get("style", ""))):
            return _resolved(base, m[2].strip())
    if og := open_graph(root).get("og:image"):
        return _resolved(base, og)
    return None


def words_in(node: Node) -> int:
    return len(node.text(" ").split())


def drop_furniture(root: Node) -> list[tuple[Node, list]]:
    """Takes scripts, menus, banners and the like out of the tree, but not what is named like main content. Returns what ``put_back`` needs."""
    protected = lambda n: any(p in f"{n.attrs.get('id', '')} {n.attrs.get('class', '')} {n.attrs.get('role', '')}".lower() for p in PROTECTED)
    stack, before = [root], []
    while stack:
        node = stack.pop()
        kept = []
        for n in node.children:
            if isinstance(n, Node):
                # All of the listed selectors ask for an attribute.
                if n.name in ALWAYS_DROP or ((n.name in STRUCTURAL_DROP or (n.attrs and fits_any(n, BOILERPLATE))) and not protected(n)):
                    n.parent = None
                    continue
                stack.append(n)
            kept.append(n)
        if len(kept) < len(node.children):
            before.append((node, node.children))
            node.children = kept
    return before


def put_back(before: list[tuple[Node, list]]) -> None:
    for node, children in before:
        node.children = children
        for n in children:
            if isinstance(n, Node):
                n.parent = node


def cleaned(root: Node, only_main: bool = True, include: list[str] | None = None, exclude: list[str] | None = None) -> str:
    """The page's markup without scripts, frames and page furniture: of the included elements in one wrapper if any match, else of the main content, else of
    the body. The tree stays as it is."""
    out = set()
    for s in exclude or []:
        try:
            out.update(map(id, select(root, s)))
        except SelectorError:
            continue
    gone = lambda n: n.name in CLEAN_DROP or id(n) in out
    there = lambda n: not gone(n) and not any(map(gone, n.ancestors()))
    if include:
        wanted = set()
        for s in include:
            try:
                wanted.update(id(n) for n in select(root, s) if there(n))
            except SelectorError:
                continue
        found = [n for n in root.walk() if id(n) in wanted and not any(id(a) in wanted for a in n.ancestors())]
        if found:
            return f"<div>{''.join(to_html(n, gone) for n in found)}</div>"
    if only_main:
        for s in CLEAN_MAIN:
            if n := next((n for n in select(root, s) if there(n)), None):
                return to_html(n, gone)
    return to_html(root.first("body") or root, gone)


def exclude(root: Node, selectors: list[str]) -> None:
    for s in selectors:
        try:
            for n in select(root, s):
                n.remove()
        except SelectorError:
            continue


def include(root: Node, selectors: list[str]) -> Node | None:
    """A new root with the matches in document order, outermost only; None without any."""
    wanted = set()
    for s in selectors:
        try:
            wanted.update(map(id, select(root, s)))
        except SelectorError:
            continue
    found = [n for n in root.walk() if id(n) in wanted and not any(id(a) in wanted for a in n.ancestors())]
    if not found:
        return None
    out = Node("div")
    out.children = found
    return out


def dense(node: Node, mode: float) -> bool:
    """Enough words, and above the middle of the dial enough text for its markup."""
    over = max(0.0, (mode - 0.5) / 0.5)
    if words_in(node) < 5 + int(95 * over):
        return False
    return over == 0 or len(node.text(" ")) / max(1, node.html_length()) >= 0.075 * over


def sections(root: Node) -> list[Node]:
    """The root's children in runs that begin at headings and sections; one run without any."""
    runs: list[list[Node]] = []
    for c in root.children:
        if isinstance(c, Node):
            if not runs or c.name in SECTION_TAGS:
                runs.append([])
            runs[-1].append(c)
    out = []
    for run in runs or [[root]]:
        wrap = Node("div")
        wrap.children = run
        out.append(wrap)
    return out


def bm25(documents: list[list[str]], query: list[str], k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> list[float]:
    """Okapi scores; a term that most documents hold gets a small share of the mean weight instead of a negative one."""
    n, mean = len(documents), sum(map(len, documents)) / len(documents)
    df = Counter(t for d in documents for t in set(d))
    idf = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf) if idf else 0.0
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    out = []
    for d in documents:
        tf = Counter(d)
        out.append(sum(idf.get(q, 0.0) * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(d) / mean)) for q in query if tf[q]))
    return out


def keep_sections(parts: list[Node], mode: float, query: str | None) -> list[Node]:
    """Sections that score a share of the best: by relevance to the query, or by length without one. Never none."""
    if len(parts) == 1:
        return parts
    tokens = [p.text(" ").lower().split() for p in parts]
    some = [k for k, t in enumerate(tokens) if t]
    if not some:
        return parts
    got = bm25([tokens[k] for k in some], query.lower().split()) if query else [float(len(tokens[k])) for k in some]
    scores = dict(zip(some, got, strict=True))
    best = max([*scores.values(), 0.0]) if len(some) < len(parts) else max(scores.values())
    if query and best == 0:
        return parts
    kept = [p for k, p in enumerate(parts) if scores.get(k, 0.0) >= 0.20 * mode * best]
    return kept or parts


def main_content(root: Node, mode: float = 0.5, query: str | None = None) -> tuple[Node, str]:
    """The main content of a whole tree, and how it was found: the first main-content match that is dense enough without the page's furniture
    (selector); else what reads like an article on the whole page, from LEAST_WORDS words (readable); else the longer sections of the body without
    furniture (body). Then the query's sections only. The tree loses what is not main content."""
    mode = min(1.0, max(0.0, mode))
    before = drop_furniture(root)
    how, found = "selector", next((n for n in firsts(root, MAIN_CONTENT) if n is not None and dense(n, mode)), None)
    if found is None:
        put_back(before)
        how, found = "readable", readable.summary(root)
        if found is None or words_in(found) < readable.LEAST_WORDS:
            drop_furniture(root)
            how, found = "body", root.first("body") or root
            found = _joined(found, keep_sections(sections(found), mode, None))
    return (_joined(found, keep_sections(sections(found), mode, query)) if query else found), how


def _joined(whole: Node, kept: list[Node]) -> Node:
    if len(kept) == len(sections(whole)):
        return whole
    out = Node("div")
    out.children = [c for p in kept for c in p.children]
    return out
