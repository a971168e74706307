"""Readability on hand-made pages, and against a plain second reading of its rules that measures every element by its own text."""

import re

import pytest

from webloom.dom import extract as E
from webloom.dom import readable as R
from webloom.dom.markdown import convert
from webloom.dom.tree import Node, parse
from webloom.operators import pages as P

SENTENCE = "The committee met on a grey morning, heard the report, asked its questions, and went home without a word. "
ARTICLE = "".join(f"<p>{SENTENCE * 2}Part {k}.</p>" for k in range(6))
MENU = "<div class='menu'>" + "".join(f"<a href='/{k}'>Section number {k} of this site</a> " for k in range(30)) + "</div>"
PLAIN = f"<html><body>{MENU}<div id='c1'><div class='story-text'>{ARTICLE}</div></div><div class='related'><a href='/r'>Read more, and more, of these long related stories here</a></div></body></html>"


def words(node):
    return len(node.text(" ").split())


def test_article_without_marks():
    found, how = E.main_content(parse(PLAIN))
    assert how == "readable"
    text = found.text(" ")
    assert all(f"Part {k}." in text for k in range(6)) and "Section number" not in text and "related stories" not in text


def test_cascade():
    marked = f"<body><main>{ARTICLE}</main></body>"
    assert E.main_content(parse(marked))[1] == "selector"
    short = f"<body><div><p>{SENTENCE}</p></div></body>"
    found, how = E.main_content(parse(short))
    assert how == "body" and "committee" in found.text()
    listing = "<body>" + "".join(f"<li><a href='/{k}'>Item {k} with a name</a></li>" for k in range(200)) + "</body>"
    assert E.main_content(parse(listing))[1] == "body"
    assert E.main_content(parse(""))[1] == "body" and E.main_content(parse("plain text"))[1] == "body"


def test_eighty_words():
    for n, how in ((R.LEAST_WORDS - 1, "body"), (R.LEAST_WORDS, "readable")):
        page = f"<body><div><p>{' '.join(['word,'] * n)}</p></div></body>"
        assert E.main_content(parse(page))[1] == how


def test_neighbours_join():
    page = f"<body><section><p>{SENTENCE * 3}</p><div class='story'>{ARTICLE}</div><p>A last word.</p><p>no sentence</p><div><a href='/x'>{SENTENCE}</a></div></section></body>"
    text = E.main_content(parse(page))[0].text(" ")
    assert "A last word." in text and "no sentence" not in text and text.count("The committee") == 15


def test_unlikely_gets_a_second_chance():
    page = f"<body><div class='comment'><div>{ARTICLE}</div></div></body>"
    found, how = E.main_content(parse(page))
    assert how == "readable" and words(found) > 200


def test_tidy():
    junk = "<form>Your name here please, and your mail</form><script>var a = 'The committee';</script><ul><li><a href='/1'>one link more</a></li><li><a href='/2'>another link, too</a></li></ul><table class='related'><tr><td>promoted</td></tr></table>"
    page = f"<body><div><div class='story'>{ARTICLE}{junk}<ul><li>{SENTENCE}</li></ul></div></div></body>"
    text = E.main_content(parse(page))[0].text(" ")
    assert "Your name" not in text and "var a" not in text and "one link" not in text and "promoted" not in text and text.count("The committee") == 13


def test_furniture_comes_back():
    """The tree that the second step reads has what the first one took out, and the third step has it not."""
    root = parse(f"<body><div class='sidebar'><div>{ARTICLE}</div></div><p>tiny</p></body>")
    before = [id(n) for n in root.walk()]
    undo = E.drop_furniture(root)
    assert len(list(root.walk())) < len(before)
    E.put_back(undo)
    assert [id(n) for n in root.walk()] == before and all(n.parent is not None for n in root.walk())


def test_deep_and_long():
    assert "deep" in convert("<div>" * 4000 + f"{ARTICLE}deep")
    assert E.main_content(parse("<body><div>" + ARTICLE * 500 + "</div></body>"))[1] == "readable"


def plain_measure(node: Node, out: set[int]):
    """Characters, characters in links and commas by looking at each string and all that is above it."""
    chars = linked = commas = 0
    stack = [(c, node) for c in node.children]
    while stack:
        c, above = stack.pop()
        if isinstance(c, Node):
            if id(c) not in out and c.name not in R.SILENT:
                stack += [(x, c) for x in c.children]
            continue
        text = " ".join(c.split())
        chars, commas = chars + len(text), commas + text.count(",")
        a, in_link = above, False
        while a is not None and not in_link:
            in_link = a.name == "a"
            a = None if a is node else a.parent
        linked += len(text) * in_link
    return chars, linked, commas


def plain_scores(root: Node, out: set[int]):
    hidden = lambda n: any(id(a) in out or a.name in R.SILENT for a in [n, *n.ancestors()])
    seen = [n for n in root.walk() if not hidden(n)]
    total: dict[int, float] = {}
    by_id = {id(n): n for n in seen}
    for n in seen:
        chars, _, commas = plain_measure(n, out)
        blocks = [c for c in n.children if isinstance(c, Node) and c.name in R.BLOCKS]
        if (n.name in ("p", "pre", "td", "blockquote") or (n.name in ("div", "section", "article") and not blocks)) and chars >= 25:
            points = 2 + commas + min(3, chars // 100)
            for above, part in ((n.parent, 1.0), (n.parent.parent, 0.5)):
                if above is not None and id(above) in by_id:
                    total[id(above)] = total.get(id(above), 0.0) + points * part
    out_scores = {}
    for key, points in total.items():
        n = by_id[key]
        for v in (n.attrs.get("class", ""), n.attrs.get("id", "")):
            points += 25 if v and re.search(R.POSITIVE, v) else 0
            points -= 25 if v and re.search(R.NEGATIVE, v) else 0
        chars, linked, _ = plain_measure(n, out)
        out_scores[key] = (points + R.NAME_SCORES.get(n.name, 0)) * (1 - linked / max(1, chars))
    return out_scores


@pytest.mark.parametrize("lenient", [True, False])
def test_scores_by_a_second_reading(spark, lenient):
    from tests.conftest import SF

    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(40).collect()] + [PLAIN, f"<body><td>{SENTENCE}<a href='/'>{SENTENCE}</a></td></body>"]
    for html in pages:
        for text in (html, re.sub("<(/?)(article|main|nav)", r"<\1div", html)):
            root = parse(text)
            out = set() if lenient else {id(n) for n in root.walk() if R.unlikely(n)}
            got = R.scores(root, R.measures(root, out), out)
            want = plain_scores(root, out)
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_column(spark):
    rows = [(1, "https://x.example/", PLAIN), (2, None, None), (3, "u", f"<main>{ARTICLE}</main>"), (3, "u", f"<main>{ARTICLE}</main>"), (None, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.strategy) for r in P.scrape(pages, ("strategy",)).collect())
    assert got == [(0, "body"), (1, "readable"), (2, "body"), (3, "selector"), (3, "selector")]
    assert {r.strategy for r in P.scrape(pages, ("markdown", "strategy"), only_main=False).collect()} == {"page"}
    assert {r.strategy for r in P.scrape(pages, ("strategy",), include=["p"]).where("page_id = 3").collect()} == {"include"}
