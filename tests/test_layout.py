"""Words, lines and tables from boxes against a plain reading; inner text on hand-made pages."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.dom import render
from webloom.dom.tree import parse
from webloom.operators import layout
from webloom.operators import pages as P

SCHEMA = "doc int, x0 double, x1 double, top double, size double, text string"


def plain_text(chars, x_tolerance, y_tolerance=3.0):
    """One page's text, glyph by glyph."""
    chars = sorted((c for c in chars if c[4].strip()), key=lambda c: c[2])
    rows, last = [], None
    for c in chars:
        if last is None or c[2] - last > y_tolerance:
            rows.append([])
        rows[-1].append(c)
        last = c[2]
    out = []
    for row in rows:
        words, reach = [], None
        for c in sorted(row, key=lambda c: (c[0], c[1], c[4])):
            if reach is None or c[0] - reach > x_tolerance:
                words.append("")
            words[-1] += c[4]
            reach = c[1] if reach is None else max(reach, c[1])
        out.append(" ".join(words))
    return "\n".join(out)


@pytest.mark.parametrize("tolerance", [2.0, 3.0])
def test_text(spark, tolerance):
    rng = random.Random(5)
    rows = []
    for doc in range(6):
        for _ in range(80):
            x = rng.randrange(0, 60) + rng.choice([0.0, 0.5])
            rows.append((doc, x, x + rng.choice([1, 2.5, 4.0]), rng.randrange(0, 60) / rng.choice([1, 2]), 10.0, rng.choice("abcdefg é日 ")))
    got = {r.doc: r.text for r in layout.page_text(layout.words(spark.createDataFrame(rows, SCHEMA).repartition(3), ["doc"], tolerance), ["doc"]).collect()}
    assert got == {d: plain_text([r[1:] for r in rows if r[0] == d], tolerance) for d in range(6)}


def glyphs(doc, lines, pitch=6.0):
    """A page from (top, [(x, text)])."""
    return [(doc, x + k * pitch, x + k * pitch + pitch - 1, float(top), 10.0, c) for top, cells in lines for x, text in cells for k, c in enumerate(text) if c != " "]


def test_tables(spark):
    page = [
        (0, [(0, "A title that goes on")]), (20, [(0, "Name"), (100, "Amount"), (200, "On")]), (32, [(0, "two words"), (106, "12")]), (44, [(12, "x"), (100, "3456"), (206, "day")]),
        (60, [(0, "text again with words")]), (72, [(0, "left"), (200, "right")]), (90, [(0, "end")]), (110, [(0, "p"), (50, "q")]), (122, [(0, "r"), (50, "s")]),
    ]
    found = layout.words(spark.createDataFrame(glyphs(1, page) + glyphs(2, [(0, [(0, "no table here")])]), SCHEMA), ["doc"])
    got = sorted((r.doc, r.table, [list(x) for x in r.rows]) for r in layout.tables(found, ["doc"]).collect())
    assert [g[2] for g in got] == [[["Name", "Amount", "On"], ["two words", "12", ""], ["x", "3456", "day"]], [["p", "q"], ["r", "s"]]] and {g[0] for g in got} == {1}


def test_edges(spark):
    rows = [(1, None, 1.0, 0.0, 1.0, "a"), (1, 0.0, 1.0, None, 1.0, "b"), (2, 0.0, 1.0, 0.0, 1.0, None), (2, 2.0, 3.0, 0.0, 1.0, " "), (3, 0.0, 5.0, 0.0, 1.0, "x"), (3, 0.0, 5.0, 0.0, 1.0, "x"), (None, 0.0, 1.0, 0.0, 1.0, "n")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {(r.doc, r.text) for r in layout.page_text(layout.words(frame, ["doc"]), ["doc"]).collect()} == {(3, "xx"), (None, "n")}
    assert layout.page_text(layout.words(frame.limit(0), ["doc"]), ["doc"]).count() == 0 and layout.tables(layout.words(frame, ["doc"]), ["doc"]).count() == 0


def test_laid_out_and_read(spark):
    text = "First line, with words\n\n  indented é 日本\n" + "\n".join(f"line {k}" for k in range(100))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = layout.page_text(layout.words(layout.laid_out(docs, F.lit(7.0)), ["doc_id", "page"]), ["doc_id", "page"])
    pages = [r.text for r in found.where("doc_id = 1").orderBy("page").collect()]
    assert len(pages) == 3 and "\n".join(pages) == "\n".join(" ".join(x.split()) for x in text.split("\n") if x.strip()) and found.where("doc_id > 1").count() == 0


def shown(html):
    return render.inner_text(parse(html))


def test_inner_text():
    assert shown("<p>a  b\n c</p><p>d</p>") == "a b c\n\nd"
    assert shown("<div>a<div>b</div>c</div><div></div><div>d</div>") == "a\nb\nc\nd"
    assert shown("a <b>bold </b> and <i> it</i>") == "a bold and it"
    assert shown("x<br>y<br><br>z") == "x\ny\n\nz"
    assert shown("<pre>a\n  b </pre>c") == "a\n  b \nc" or shown("<pre>a\n  b </pre>c") == "a\n  b\nc"
    assert shown("<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table>t") == "h\ti\n1\t2\nt"
    assert shown("<script>x</script><style>y</style><p hidden>z</p><p style='color:red; display: none'>n</p><noscript>m</noscript>seen") == "seen"
    assert shown("<ul><li>one</li><li>two <a href='/'>link</a></li></ul>") == "one\ntwo link"
    assert shown("<h1>T</h1>text<p>p</p>") == "T\ntext\n\np" and shown("") == "" and shown("   ") == ""
    assert shown("<div>" * 4000 + "deep") == "deep" and shown("<span>a</span> <span>b</span>") == "a b"


def test_reference():
    html = "<head><title>no</title></head><body><nav><a href='/'>menu</a></nav><main><h2>H</h2><p>main <code>c</code><img src=x></p></main><table></table><p>after</p></body>"
    got = render.reference(parse(html))
    assert got["main_text"] == "H\n\nmain c" and got["full_text"] == "menu\nH\n\nmain c\n\nafter"
    assert {k: got[k] for k in render.COUNTED} == {"headings": 1, "tables": 1, "code": 1, "images": 1, "links": 1}


def test_references_column(spark):
    frame = spark.createDataFrame([(1, "<p>a</p>"), (None, None), (2, ""), (1, "<p>a</p>")], "page_id long, html string")
    got = sorted(((r.page_id or 0, r.reference, r.reference_error) for r in P.references(frame).collect()), key=repr)
    assert got == [(0, None, True), (1, "a", False), (1, "a", False), (2, None, True)]


def test_glyphs_cross_no_shuffle(spark):
    """Texts are dealt out once, before they are glyphs: nothing that is read from their glyphs is dealt out again."""
    docs = spark.createDataFrame([(k, f"one two {k}\nthree") for k in range(5)], "doc_id long, text string")
    read = layout.page_text(layout.words(layout.laid_out(docs, F.lit(7.0)), ["doc_id", "page"]), ["doc_id", "page"])
    plan = read.groupBy("doc_id").agg(F.sum("n_words").alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert sorted((r.doc_id, r.text) for r in read.collect()) == [(k, f"one two {k}\nthree") for k in range(5)]
