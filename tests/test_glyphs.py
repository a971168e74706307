"""Glyphs in arrays against glyphs as rows, a plain reading and the SQL of pdf_layout."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_layout import plain_text
from webloom.operators import glyphs as G
from webloom.operators import layout

ODD = [
    "First line, with words\n\n  indented é 日本 g\n" + "\n".join(f"line {k} gypq" for k in range(100)), None, "", " \n\t\r\n\f ", "\n" * 95 + "late", "no break sep　wide x y z",
    "vertical\x0btab and\x85next\x1cunit zero​width᠎", "😀 a😀b\n𝒳y é", "one", "tail \n", "\n\nq", "x" * 500 + " " + "é" * 300, "\n".join("w " * (k % 7) for k in range(200)), "a\r\nb\rc",
]


def column(texts, gaps):
    each = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(gaps, pa.float64())], ["text", "gap"])
    return pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), each)


@pytest.mark.parametrize("gap", [7.0, 2.5])
def test_same_as_rows(spark, gap):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    keys = ["doc_id", "page"]
    chars = layout.laid_out(docs, F.lit(gap))
    near, far = (layout.page_text(layout.words(chars, keys, x), keys).collect() for x in (2.0, 3.0))
    want = {}
    for r in sorted(near):
        want.setdefault(r.doc_id, []).append(r.text)
    got = layout.read_back(docs, F.lit(gap), (2.0, 3.0)).collect()
    assert {r.doc_id: "\n".join(x.text for x in r.lines) for r in got} == {d: "\n".join(t) for d, t in want.items()} and len(got) == len(want)
    for k, rows in enumerate((near, far)):
        assert {r.doc_id: r.words[k] for r in got} == {d: sum(r.n_words for r in rows if r.doc_id == d) for d in want}


def test_cut_between_pages():
    """Wherever texts are cut and however many are together, lines and words are the same, and so they are in a part of an Arrow column."""
    texts, gaps = [*ODD, "\n".join(ODD[:1] * 5)], [[7.0, 2.5, None][k % 5 % 3] for k in range(len(ODD) + 1)]
    rows = column(texts, gaps)
    whole = G.read_back(rows, (2.0, 3.0), 3.0, 40, 6.0).to_pylist()
    assert any(x["lines"] for x in whole) and all(not x["lines"] for x, g in zip(whole, gaps, strict=True) if g is None)
    for most in (1, 50, 400, 3000):
        assert G.read_back(rows, (2.0, 3.0), 3.0, 40, 6.0, most).to_pylist() == whole
    assert G.read_back(rows.slice(3, 9), (2.0, 3.0), 3.0, 40, 6.0).to_pylist() == whole[3:12] and len(G.read_back(rows.slice(0, 0), (2.0,), 3.0, 40, 6.0)) == 0


@pytest.mark.parametrize("seed", range(20))
def test_any_order(seed):
    """Glyphs that stand in no order, lie on one another and differ in height."""
    rng, pages = random.Random(seed), []
    for _ in range(rng.randrange(1, 8)):
        page = []
        for _ in range(rng.randrange(1, 120)):
            x = rng.randrange(0, 60) + rng.choice([0.0, 0.5])
            page.append((x, x + rng.choice([1, 2.5, 4.0]), rng.randrange(0, 60) / rng.choice([1, 2]), 10.0, rng.choice(["a", "b", "é", "日", "😀", "ffi"])))
        pages.append(page if seed % 3 else sorted(page, key=lambda c: (c[2] // 9, c[0])))
    flat = [c for p in pages for c in p]
    drawn = [c[4].encode() for c in flat]
    glyphs = G.Glyphs(np.cumsum([0, *map(len, pages[:-1])]), *(np.array([c[k] for c in flat], float) for k in range(3)), np.frombuffer(b"".join(drawn), np.uint8), np.cumsum([0, *map(len, drawn)]))
    for x in (2.0, 3.0):
        lines = G.read(glyphs, (x,), 3.0)
        text = [lines.text[a:b].tobytes().decode() for a, b in zip(lines.at[:-1], lines.at[1:], strict=True)]
        for k, p in enumerate(pages):
            want = plain_text(p, x)
            assert "\n".join(t for t, n in zip(text, lines.page, strict=True) if n == k) == want and lines.words[0][lines.page == k].sum() == len(want.split())


def test_glyphs_are_no_rows(spark):
    """pdf_layout makes no row of a glyph and sorts none: texts are dealt out once, and set and read once in arrays."""
    plan = __spark_entry__.queries()["pdf_layout"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Generate", "Window", "Sort ", "Join")) and plan.count("Exchange ") == 1 and plan.count("ArrowEvalPython [") == 1


def test_pdf_layout_odd_documents(spark, tmp_path):
    """Repeated and null doc_ids and white space of all kinds, as in its SQL."""
    rows = [*enumerate(ODD), *enumerate(ODD), (None, "no number\nat all"), (100, "a\n\nc d"), (100, "\nb b"), (100, None), (104, "e f\n\n" * 60), (104, "\ng h i\n" * 30 + "\n\n"), (104, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(path := str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT doc_id, words, text, words_3 FROM ({__spark_entry__.oracle_sql()['pdf_layout']})").fetchall()
    got = __spark_entry__.queries()["pdf_layout"](spark, str(tmp_path)).select("doc_id", "words", "text", "words_3").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 10
