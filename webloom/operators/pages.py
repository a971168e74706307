"""One fused pass over raw pages: a page is parsed once for all the formats asked for (once more where selectors cut the markdown)."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.dom import extract as E
from webloom.dom import render as R
from webloom.dom.markdown import full_markdown, main_markdown, prepare
from webloom.dom.tree import SelectorError, parse, select
from webloom.session import written

_META = ["title", "description", "language", "keywords", "robots", "canonical_url", "og_title", "og_description", "og_image", "og_url", "og_site_name", "timezone"]
_TEXTS, _TEXT = pa.list_(pa.string()), pa.string()
_TYPES = {
    "markdown": (_TEXT, "string"), "strategy": (_TEXT, "string"), "full_markdown": (_TEXT, "string"), "html": (_TEXT, "string"), "links": (_TEXTS, "array<string>"), "images": (_TEXTS, "array<string>"),
    "metadata": (pa.struct([(k, _TEXT) for k in _META]), "struct<" + ",".join(f"{k}:string" for k in _META) + ">"),
    "structured_data": (_TEXT, "string"), "branding": (_TEXT, "string"),
}
FORMATS = tuple(_TYPES)


def _one(url: str, html: str, formats: tuple[str, ...], only_main: bool, include: list[str] | None, exclude: list[str] | None, mode: float, query: str | None) -> dict:
    """The formats of a page from one tree: first those that only read it, then those that cut it, from the least cut to the most."""
    out: dict = {}
    root = parse(html)
    if "metadata" in formats:
        out["metadata"] = E.metadata(root)
    if "links" in formats:
        out["links"] = E.links(root, url)
    if "images" in formats:
        out["images"] = E.images(root, url)
    if "structured_data" in formats:
        out["structured_data"] = json.dumps(E.structured_data(root, url), sort_keys=True, ensure_ascii=False)
    if "branding" in formats:
        out["branding"] = json.dumps(E.branding(root, url), sort_keys=True, ensure_ascii=False)
    markdown, full, cleaned = "markdown" in formats or "strategy" in formats, "full_markdown" in formats, "html" in formats
    # A site's preprocessor rewrites the tree for markdown only; a caller's selectors take a tree that has lost nothing yet.
    if cleaned:
        out["html"] = E.cleaned(root, only_main, include, exclude)
    prepare(root)
    if full:
        out["full_markdown"] = full_markdown(root, url)
    if markdown and (include or exclude):
        root = parse(html)
        prepare(root)
        out["markdown"], out["strategy"] = main_markdown(root, url, only_main, include, exclude, mode, query)
    elif markdown and only_main:
        out["markdown"], out["strategy"] = main_markdown(root, url, True, None, None, mode, query)
    elif markdown:
        out["markdown"], out["strategy"] = out["full_markdown"] if full else full_markdown(root, url), "page"
    return out


def scrape(pages: DataFrame, formats: tuple[str, ...] = ("markdown", "links", "metadata"), key: str = "page_id", only_main: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, mode: float = 0.5, query: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, url, html) to key, url, the columns to ``carry`` along and the named formats, no others being computed. Structured data and branding are
    JSON texts, html is the main content's cleaned markup, strategy how the markdown's part of the page was found: selector, readable, body, include, page.

    Null html is an empty page; a null url resolves no links. Repeated rows: each. Null keys: kept."""
    first = list(dict.fromkeys([key, "url", *carry]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_one(u or "", h or "", formats, only_main, include, exclude, mode, query) for u, h in zip(batch.column(at).to_pylist(), batch.column(len(first)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(first)], *[pa.array([r[f] for r in rows], _TYPES[f][0]) for f in formats]], names=[*first, *formats])

    at = first.index("url")
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in first)
    return pages.select(*first, F.col("html").alias("__html")).mapInArrow(run, f"{kinds}, " + ", ".join(f"{f} {_TYPES[f][1]}" for f in formats))


REFERENCE = "reference string, full_text string, headings long, tables long, code long, images long, links long, reference_error boolean"


def references(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """What stored pages (key, html) show: (key, reference, full_text, headings, tables, code, images, links, reference_error), the reference being the main text. It stands in for what a
    browser would render, without what scripts add. No html is an error, with a null text. Repeated rows: each. Null keys: kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [R.reference(parse(h)) if h else dict.fromkeys(["main_text", "full_text", *R.COUNTED]) for h in batch.column(1).to_pylist()]
            texts = [pa.array([m[k] for m in made], _TEXT) for k in ("main_text", "full_text")]
            counts = [pa.array([m[k] for m in made], pa.int64()) for k in R.COUNTED]
            yield pa.RecordBatch.from_arrays([batch.column(0), *texts, *counts, pa.array([m["full_text"] is None for m in made])], names=[key, *[c.split()[0] for c in REFERENCE.split(", ")]])

    return pages.select(key, "html").mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {REFERENCE}")


def recovered(scraped: DataFrame, floor: int = 50, ratio: int = 3) -> DataFrame:
    """Full markdown instead of the main content's where that is thin and the full one is at least ``ratio`` times as long."""
    words = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"))
    main, full = words(F.col("markdown")), words(F.col("full_markdown"))
    return scraped.withColumn("markdown", F.when((main < floor) & (full >= F.greatest(F.lit(floor), ratio * main)), F.col("full_markdown")).otherwise(F.col("markdown")))


def matches_selector(html: Column, selector: Column) -> Column:
    """Whether a page has an element for a css selector; an unsupported selector matches nothing."""

    def one(h: str | None, s: str | None) -> bool:
        try:
            return bool(h and s and select(parse(h), s))
        except SelectorError:
            return False

    @F.pandas_udf("boolean")
    def found(pages: pd.Series, selectors: pd.Series) -> pd.Series:
        return pd.Series([one(h, s) for h, s in zip(pages, selectors, strict=True)])

    return found(html, selector)


def bm25_sections(sections: DataFrame, query: str, mode: float = 0.5, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Sections (page, section, text) with their Okapi score within the page and whether they stay; all by aggregation, no page in one task's memory. Rows of one section
    are one section's text, and each has a score.

    Of a section only its length and how often it has the words asked for go out. Other words matter by how many sections of the page have them: they are counted on
    both sides of a shuffle, and a page is left with as many numbers as those counts differ."""
    asked = Counter(query.lower().split())
    words = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda t: t != "")
    has = lambda n: F.array(*[n(k) for k in range(len(asked))]).cast("array<long>")
    times_of = lambda q: F.size(F.filter("tokens", lambda t: t == q))
    within, page = Window.partitionBy("page", "section"), Window.partitionBy("page")
    sized = sections.select("page", "section", words.alias("tokens")).select("page", "section", F.size("tokens").alias("length"), *[times_of(q).alias(f"tf{k}") for k, q in enumerate(asked)])
    placed = sized.repartition("page").withColumn("nth", F.row_number().over(within.orderBy("length")))
    placed = placed.select("page", "section", "length", "nth", has(lambda k: F.sum(f"tf{k}").over(within)).alias("tf"))
    some = F.col("length") > 0
    placed = placed.withColumn("n", F.count_if(some).over(page)).withColumn("mean", F.avg(F.when(some, F.col("length"))).over(page))
    placed = placed.withColumn("df", has(lambda k: F.count_if((F.col("nth") == 1) & (F.col("tf")[k] > 0)).over(page)))

    terms = sections.select("page", F.explode(F.array_distinct(words)).alias("t"), F.lit(1).alias("sections"))
    repeated = written(sized.groupBy("page", "section").count().where("count > 1").select("page", "section"))
    if not repeated.isEmpty():
        # What several rows of a section have counts once.
        again = sections.join(repeated, ["page", "section"]).select("page", "section", F.explode(F.array_distinct(words)).alias("t"))
        terms = terms.unionByName(again.groupBy("page", "section", "t").count().select("page", "t", (1 - F.col("count")).cast("int").alias("sections")))
    shared = terms.groupBy("page", "t").agg(F.sum("sections").alias("df")).groupBy("page", "df").agg(F.count("*").alias("terms"))
    shared = shared.groupBy("page").agg(F.collect_list(F.struct("df", "terms")).alias("shared"))

    rarity = lambda n, df: F.log((n - df + 0.5) / (df + 0.5))
    total = F.aggregate("shared", F.lit(0.0), lambda s, d: s + d["terms"] * rarity(F.col("n"), d["df"]))
    floor = epsilon * total / F.aggregate("shared", F.lit(0).cast("long"), lambda s, d: s + d["terms"])
    scored = placed.join(shared, "page", "left").withColumn("floor", floor)
    parts = F.lit(0.0)
    for k, times in enumerate(asked.values()):
        tf, raw = F.col("tf")[k], rarity(F.col("n"), F.col("df")[k])
        gain = times * F.when(raw >= 0, raw).otherwise(F.col("floor")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        parts = parts + F.when(tf > 0, gain).otherwise(0.0)
    scored = scored.withColumn("score", F.coalesce(F.sum(parts).over(within), F.lit(0.0)))
    best, count = F.max("score").over(page), F.count("*").over(page)
    return scored.select("page", "section", "score", ((count == 1) | (best == 0) | (F.col("score") >= 0.20 * mode * best)).alias("kept"))
