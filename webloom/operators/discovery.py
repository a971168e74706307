"""Finding urls: robots files, sitemaps, link graphs."""

from __future__ import annotations

import gzip
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.session import written

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def robots_rules(files: DataFrame, user_agent: str = "*") -> DataFrame:
    """One row a rule of each robots file (origin, content): kind in allow, disallow, sitemap, crawl-delay, request-rate.

    Lines belong to the last user-agent line above them. Rules hold for the named agent, and those for ``*`` until a section
    of the named agent begins. Sitemaps hold for all. Null content: no rules."""
    agent = user_agent.lower()
    lines = files.select("origin", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("pos", "raw")).select(
        "origin", "pos", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("line")
    )
    parsed = lines.where(F.contains("line", F.lit(":"))).select(
        "origin", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("kind"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value")
    )
    above = Window.partitionBy("origin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = parsed.withColumn("agent", F.last(F.when(F.col("kind") == "user-agent", F.lower("value")), ignorenulls=True).over(above)).withColumn(
        "met", F.max(F.when((F.col("kind") == "user-agent") & (F.lower("value") == agent), 1).otherwise(0)).over(above)
    )
    ours = (F.col("agent") == agent) | ((F.col("agent") == "*") & (F.col("met") == 0))
    rate = F.split("value", "/")
    value = F.when(
        F.col("kind") == "request-rate", F.try_divide(rate[0].try_cast("double"), F.get(rate, 1).try_cast("double")).cast("string")
    ).otherwise(F.col("value"))
    kept = named.where(
        (F.col("value") != "")
        & (((F.col("kind") == "sitemap")) | (ours & F.col("kind").isin("allow", "disallow", "request-rate")) | (ours & (F.col("kind") == "crawl-delay") & F.col("value").rlike(_NUMBER)))
    )
    rules = kept.select("origin", "pos", "kind", value.alias("value")).where("value IS NOT NULL")
    # Of a sitemap named twice the first counts; of delays and rates the last.
    single = Window.partitionBy("origin", "kind").orderBy(F.desc("pos"))
    twice = Window.partitionBy("origin", "kind", "value").orderBy("pos")
    return (
        rules.withColumn("last", F.row_number().over(single))
        .withColumn("copy", F.row_number().over(twice))
        .where("(kind NOT IN ('crawl-delay', 'request-rate') OR last = 1) AND (kind <> 'sitemap' OR copy = 1)")
        .select("origin", "pos", "kind", "value")
    )


def allowed_by_robots(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every page with the lengths of the longest allow and disallow rule that its path matches (-1: none) and whether it may be
    fetched: the longer wins, a tie allows. An origin's rules are gathered in one row, so a page meets only its own."""
    own = (
        rules.where("kind IN ('allow', 'disallow')")
        .select("origin", "kind", F.length("value").alias("n"), U.robots_pattern(F.col("value")).alias("pattern"))
        .groupBy("origin")
        .agg(F.collect_set(F.struct("kind", "n", "pattern")).alias("rules"))
    )
    longest = lambda kind: F.coalesce(
        F.array_max(F.transform(F.filter("rules", lambda r: (r["kind"] == kind) & F.rlike(F.col("path"), r["pattern"])), lambda r: r["n"])),
        F.lit(-1),
    )
    return (
        pages.withColumn("origin", U.origin(F.col("url")))
        .withColumn("path", U.path_of(F.col("url")))
        .join(own, "origin", "left")
        .withColumn("longest_allow", longest("allow"))
        .withColumn("longest_disallow", longest("disallow"))
        .withColumn("allowed", (F.col("longest_disallow") == -1) | (F.col("longest_allow") >= F.col("longest_disallow")))
    )


def first_of_form(urls: DataFrame, form: Column, ordinal: str) -> DataFrame:
    """The first row, by ``ordinal``, of each value of ``form``. Only the winner of each form crosses the shuffle per task."""
    names = [c for c in urls.columns if c != "form"]
    keyed = urls.select(*names, form.alias("form"))
    return keyed.groupBy("form").agg(F.min_by(F.struct(*names), ordinal).alias("r")).select("r.*", "form")


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of root-relative links in the pages' html, fragments cut."""
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)
    found = F.regexp_extract_all("html", F.lit('href="(/[^"#]*)'), F.lit(1))
    return pages.select(F.regexp_extract("url", "^([^#]*)", 1).alias("src"), F.explode(F.transform(found, lambda x: F.concat(base, x))).alias("dst")).distinct()


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Breadth-first levels from ``seeds`` (url) over ``links`` (src, dst): (url, depth) with the least depth. The depth is a bound of
    the crawl, so there are that many joins, without a loop over collected rows; each level leaves out what is known and is written, so that no level is
    worked out again for the next."""
    links = written(links.select("src", "dst"))
    known = frontier = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, frontier.url == links.src).select(F.col("dst").alias("url")).distinct()
        frontier = written(step.join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(frontier)
    return known


def discovered(reached: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Union of crawled and listed urls, each with its least depth (listed: 0)."""
    return reached.unionByName(sitemap.withColumn("depth", F.lit(0))).groupBy("url").agg(F.min("depth").alias("depth"))


SITEMAP_LIMIT, SITEMAP_DEPTH = 10_000, 3


_SITEMAP = "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>, sitemap array<struct<loc:string>>, broken string"


def sitemap_text(body: Column) -> Column:
    """Sitemap files as text: unpacked where they are gzip, whatever they are called, as UTF-8 or what their XML declaration names; null for what cannot be read."""

    @F.pandas_udf("string")
    def read(bodies: pd.Series) -> pd.Series:
        return pd.Series([_decoded(b) for b in bodies], dtype=object)

    return read(body)


def _decoded(body: bytes | None) -> str | None:
    if body is None:
        return None
    try:
        if body[:2] == b"\x1f\x8b":
            body = gzip.decompress(body)
        named = re.match(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([\w.:-]+)", body)
        return body.decode(named[1].decode() if named else "utf-8-sig")
    except (OSError, EOFError, zlib.error, LookupError, UnicodeDecodeError):
        return None


def sitemap_entries(files: DataFrame) -> DataFrame:
    """Rows of sitemap documents (url, xml), whatever their namespace: kind (page or index, by the root element), loc, lastmod, changefreq, priority. Documents that are no well-formed XML
    or have another root give none."""
    root = F.lower(F.regexp_extract("xml", r"(?s)^\x{FEFF}?(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>)*<(?:[\w.-]+:)?([\w.-]+)", 1))
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true", "columnNameOfCorruptRecord": "broken"}
    read = files.select("url", root.alias("root"), F.from_xml("xml", _SITEMAP, options).alias("x")).where("x.broken IS NULL")
    nothing = F.lit(None).cast("string")
    listed = F.transform("x.sitemap", lambda s: F.struct(s["loc"].alias("loc"), nothing.alias("lastmod"), nothing.alias("changefreq"), nothing.alias("priority")))
    kind = F.when(F.col("root") == "sitemapindex", "index").when(F.col("root") == "urlset", "page")
    rows = read.withColumn("kind", kind).select("url", "kind", F.explode(F.when(F.col("kind") == "index", listed).when(F.col("kind") == "page", F.col("x.url"))).alias("e"))
    field = lambda name: F.nullif(F.trim(f"e.{name}"), F.lit(""))
    return rows.select(
        "url", "kind", field("loc").alias("loc"), parse_lastmod(field("lastmod")).alias("lastmod"), field("changefreq").alias("changefreq"),
        field("priority").try_cast("double").alias("priority"),
    ).where("loc IS NOT NULL")


def parse_lastmod(text: Column) -> Column:
    """ISO times with or without zone, or bare dates; null for anything else."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def sitemap_urls(files: DataFrame, roots: DataFrame, limit: int | None = SITEMAP_LIMIT, depth: int = SITEMAP_DEPTH, once: bool = True) -> DataFrame:
    """Pages listed by ``roots`` (url) and by the index files below them, to ``depth``; the first ``limit`` by url (None: all). Of a page listed with different dates or
    priorities the latest entry counts, then that of the highest priority; all of them without ``once``."""
    entries = written(sitemap_entries(files))
    level, pages = roots.select("url").distinct(), None
    for _ in range(depth + 1):
        here = entries.join(level, "url", "left_semi")
        own = here.where("kind = 'page'").drop("url", "kind")
        pages = own if pages is None else pages.unionByName(own)
        level = written(here.where("kind = 'index'").select(F.col("loc").alias("url")).distinct())
    rest = [c for c in pages.columns if c != "loc"]
    order = F.struct("lastmod", "priority", "changefreq")
    single = pages.groupBy("loc").agg(F.max_by(F.struct(*rest), order).alias("e")).select("loc", "e.*") if once else pages.distinct()
    return single if limit is None else single.orderBy("loc").limit(limit)


def modified_since(entries: DataFrame, since: str) -> DataFrame:
    """Sitemap entries last modified at ``since`` or later; those without a date go."""
    return entries.where(F.col("lastmod") >= F.lit(since).cast("timestamp"))
