"""Files that scraping leaves: names, frontmatter, contents by format, and a writer of one file a row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from webloom.functions import urls as U

#: Fields of a frontmatter in their order; those marked are quoted.
FIELDS = [
    ("url", True), ("title", True), ("scraped_at", False), ("content_hash", False), ("site_id", False), ("snapshot_id", False), ("provider", False), ("timezone", False), ("description", True),
    ("language", False), ("keywords", True), ("robots", False), ("canonical_url", True), ("status_code", False), ("og_title", True), ("og_description", True), ("og_image", True), ("og_url", True),
    ("og_site_name", True), ("word_count", False),
]
ALWAYS = ("url", "title", "scraped_at")


def quoted(text: Column) -> Column:
    """A text in double quotes, backslashes and quotes escaped; null is empty."""
    inner = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def frontmatter(fields: dict[str, Column]) -> Column:
    """YAML between dashes with the fields given, in one order for all. Null, empty and zero fields leave no line, but for url, title and time, if given."""
    lines = []
    for name, quote in FIELDS:
        if name in fields:
            text = fields[name].cast("string")
            value = quoted(text) if quote else F.concat(F.lit("sha256:"), text) if name == "content_hash" else F.coalesce(text, F.lit(""))
            line = F.concat(F.lit(f"{name}: "), value)
            lines.append(line if name in ALWAYS else F.when(~F.coalesce(text, F.lit("")).isin("", "0"), line))
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def file_names(pages: DataFrame) -> DataFrame:
    """``pages`` (ordinal, url, ...) with ``name``: the path with slashes as underscores, or index; a name that an earlier page has taken gets eight digits of the
    url's hash. Only the first page of each name crosses the shuffle."""
    path = F.regexp_replace(F.regexp_replace(U.part(F.col("url"), 3), r"^/+|/+$", ""), "/", "_")
    named = pages.withColumn("name", F.when(path == "", F.lit("index")).otherwise(path))
    firsts = named.groupBy("name").agg(F.min("ordinal").alias("__first"))
    suffix = F.when(F.col("ordinal") > F.col("__first"), F.concat(F.lit("_"), F.substring(F.sha2("url", 256), 1, 8))).otherwise("")
    return named.join(firsts, "name").withColumn("name", F.concat("name", suffix)).drop("__first")


def crawl_files(scraped: DataFrame, formats: tuple[str, ...] = ("markdown",)) -> DataFrame:
    """(file, content) of scraped pages (ordinal, url, title, description, markdown, html): markdown with a short frontmatter and html where
    there is any, JSON of everything for each."""
    named = file_names(scraped)
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("source_url: "), F.col("url")), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("title: "), F.col("title"))), F.lit("---"))
    everything = F.to_json(F.struct("url", "markdown", "html", F.struct("title", "description", F.col("url").alias("source_url")).alias("metadata")), {"ignoreNullFields": "false"})
    of = {
        "markdown": F.when(F.coalesce("markdown", F.lit("")) != "", F.struct(F.lit(".md").alias("end"), F.concat(head, F.lit("\n\n"), F.col("markdown")).alias("content"))),
        "html": F.when(F.coalesce("html", F.lit("")) != "", F.struct(F.lit(".html").alias("end"), F.col("html").alias("content"))),
        "json": F.struct(F.lit(".json").alias("end"), everything.alias("content")),
    }
    files = named.select("name", F.explode(F.array_compact(F.array(*[of[f] for f in formats]))).alias("f"))
    return files.select(F.concat("name", "f.end").alias("file"), "f.content")


def scrape_content(suffix: str, page: dict[str, Column]) -> Column:
    """What one scraped page leaves in a file by its suffix, as bytes: JSON of all fields, html, a decoded picture or PDF, the summary, else markdown below a
    frontmatter of the page's metadata."""
    suffix = suffix.lower()
    if suffix == ".json":
        return F.to_json(F.struct(*[c.alias(k) for k, c in page.items()])).cast("binary")
    if suffix in (".png", ".pdf"):
        return F.unbase64(page["screenshot" if suffix == ".png" else "pdf"])
    if suffix in (".html", ".txt"):
        return page["html" if suffix == ".html" else "summary"].cast("binary")
    return F.concat(frontmatter(page), F.lit("\n\n"), page["markdown"]).cast("binary")


def write_files(files: DataFrame, path: str) -> None:
    """One file a row (file, content) below ``path``, which any file system that Arrow knows may hold. A task that is run again writes the same files again."""

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{r.file}") as out:
                out.write(r.content.encode() if isinstance(r.content, str) else bytes(r.content))

    files.select("file", "content").where("content IS NOT NULL").foreachPartition(write)


def manifest(files: DataFrame) -> DataFrame:
    """What a later crawl leaves out: the distinct urls that were scraped."""
    return files.select("url").distinct()

