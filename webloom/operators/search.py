"""Search: query rewriting, provider responses to one schema, enrichment, response shapes; and the small conversions around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U

# Words that ask for what is current. Fixed values.
TIMELY = """latest recent newest current new now today best top alternative alternatives vs versus comparison compared download install release version
update changelog review reviews ranking rankings guide tutorial""".split()
RANGE_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
INSTRUCTION_WORDS = ["find", "get", "extract", "gather", "collect", "the", "all", "from"]
PROXY_KEYWORDS = ["basic", "enhanced", "auto"]
_YEAR = r"\b20[2-9]\d\b"
#: Per provider and source the array of items and the paths of its fields in the JSON answer. Fixed values.
PROVIDERS = {
    ("brave", "web"): ("$.web.results", {"url": "url", "title": "title", "description": "description"}),
    ("brave", "images"): ("$.results", {"url": "url", "title": "title", "description": "source", "thumbnail": "thumbnail.src"}),
    ("brave", "news"): ("$.results", {"url": "url", "title": "title", "description": "description", "published_at": "age", "source_name": "meta_url.hostname"}),
    ("serper", "web"): ("$.organic", {"url": "link", "title": "title", "description": "snippet"}),
    ("serper", "images"): ("$.images", {"url": "imageUrl", "title": "title", "description": "source", "thumbnail": "thumbnailUrl", "image_width": "imageWidth", "image_height": "imageHeight"}),
    ("serper", "news"): ("$.news", {"url": "link", "title": "title", "description": "snippet", "published_at": "date", "source_name": "source"}),
    ("serpapi", "web"): ("$.organic_results", {"url": "link", "title": "title", "description": "snippet"}),
    ("serpapi", "images"): ("$.images_results", {"url": "original", "title": "title", "description": "source", "thumbnail": "thumbnail", "image_width": "original_width", "image_height": "original_height"}),
    ("serpapi", "news"): ("$.news_results", {"url": "link", "title": "title", "description": "snippet", "published_at": "date", "source_name": "source.name"}),
    ("tavily", "web"): ("$.results", {"url": "url", "title": "title", "description": "content"}),
    ("tavily", "news"): ("$.results", {"url": "url", "title": "title", "description": "content", "published_at": "published_date"}),
    ("exa", "web"): ("$.results", {"url": "url", "title": "title", "description": "text", "published_at": "publishedDate"}),
    ("exa", "news"): ("$.results", {"url": "url", "title": "title", "description": "text", "published_at": "publishedDate"}),
    ("searxng", "web"): ("$.results", {"url": "url", "title": "title", "description": "content"}),
    ("searxng", "images"): ("$.results", {"url": "url", "title": "title", "description": "content", "thumbnail": "thumbnail_src", "image_width": "img_format.width", "image_height": "img_format.height"}),
    ("searxng", "news"): ("$.results", {"url": "url", "title": "title", "description": "content", "published_at": "publishedDate", "source_name": "engine"}),
    ("duckduckgo", "web"): ("$.results", {"url": "href", "title": "title", "description": "body"}),
    ("duckduckgo", "images"): ("$.results", {"url": "image", "title": "title", "description": "source", "thumbnail": "thumbnail", "image_width": "width", "image_height": "height"}),
    ("duckduckgo", "news"): ("$.results", {"url": "url", "title": "title", "description": "body", "published_at": "date", "source_name": "source"}),
}
ITEM = ["url", "title", "description", "thumbnail", "image_width", "image_height", "published_at", "source_name"]


def domain_query(query: Column, include: Column, exclude: Column) -> Column:
    """The query with site operators: included domains are alternatives, excluded ones each left out."""
    ors = F.array_join(F.transform(include, lambda d: F.concat(F.lit("site:"), d)), " OR ")
    inner = F.when(F.size(include) > 1, F.concat(F.lit("("), ors, F.lit(")"))).when(F.size(include) == 1, ors)
    out = F.when(F.size(exclude) > 0, F.array_join(F.transform(exclude, lambda d: F.concat(F.lit("-site:"), d)), " "))
    bare = F.trim(query)
    return F.concat_ws(" ", F.when(bare != "", bare), inner, out)


def start_date(time_range: Column, now: Column) -> Column:
    """The first day of a relative range, as a date; null for no or an unknown range."""
    days = F.try_element_at(F.create_map(*[F.lit(x) for kv in RANGE_DAYS.items() for x in kv]), time_range)
    return F.date_sub(F.to_date(now), days)


def us_date(iso: Column) -> Column:
    """M/D/YYYY without padding; null for what is no ISO date."""
    return F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "M/d/yyyy")


def full_datetime(iso: Column) -> Column:
    return F.when(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).isNotNull(), F.concat(iso, F.lit("T00:00:00.000Z")))


def with_year(query: Column, year: int) -> Column:
    """A query for something current gets the year, or has a past one replaced."""
    words = F.transform(F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower)
    found = F.regexp_extract(query, _YEAR, 0)
    dated = F.when(found == "", F.concat(query, F.lit(f" {year}"))).when(found.try_cast("int") < year, F.regexp_replace(query, _YEAR, str(year))).otherwise(query)
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, TIMELY))), dated).otherwise(query)


def prompt_query(prompt: Column) -> Column:
    """A search query from an instruction: its words of command go, also inside longer words, and 100 characters stay."""
    out = F.lower(prompt)
    for word in INSTRUCTION_WORDS:
        out = F.replace(out, F.lit(word), F.lit(" "))
    return F.substring(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")), 1, 100)


def clamp(limit: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(1), limit))


def items(responses: DataFrame, limit: int = 10) -> DataFrame:
    """Stored answers (search, provider, source, body) as one row an item in one schema, with its place. Unknown providers give none. Where an answer's items and
    their fields are is looked up by provider and source, so that the answers are read once whatever providers there are."""
    places = []
    for (provider, source), (path, fields) in PROVIDERS.items():
        paths = [F.lit(f"$.{fields[k]}" if k in fields else None).cast("string").alias(k) for k in ITEM]
        places += [F.lit(f"{provider} {source}"), F.struct(F.lit(path).alias("path"), *paths)]
    at = F.try_element_at(F.create_map(*places), F.concat("provider", F.lit(" "), "source"))
    known = responses.select("search", "provider", "source", "body", at.alias("at")).where("at IS NOT NULL")
    listed = F.from_json(F.call_function("get_json_object", F.col("body"), F.col("at.path")), "array<string>")
    rows = known.select("search", "provider", "source", "at", F.posexplode(listed).alias("ordinal", "item")).where(F.col("ordinal") < limit)
    of = lambda k: F.call_function("get_json_object", F.col("item"), F.col(f"at.{k}"))
    typed = {"image_width": "int", "image_height": "int"}
    return rows.select("search", "provider", F.col("source").alias("source_type"), "ordinal", *[(of(k).try_cast(typed[k]) if k in typed else of(k)).alias(k) for k in ITEM])


def enriched(found: DataFrame, scraped: DataFrame) -> DataFrame:
    """Web items with the columns that scraping added, by url; others and their order as they were. A url scraped more than once counts once,
    so that no item is multiplied: the last by ``scraped_at`` where there is one, else the last by its columns' text."""
    rest = [c for c in scraped.columns if c != "url"]
    order = F.struct(*[F.col(c) for c in rest if c == "scraped_at"], F.to_json(F.struct(*rest)).alias("text"))
    once = scraped.where(F.col("url").isNotNull()).groupBy("url").agg(F.max_by(F.struct(*rest), order).alias("r")).select("url", "r.*", F.lit("web").alias("source_type"))
    return found.join(once, ["url", "source_type"], "left")


def bucketed(found: DataFrame) -> DataFrame:
    """Per search the items as one list a source type, in order: web and images of all, news with their dates."""
    of = lambda kind, *names: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("source_type") == kind, F.struct("ordinal", *names)))), lambda x: F.struct(*[x[n].alias(n) for n in names])
    )
    return found.groupBy("search").agg(of("web", "url", "title", "description").alias("web"), of("images", "url", "title", "thumbnail").alias("images"), of("news", "url", "title", "published_at").alias("news"))


def json_salvage(text: Column) -> Column:
    """The JSON of a model's answer: the whole of it, or a fenced block; null if none parses."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    whole, fenced, plain = bare(text), bare(F.regexp_extract(text, r"(?s)```json(.*?)```", 1)), bare(F.regexp_extract(text, r"(?s)```[^\n]*\n(.*?)```", 1))
    ok = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(whole), ok(fenced), ok(plain))


def proxy(value: Column) -> Column:
    """A proxy's url; names of managed pools mean none."""
    return F.when(~F.lower(value).isin(*PROXY_KEYWORDS, "true", "false"), value)


def pdf_date(raw: Column) -> Column:
    """ISO form of a PDF date; anything else as it is."""
    cleaned = F.regexp_replace(F.trim(raw), "^D:", "")
    pattern = r"^(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?"
    g = lambda k: F.regexp_extract(cleaned, pattern, k)
    two = lambda k: F.when(g(k) == "", F.lit("00")).otherwise(g(k))
    return F.when(g(1) != "", F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"), two(4), F.lit(":"), two(5), F.lit(":"), two(6), F.lit("Z"))).otherwise(raw)


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a markdown table: null cells empty, bars escaped, all rows as wide as the first."""
    clean = lambda c: F.replace(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), F.lit("|"), F.lit("\\|"))
    width = F.size(F.get(rows, 0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: clean(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.coalesce(width, F.lit(0)) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")).otherwise("")


def heading_levels(chars: DataFrame) -> DataFrame:
    """Per line (doc, line, size) the heading level by its size against the document's most common one: 1.8, 1.4 and 1.15 times."""
    body = chars.groupBy("doc").agg(F.mode(F.round("size", 0)).alias("body"))
    ratio = F.col("size") / F.col("body")
    return chars.join(body, "doc").select("doc", "line", F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.15, 3).alias("level"))


def header_map(lines: Column) -> Column:
    """``Key: Value`` strings as a map, without those that have no colon; of a key named twice the last counts."""
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def scoped_headers(headers: Column, target: Column, start: Column) -> Column:
    """The headers, where the target has the start's origin."""
    return F.when(U.origin(target) == U.origin(start), headers)


def provider_chain(config: DataFrame, strict: bool = False) -> DataFrame:
    """Which providers (name, position, configured, has_key, keyless) take part and in which place. Without strictness the keyless one comes
    last if the only configured provider is one without its key."""
    ready = config.where("configured AND (has_key OR keyless)")
    lone = config.where("configured").agg((F.count("*") == 1).alias("one"), F.bool_and(~F.col("has_key") & ~F.col("keyless")).alias("bare"))
    extra = config.where("keyless AND NOT configured").join(F.broadcast(lone.where("one AND bare")), F.lit(True), "left_semi") if not strict else config.limit(0)
    return ready.select("name", "position").unionByName(extra.select("name", F.lit(10**6).alias("position")))


def page_of(rows: DataFrame, order: str, offset: int, size: int = 10) -> DataFrame:
    """One page of a job's results, in order."""
    return rows.orderBy(order).offset(offset).limit(size)


def next_page(totals: DataFrame, offset: int, size: int = 10, base_url: str = "") -> DataFrame:
    """Jobs (job, total) with the address of the page behind that from ``offset``; null where there is none."""
    return totals.select("job", "total", F.when(F.col("total") > offset + size, F.concat(F.lit(base_url), F.col("job").cast("string"), F.lit(f"?offset={offset + size}"))).alias("next"))


def batch_rollup(results: DataFrame, continue_on_error: bool = True) -> DataFrame:
    failed = F.count_if(~F.col("success"))
    return results.agg(F.count_if("success").alias("succeeded"), failed.alias("failed"), (F.lit(continue_on_error) & (failed > 0)).alias("partial"), F.bool_and("success").alias("all_success"))


def batch_paths(results: DataFrame) -> DataFrame:
    """Output file names of urls (ordinal, url) from host and path; a name taken by an earlier url gets eight digits of the url's hash."""
    from pyspark.sql import Window

    slug = F.regexp_replace(F.concat(U.part(F.col("url"), 2), U.part(F.col("url"), 3)), r"[^A-Za-z0-9._-]+", "_")
    own = F.regexp_replace(slug, r"^_+|_+$", "")
    named = results.withColumn("slug", F.when(own == "", "index").otherwise(own))
    firsts = named.groupBy("slug").agg(F.min("ordinal").alias("first"))
    return named.join(firsts, "slug").select(
        "ordinal", "url", F.concat(F.col("slug"), F.when(F.col("ordinal") > F.col("first"), F.concat(F.lit("_"), F.substring(F.sha2("url", 256), 1, 8))).otherwise(""), F.lit(".md")).alias("path")
    )


def unfinished(urls: DataFrame, manifest: DataFrame) -> DataFrame:
    """Urls that the manifest does not name yet."""
    return urls.join(manifest.select("url").distinct(), "url", "left_anti")


def map_entries(entries: DataFrame) -> DataFrame:
    """Urls of map entries (url, allowed, included) that are not ruled out: normalised, once each, in order."""
    return entries.where("coalesce(allowed, true) AND coalesce(included, true)").select(U.normalise(F.col("url")).alias("url")).distinct().orderBy("url")


def job_status(events: DataFrame) -> DataFrame:
    """Per job (job, kind in page, error, complete) the status by the three policies: fails at any error, at no success, never."""
    got = events.groupBy("job").agg(F.count_if(F.col("kind") == "page").alias("pages"), F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "complete").alias("complete"))
    end = F.when(F.col("complete") > 0, "completed").otherwise("running")
    return got.select("job", "pages", "errors", F.when(F.col("errors") > 0, "failed").otherwise(end).alias("any_error"), F.when((F.col("pages") == 0) & (F.col("errors") > 0), "failed").otherwise(end).alias("no_success"), end.alias("never"))
