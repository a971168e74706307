"""The services, as compositions: scrape, batch, crawl, search, benchmark and diagnosis over tables of what was fetched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import detection as D
from webloom.functions import edits
from webloom.functions import quality as Q
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import benchmark, discovery, folds, pages, search, versions

#: Rungs of the ladder after a first try; the last of them is the strongest engine. Values of the engine's own vocabulary.
LADDER = [(None, False), ("playwright", True), ("camoufox", False)]


def scrape(raw: DataFrame, formats: tuple[str, ...] = ("markdown", "links", "metadata"), key: str = "page_id", **options) -> DataFrame:  # noqa: ANN003
    """Pages (key, url, html, status) with the formats and an assessment: words, verdict, score, success, error and suggestion.

    Formats are parsed in one pass, which carries the key, status and html along, so that nothing is joined back: repeated rows and null keys stay as they
    are. The rest are expressions."""
    wanted = tuple(dict.fromkeys([*formats, "markdown"]))
    out = pages.scrape(raw.withColumn("raw_html", F.col("html")), wanted, key, carry=("status", "raw_html"), **options)
    md = F.col("markdown")
    out = out.withColumn("word_count", T.word_count(md)).withColumn("verdict", Q.page_verdict(F.col("status"), F.col("raw_html"), F.col("word_count")))
    score = Q.reference_free_score(F.col("word_count"), T.structure(md)["links"], T.word_spacing(md))
    out = out.withColumn("score", Q.capped(score, F.col("verdict"))).withColumn("success", Q.usable(F.col("verdict")))
    out = out.withColumn("error", Q.error_message(F.col("verdict"), F.array().cast("array<string>"))).withColumn("suggestion", F.when(F.col("verdict") != "ok", Q.suggestion(F.col("verdict"))))
    return out.drop("raw_html", *[f for f in wanted if f not in formats])


def batch(urls: DataFrame, raw: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Results in the order of the list (ordinal, url) over any pages (url, html, status); a url without a page fails. Only listed pages are parsed, a
    page that is there more than once counts once, a url listed more than once gets a result each time."""
    listed = raw.join(urls.select("url").distinct(), "url", "left_semi").dropDuplicates(["url"])
    done = scrape(listed, key="url", **options)
    out = urls.join(done, "url", "left").withColumn("success", F.coalesce("success", F.lit(False)))
    return out.withColumn("error", F.when(F.col("verdict").isNull(), "No page was fetched for this url.").otherwise(F.col("error"))).orderBy("ordinal")


def discover(raw: DataFrame, start: str, sitemap: DataFrame | None = None, depth: int = 3, limit: int | None = 200, search_text: str | None = None, subdomains: bool = False, ignore_query: bool = False) -> DataFrame:
    """Urls within the start's domain: crawled to ``depth``, listed in sitemaps, limited in url order (None: all), then searched."""
    base = U.hostname(F.lit(start))
    links = discovery.page_links(raw)
    seeds = raw.sparkSession.range(1).select(F.lit(start).alias("url"))
    found = discovery.reachable(links, seeds, depth)
    if sitemap is not None:
        found = discovery.discovered(found, sitemap.select("url"))
    if ignore_query:
        found = found.select(U.without_query(F.col("url")).alias("url"), "depth").groupBy("url").agg(F.min("depth").alias("depth"))
    host = U.hostname(F.col("url"))
    scoped = found.where((host == base) | (host.endswith(F.concat(F.lit("."), base)) if subdomains else F.lit(False)))
    first = scoped if limit is None else scoped.orderBy("url").limit(limit)
    return first.where(F.contains(F.lower("url"), F.lit(search_text.lower()))) if search_text else first


def crawl(found: DataFrame, raw: DataFrame, rules: DataFrame | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), done: DataFrame | None = None, dedupe_similar: bool = False, limit: int | None = 100, **options) -> DataFrame:  # noqa: ANN003
    """Discovered urls, through patterns, robots rules, what is done already and similar forms, to scraped pages."""
    wanted = found.where(U.matches(F.col("url"), list(include), list(exclude)))
    if dedupe_similar:
        wanted = discovery.first_of_form(wanted, U.normalise_for_dedupe(F.col("url")), "url").drop("form")
    if done is not None:
        wanted = search.unfinished(wanted, done)
    if rules is not None:
        wanted = discovery.allowed_by_robots(wanted, rules).where("allowed").select(*wanted.columns)
    first = wanted if limit is None else wanted.orderBy("url").limit(limit)
    return scrape(raw.join(first.select("url"), "url", "left_semi"), **options)


def search_and_scrape(responses: DataFrame, raw: DataFrame, limit: int = 5, **options) -> DataFrame:  # noqa: ANN003
    """Items of stored answers, web items with their page's markdown where there is one."""
    found = search.items(responses, min(10, max(1, limit)))
    return search.enriched(found, scrape(raw, ("markdown",), **options).select("url", "markdown", "word_count"))


def track_changes(scraped: DataFrame, history: DataFrame, modes: tuple[str, ...] = ()) -> DataFrame:
    """Scraped pages (url, markdown, success) against the newest cached version of their key (cache_key, content_hash, markdown, cached_at)."""
    now = scraped.withColumn("cache_key", U.cache_key(F.col("url"))).withColumn("content_hash", F.sha2(F.coalesce("markdown", F.lit("")), 256))
    last = versions.newest_entries(history).select("cache_key", F.col("content_hash").alias("p_hash"), F.col("markdown").alias("p_markdown"), F.col("cached_at").alias("previous_scrape_at"))
    known = F.col("previous_scrape_at").isNotNull()
    status = F.when(~F.col("success"), F.when(known, "removed")).when(~known, "new").when(F.col("p_hash") == F.col("content_hash"), "same").otherwise("changed")
    out = now.join(last, "cache_key", "left").withColumn("change_status", status)
    if "git-diff" in modes:
        out = out.withColumn("diff", F.when(F.col("change_status") == "changed", edits.unified_diff(F.col("p_markdown"), F.col("markdown"))))
    return out.drop("p_hash", "p_markdown")


def run_benchmark(cases: DataFrame, outputs: DataFrame, references: DataFrame, only: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Case metrics and their roll-up: cases joined with what a provider gave and what the reference holds."""
    joined = benchmark.select_cases(cases, list(only)).join(outputs, "case_id", "left").join(references, "case_id", "left")
    filled = joined.withColumn("success", F.coalesce("success", F.lit(False))).withColumn("reference_error", F.coalesce("reference_error", F.lit(False)))
    metrics = benchmark.score_cases(filled)
    return metrics, benchmark.aggregate_run(metrics)


def diagnose(raw: DataFrame, key: str = "page_id") -> DataFrame:
    """All detectors over pages (key, url, html, headers) and what to try."""
    h, bot = F.col("html"), D.bot_protection(F.col("html"))
    found = raw.select(
        key, "url", D.cdn(F.col("headers")).alias("cdn"), D.js_framework(h).alias("framework"), *[c.alias(k) for k, c in bot.items()],
        D.needs_javascript(h, F.length(h)).alias("requires_js"), D.login_required(h).alias("login_required"), platform(h).alias("platform"),
    )
    got = D.recommendations(F.col("cdn"), F.col("framework"), F.col("captcha_present"), F.col("challenge_detected"), F.col("access_denied"), F.col("requires_js"), F.col("login_required"))
    return found.withColumns(got)


#: Site builders with settings of their own: name to (pattern, settings); extend by adding.
PLATFORMS: dict[str, tuple[str, dict]] = {"foleon": (r"(?i)foleon", {"engine": "camoufox", "wait_for": 8000, "expand_iframes": "all", "only_main_content": False})}


def platform(html: Column) -> Column:
    """The first registered site builder whose mark the page bears."""
    return F.coalesce(*[F.when(html.rlike(p), F.lit(name)) for name, (p, _) in PLATFORMS.items()])


def expectation_met(html: Column, markdown: Column, expect: Column) -> Column:
    """Whether a page shows what a caller expects: a least number of words (digits only), else an element for a css selector, else a text, whatever the case. Null
    expects nothing. Only pages with an expectation that is no number are parsed."""
    text = F.coalesce(markdown, D.visible_text(html), F.lit(""))
    digits = expect.rlike("^[0-9]+$")
    selected = pages.matches_selector(F.when(~digits, html), F.when(~digits, expect))
    return F.when(expect.isNull(), True).when(digits, T.word_count(text) >= expect.try_cast("int")).otherwise(selected | F.contains(F.lower(text), F.lower(expect)))


def with_expectation(scraped: DataFrame, met: Column) -> DataFrame:
    """Scraped pages (expect, success, error, ...), of which those that came without what was expected fail; their verdict stays."""
    unmet = F.col("success") & F.col("expect").isNotNull() & ~met
    told = F.concat(F.lit("The page loaded, but not with what was expected ("), F.col("expect"), F.lit("); wait longer or use a stronger engine."))
    return scraped.withColumns({"success": F.col("success") & ~unmet, "error": F.when(unmet, told).otherwise(F.col("error"))})


def keep_best(attempts: DataFrame) -> DataFrame:
    return folds.best_attempts(attempts)


def http_first(formats: Column, actions: Column, engine: Column, device: Column, stealth: Column) -> Column:
    """Whether a plain request may be tried before a browser."""
    return (
        ~F.arrays_overlap(formats, F.array(F.lit("screenshot"), F.lit("pdf"))) & (F.coalesce(F.size(actions), F.lit(0)) <= 0) & device.isNull()
        & ~F.coalesce(stealth, F.lit(False)) & (F.coalesce(engine, F.lit("playwright")) == "playwright")
    )


def summary_request(scraped: DataFrame, max_length: int | None = None, focus: str | None = None, cut: int = 10_000) -> DataFrame:
    """Pages with the instruction that a model is to follow; the model itself is the caller's."""
    ask = "Summarise the content below" + (f" in at most {max_length} words" if max_length else "") + (f", with a focus on {focus}" if focus else "") + "."
    return scraped.select("url", "markdown", F.concat(F.lit(ask + "\n\n"), F.substring("markdown", 1, cut)).alias("prompt"))


def extract_with(scraped: DataFrame, model: Callable[[Column], Column], prompt: str) -> DataFrame:
    """A model (any Column to Column function, say a pandas UDF) over pages; its JSON is salvaged. All succeed only if each does."""
    answer = model(F.concat(F.lit(prompt + "\n\n"), F.col("markdown")))
    out = scraped.select("url", search.json_salvage(answer).alias("data"))
    return out.withColumn("success", F.col("data").isNotNull())


def compile_results(gathered: DataFrame, cut: int = 50_000) -> DataFrame:
    """What an agent gathered (position, data), as one JSON of items, in order: as many whole items as ``cut`` characters hold, so that it
    parses. No more than ``cut`` items can fit, and only so many first ones, found by each task for itself, come together."""
    first = gathered.where(F.length("data") > 0).orderBy("position").limit(cut)
    both = F.transform(F.array_sort(F.collect_list(F.struct("position", "data"))), lambda x: x["data"])
    fitting = F.aggregate(
        both,
        F.struct(F.lit(12).alias("n"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("items")),
        lambda s, x: F.struct(
            (s["n"] + F.length(x) + 1).alias("n"), (s["open"] & (s["n"] + F.length(x) + 1 <= cut)).alias("open"),
            F.when(s["open"] & (s["n"] + F.length(x) + 1 <= cut), F.concat(s["items"], F.array(x))).otherwise(s["items"]).alias("items"),
        ),
    )
    return first.agg(F.concat(F.lit('{"items":['), F.array_join(fitting["items"], ","), F.lit("]}")).alias("compiled"))


def agent(responses: DataFrame, raw: DataFrame, model: Callable[[Column], Column], prompt: str, steps: int = 10, urls: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """What an agent does between its live calls: the query it asks is ``search.prompt_query`` of its prompt; of the answers (or of ``urls``, where given, each once) it visits the
    first ``steps`` pages, has the model read each, and compiles what came of it, in the order of visits. With a JSON ``schema`` the model is told of it when it reads, and merges
    what was gathered into one result of that form; where its answer is no JSON, the items stay as they are, and nothing gathered is an empty object."""
    spark = raw.sparkSession
    if urls:
        visits = spark.createDataFrame(list(enumerate(urls)), "position int, url string")
    else:
        found = search.items(responses).where("source_type = 'web' AND url IS NOT NULL")
        visits = found.groupBy("url").agg(F.min(F.struct("search", "ordinal")).alias("at")).orderBy("at", "url").limit(steps)
        visits = visits.select(F.row_number().over(Window.orderBy("at", "url")).alias("position"), "url")
    first = visits.where(F.col("position") <= steps)
    conform = f"\n\nOutput must conform to this schema:\n{schema}" if schema else ""
    read = extract_with(batch(first.withColumnRenamed("position", "ordinal"), raw, formats=("markdown",)).where("success"), model, prompt + conform).where("success")
    compiled = compile_results(read.join(first, "url").select("position", F.to_json(F.struct("url", "data")).alias("data")))
    if not schema:
        return compiled
    ask = f"Combine the data extracted from several pages into one result without repeats.{conform}\n\nObjective: {prompt}\n\nData:\n"
    merged = F.coalesce(search.json_salvage(model(F.concat(F.lit(ask), F.col("compiled")))), F.col("compiled"))
    return compiled.select(F.when(F.col("compiled") == '{"items":[]}', "{}").otherwise(merged).alias("compiled"))


#: What a page action may carry.
ACTION = "array<struct<type:string,selector:string,milliseconds:int,text:string,direction:string,key:string,script:string,fullPage:boolean>>"


def page_actions(text: Column) -> Column:
    """A JSON list of page actions as structs; entries without a type go, a screenshot is of the full page unless it says otherwise."""
    return F.transform(
        F.filter(F.from_json(text, ACTION), lambda x: F.coalesce(x["type"], F.lit("")) != ""),
        lambda x: F.struct(*[x[k].alias(k) for k in ("type", "selector", "milliseconds", "text", "direction", "key", "script")], F.coalesce(x["fullPage"], F.lit(True)).alias("full_page")),
    )
