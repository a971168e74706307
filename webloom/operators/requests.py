"""Rules around a request: which frames to expand, which memory to use, what an exception means, who may run, when to warn."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import detection as D
from webloom.functions import urls as U
from webloom.operators.prefixes import ROWS_PER_SLICE, prefixes, sliced
from webloom.session import written

# Hosts whose frames are never expanded: advertising, tracking, CAPTCHA. Fixed values.
BLOCKED_FRAMES = [
    "doubleclick.net", "googlesyndication.com", "amazon-adsystem.com", "adnxs.com", "adsrvr.org", "moatads.com", "taboola.com", "outbrain.com", "google-analytics.com",
    "googletagmanager.com", "analytics.google.com", "connect.facebook.net", "bat.bing.com", "sc-static.net", "hotjar.com", "clarity.ms", "recaptcha.net", "hcaptcha.com",
    "challenges.cloudflare.com",
]
MAX_FRAMES, PIXEL = 10, 5
# Where sitemaps commonly lie, in the order in which they are tried. Fixed values.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps/sitemap.xml", "/sitemap/sitemap.xml"]
#: Seconds between two warnings about a provider's account; jobs that may be active; seconds that a job is kept.
DEBOUNCE, MAX_JOBS, JOB_TTL = 300, 3, 86_400
KNOWN_SOURCES = ["web", "images", "news"]


def expanded_frames(frames: DataFrame, every_origin: bool = False) -> DataFrame:
    """The frames to expand of (page, page_url, ordinal, url, main, width, height, body), innermost first, so many a page: not the main one, with an address and a
    body, no blocked host, larger than a pixel (unknown sizes pass), and of the page's own origin unless ``every_origin``."""
    host = U.hostname(F.col("url"))
    blocked = reduce(lambda a, b: a | b, [(host == d) | host.endswith(f".{d}") for d in BLOCKED_FRAMES])
    site = lambda c: F.concat(U.part(c, 1), F.lit("://"), U.part(c, 2))
    fits = (
        ~F.col("main") & ~F.coalesce("url", F.lit("")).isin("", "about:blank") & ~blocked & (F.trim(F.coalesce("body", F.lit(""))) != "")
        & (F.coalesce("width", F.lit(PIXEL + 1)) > PIXEL) & (F.coalesce("height", F.lit(PIXEL + 1)) > PIXEL)
    )
    if not every_origin:
        fits &= site(F.col("url")) == site(F.col("page_url"))
    place = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("ordinal")))
    return frames.where(fits).withColumn("place", place).where(F.col("place") <= MAX_FRAMES)


def memory_eligible(formats: Column, actions: Column, device: Column) -> Column:
    """Whether what was learned about a domain applies: not to pictures, PDFs, actions or a device's emulation."""
    return ~F.arrays_overlap(formats, F.array(F.lit("screenshot"), F.lit("pdf"))) & (F.coalesce(F.size(actions), F.lit(0)) <= 0) & device.isNull()


def cache_eligible(formats: Column, actions: Column, max_age: Column) -> Column:
    """Whether a cached result may answer: an age is allowed and no action would change the page."""
    return (F.coalesce(max_age, F.lit(0)) > 0) & (F.coalesce(F.size(actions), F.lit(0)) <= 0) & (F.size(formats) > 0)


def exception_family(kind: Column, status: Column, message: Column) -> Column:
    """What an exception means to a caller, as (family, message): by its class, for an HTTP error by its status. A remedy is added where one is known, but not to
    what the caller did wrong."""
    cases = [
        (kind == "invalid_model", "client", "Validation failed: "), (kind == "connect", "connection", "Connection failed: "), (kind == "request_timeout", "timeout", "Request timed out: "),
        ((kind == "http_status") & status.between(400, 499), "client", "HTTP client error ({status}): "), ((kind == "http_status") & (status >= 500), "server", "HTTP server error ({status}): "),
        (kind.isin("connection", "os"), "connection", "Connection failed: "), (kind == "timeout", "timeout", "Operation timed out: "), (kind == "validation", "validation", ""),
        (kind == "configuration", "client", "Configuration error: "), (kind == "provider", "server", "Provider error: "), (kind == "library", "internal", ""), (kind == "value", "validation", ""),
    ]
    plain = kind.isin("invalid_model", "validation", "configuration", "value")
    named = lambda text: F.concat(*[status.cast("string") if k % 2 else F.lit(p) for k, p in enumerate(text.replace("{status}", "\0status\0").split("\0"))]) if "{" in text else F.lit(text)
    family = reduce(lambda c, x: c.when(x[0], F.lit(x[1])), cases[1:], F.when(cases[0][0], F.lit(cases[0][1]))).otherwise("internal")
    start = reduce(lambda c, x: c.when(x[0], named(x[2])), cases[1:], F.when(cases[0][0], named(cases[0][2]))).otherwise("Unexpected error: ")
    hint = F.when(~plain, D.remediation_hint(message))
    return F.struct(family.alias("family"), F.concat(start, message, F.coalesce(F.concat(F.lit(" [HINT: "), hint, F.lit("]")), F.lit(""))).alias("message"))


def config(layers: list[dict[str, Column]]) -> dict[str, Column]:
    """Settings by precedence: the last layer that has a value counts (defaults, then the file, then the environment, then the call)."""
    names = dict.fromkeys(k for layer in layers for k in layer)
    return {k: F.coalesce(*[layer[k] for layer in reversed(layers) if k in layer]) for k in names}


def with_headers(found: DataFrame, heads: DataFrame) -> DataFrame:
    """Search items with what a HEAD request told (heads: url, headers as a map, error): content type without parameters, length, last change. Web items only; a
    failed request adds nothing, a url asked twice counts once."""
    low = F.map_from_entries(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    of = lambda name: F.try_element_at(low, F.lit(name))
    told = F.struct(F.trim(F.substring_index(of("content-type"), ";", 1)).alias("content_type"), of("content-length").try_cast("long").alias("content_length"), of("last-modified").alias("last_modified"))
    once = heads.where("error IS NULL AND url IS NOT NULL").select("url", told.alias("metadata")).groupBy("url").agg(F.min("metadata").alias("metadata"))
    return found.join(once.withColumn("source_type", F.lit("web")), ["url", "source_type"], "left")


def sitemap_candidates(sites: DataFrame, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """Where a site's (origin) sitemaps are: those that its robots file (rules of ``discovery.robots_rules``) names, else the first common path that
    answers 200 (answers: url, status)."""
    named = rules.where("kind = 'sitemap'").select("origin", F.col("value").alias("url")).distinct()
    paths = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(p).alias("path")) for k, p in enumerate(SITEMAP_PATHS)])
    tried = sites.join(named.select("origin").distinct(), "origin", "left_anti").select("origin", F.explode(paths).alias("p")).select("origin", "p.place", F.concat("origin", "p.path").alias("url"))
    there = tried.join(answers.where("status = 200").select("url").distinct(), "url").groupBy("origin").agg(F.min_by("url", "place").alias("url"))
    return named.unionByName(there)


def alerts(failures: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Which account failures (provider, seq, ts) warn: the first of a provider, then each that comes DEBOUNCE seconds or more after the last that did. Failures are in the
    order of their time, then of ``seq``, which is unique in a provider.

    A failure after a silence of DEBOUNCE seconds warns whatever came before. From there on each warning has one successor, the first failure DEBOUNCE
    seconds on, and pointers to it are joined with themselves: after k rounds those warnings are known that are under 2 ** k steps from a silence.
    A provider's history is read in slices and never gathered."""
    rows = failures.select("provider", "seq", F.unix_seconds("ts").alias("at")).withColumn("one", F.struct("at", "seq"))
    # Points in time a debounce after each failure, among the failures, read backwards: the last failure passed is the first one from there on.
    points = rows.select("provider", "seq", (F.col("at") + DEBOUNCE).alias("at"), F.lit(None).cast(rows.schema["one"].dataType).alias("one"))
    backwards = sliced(rows.unionByName(points).withColumn("back", -F.col("at")), "back", rows_per_slice)
    ahead = prefixes(backwards.withColumn("order", F.struct("back", F.col("one").isNull().alias("point"), F.when(F.col("one").isNotNull(), -F.col("seq")).alias("later"))), "provider", "order", {"next": ("last", F.col("one"))})
    ahead = ahead.where("one IS NULL").select("provider", "seq", F.col("next.seq").alias("next"))
    forwards = sliced(rows, "at", rows_per_slice).withColumn("order", F.col("one"))
    placed = prefixes(forwards, "provider", "order", {"before": ("last", F.col("at"))}, itself=False)
    known = written(placed.select("provider", "seq", F.col("before").isNull().alias("first"), (F.col("before").isNull() | (F.col("at") - F.col("before") >= DEBOUNCE)).alias("alert")).join(ahead, ["provider", "seq"]))
    sure = known.where("alert").select("provider", "seq")
    # A step to a failure after a silence leads to nothing new.
    steps = known.where("next IS NOT NULL").select("provider", "seq", "next")
    steps = written(steps.join(sure.withColumnRenamed("seq", "next"), ["provider", "next"], "left_anti").select("provider", "seq", "next"))
    while True:
        more = written(steps.join(sure, ["provider", "seq"]).select("provider", F.col("next").alias("seq")).join(sure, ["provider", "seq"], "left_anti").distinct())
        if more.isEmpty():
            break
        sure = written(sure.union(more))
        far = steps.select("provider", F.col("seq").alias("next"), F.col("next").alias("far"))
        steps = written(steps.join(far, ["provider", "next"]).select("provider", "seq", F.col("far").alias("next")))
    return known.select("provider", F.col("seq").cast("long").alias("seq")).join(sure.withColumn("alert", F.lit(True)), ["provider", "seq"], "left").select("provider", "seq", F.coalesce("alert", F.lit(False)).alias("alert"))


def token_bucket(requests: DataFrame, interval: float = 1.0, burst: int = 3, patience: float = 30.0) -> DataFrame:
    """When each search (provider, seq, arrival, duration, in seconds) starts, or that it gives up: at most ``burst`` at a time, starts ``interval`` apart, no
    longer in the queue than ``patience``. One provider's queue is one sequence and is simulated as such, in order of arrival."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        busy: list[float] = []
        last, out = float("-inf"), []
        for r in own.sort_values(["arrival", "seq"]).itertuples():
            free = r.arrival if len(busy) < burst else max(r.arrival, sorted(busy)[-burst])
            if free - r.arrival > patience:
                out.append((r.provider, r.seq, None))
                continue
            last = max(free, last + interval)
            busy = [b for b in busy if b > free] + [last + r.duration]
            out.append((r.provider, r.seq, last))
        return pd.DataFrame(out, columns=["provider", "seq", "started"])

    kind = requests.schema["provider"].dataType.simpleString()
    return requests.select("provider", F.col("seq").cast("long").alias("seq"), F.col("arrival").cast("double").alias("arrival"), F.col("duration").cast("double").alias("duration")).groupBy("provider").applyInPandas(
        run, f"provider {kind}, seq long, started double"
    )


def active_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (job, status, created_at) that are still kept at ``now``, and whether they are running."""
    return jobs.where(F.col("created_at") + F.expr(f"INTERVAL {JOB_TTL} SECONDS") > now).withColumn("active", F.col("status").isin("pending", "running"))


def may_start(jobs: DataFrame, now: Column, most: int = MAX_JOBS) -> DataFrame:
    """One row: how many jobs are active and whether another may start."""
    return active_jobs(jobs, now).agg(F.count_if("active").alias("active"), (F.count_if("active") < most).alias("may_start"))


def sources(text: Column) -> Column:
    """Source types of a JSON list of objects with a type, or of names; unknown ones go, none left means web."""
    objects = F.transform(F.from_json(text, "array<struct<type:string>>"), lambda x: x["type"])
    known = lambda c: F.filter(c, lambda x: x.isin(*KNOWN_SOURCES))
    names = known(F.coalesce(F.when(text.rlike(r"^\s*\[\s*\{"), objects), F.from_json(text, "array<string>"), F.array().cast("array<string>")))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("web")))


def probe(answers: DataFrame, least: int = 2) -> DataFrame:
    """The health of searching, from a probe's answer (provider, success, results, error): fine only if it succeeded with results enough."""
    return answers.select("provider", F.coalesce(F.col("success") & (F.col("results") >= least), F.lit(False)).alias("ok"), F.coalesce("results", F.lit(0)).alias("result_count"), F.lit(least).alias("min_results"), "error")


def health(parts: DataFrame, *keys: str) -> DataFrame:
    """One row, or one for each value of ``keys``, from the parts' states (part, needed, ok): healthy if all are, unhealthy if a needed one is not, degraded otherwise."""
    broken = F.count_if(F.col("needed") & ~F.col("ok"))
    state = F.when(broken > 0, "unhealthy").when(F.count_if(~F.col("ok")) > 0, "degraded").otherwise("healthy")
    return parts.groupBy(*keys).agg(state.alias("status"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("part")))).alias("failing"))


def run_id(now: Column, sha: Column) -> Column:
    """A benchmark run's name: the moment in UTC and the commit, where it is known."""
    return F.concat_ws("-", F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyyMMdd'T'HHmmss"), F.nullif(sha, F.lit("")))


def category_report(summary: DataFrame) -> DataFrame:
    """Lines of a run's report from its roll-up (category null: overall): cases, scored cases, quality, success in percent; the overall line last."""
    text = F.format_string(
        "%s: %d cases, %d scored, quality %s, success %s%%", F.coalesce("category", F.lit("overall")), F.col("total_cases"), F.col("scored_cases"),
        F.coalesce(F.format_number("quality", 1), F.lit("-")), F.format_number(100 * F.col("success_rate"), 0),
    )
    return summary.select(F.coalesce("category", F.lit("overall")).alias("category"), F.col("category").isNull().alias("overall"), text.alias("line"))
