"""Gate, then grade: a verdict from structural signs and a score that the verdict caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import detection as D
from webloom.functions import text as T

THIN_WORDS = 50
#: The highest score that a verdict allows. Fixed values.
CEILINGS = {
    "js_shell": 30, "paywall": 45, "thin": 45, "bot_challenge": 15, "captcha": 15, "error_status": 10, "garbled_pdf": 25, "empty": 0,
}
HARD_FAILS = ["bot_challenge", "captcha", "error_status", "garbled_pdf", "empty", "infrastructure"]
ESCALATABLE = ["bot_challenge", "js_shell", "empty"]
#: What to try next. Texts of our own.
SUGGESTIONS = {
    "bot_challenge": "An anti-bot page was served; try a stealth engine or a proxy.",
    "captcha": "A CAPTCHA was served; solve it or use another source.",
    "js_shell": "The content is rendered on the client; wait longer.",
    "thin": "Little content was extracted; keep more of the page or wait longer.",
    "paywall": "A login or subscription is asked for; supply a session.",
    "garbled_pdf": "The PDF's words are fused; read it again with OCR.",
    "empty": "Nothing was extracted; wait longer or use another engine.",
    "error_status": "The server answered with an error; check the URL.",
    "infrastructure": "The scraper itself failed; try once more.",
}


def reference_free_score(words: Column, links: Column, spacing: Column) -> Column:
    """0-100 from completeness, spacing and link cleanliness, rounded half to even."""
    blend = (
        0.55 * F.least(F.lit(1.0), words / 300)
        + 0.30 * F.coalesce(spacing, F.lit(1.0))
        + 0.15 * F.greatest(F.lit(0.0), 1.0 - T.link_density(links, words) / 50.0)
    )
    return F.bround(100 * blend, 0).cast("int")


def pdf_verdict(words: Column, spacing: Column) -> Column:
    return (
        F.when(words == 0, "empty")
        .when(spacing.isNotNull() & (spacing < 0.5), "garbled_pdf")
        .when(words < THIN_WORDS, "thin")
        .otherwise("ok")
    )


def page_verdict(status: Column, html: Column, words: Column) -> Column:
    """The gate for pages, hard signs first; null or empty html leaves only the word count to judge by."""
    bot = D.bot_protection(html)
    few = words < THIN_WORDS
    return (
        F.when(status.isin(403, 429, 503), "bot_challenge")
        .when(status >= 400, "error_status")
        .when(F.coalesce(html, F.lit("")) == "", F.when(words == 0, "empty").otherwise("ok"))
        .when(T.non_printable_ratio(html) > 0.30, "bot_challenge")
        .when(bot["captcha_present"] & few, F.when(bot["challenge_detected"], "bot_challenge").otherwise("captcha"))
        .when((bot["challenge_detected"] | bot["access_denied"]) & few, "bot_challenge")
        .when(words == 0, "empty")
        .when(few & D.js_framework(html).isNotNull(), "js_shell")
        .when(few & D.login_required(html), "paywall")
        .when(few, "thin")
        .otherwise("ok")
    )


def capped(score: Column, verdict: Column) -> Column:
    cases = None
    for name, most in CEILINGS.items():
        cases = F.when(verdict == name, F.least(score, F.lit(most))) if cases is None else cases.when(verdict == name, F.least(score, F.lit(most)))
    return cases.otherwise(score)


def usable(verdict: Column) -> Column:
    return ~verdict.isin(*HARD_FAILS)


def suggestion(verdict: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SUGGESTIONS.items() for x in kv]), verdict)


def error_message(verdict: Column, reasons: Column) -> Column:
    """Why a result is unusable, or null where it is usable."""
    detail = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(verdict)
    text = F.concat(F.lit("No usable content ("), verdict, F.lit("): "), detail, F.lit("."))
    return F.when(~usable(verdict), F.concat_ws(" ", text, suggestion(verdict)))


def content_quality(html: Column, words: Column) -> Column:
    """HARD for binary pages, SOFT for those without structure tags or with less than a word a kilobyte, else null."""
    head = F.lower(F.substring(html, 1, 4096))
    tags = D.any_of(head, ["<html", "<head", "<body", "<div", "<p", "<a"])
    return (
        F.when(F.coalesce(F.length(html), F.lit(0)) < 200, F.lit(None).cast("string"))
        .when(T.non_printable_ratio(html) > 0.30, "HARD")
        .when(~tags, "SOFT")
        .when(words / F.length(html) * 1024 < 1.0, "SOFT")
    )


def failure_verdict(error: Column, scraper_fault: Column) -> Column:
    """The verdict of a fetch that raised: our own fault, a block, or nothing at all."""
    low = F.lower(error)
    return (
        F.when(scraper_fault, "infrastructure")
        .when(D.any_of(low, ["403", "429", "blocked", "denied"]), "bot_challenge")
        .otherwise("empty")
    )
