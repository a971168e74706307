"""Checks of callers' arguments, made on the driver before a plan is built."""

from __future__ import annotations

from urllib.parse import urlsplit

FORMATS = {"markdown", "html", "rawHtml", "links", "images", "screenshot", "pdf", "json", "summary", "changeTracking", "branding", "structuredData"}
SOURCES = {"web", "images", "news"}


class ArgumentError(ValueError):
    """What is wrong with which argument."""

    def __init__(self, field: str, value: object, why: str):
        super().__init__(f"{field}: {why}")
        self.field, self.value = field, value


def query(value: str, field: str = "query", least: int = 1, most: int = 1000) -> str:
    text = value.strip() if isinstance(value, str) else ""
    if not least <= len(text) <= most:
        raise ArgumentError(field, value, f"needs {least} to {most} characters")
    return text


def url(value: str, field: str = "url", most: int = 2048) -> str:
    text = value.strip() if isinstance(value, str) else ""
    parts = urlsplit(text)
    if not text or len(text) > most or parts.scheme not in ("http", "https") or not parts.netloc:
        raise ArgumentError(field, value, "needs an http or https address")
    return text


def number(value: int, field: str, least: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ArgumentError(field, value, "needs a whole number")
    return min(most, max(least, value))


def subset(values: list[str], field: str, known: set[str]) -> list[str]:
    unknown = [v for v in values if v not in known]
    if unknown or not values:
        raise ArgumentError(field, values, f"needs some of {', '.join(sorted(known))}")
    return list(dict.fromkeys(values))


def urls(values: list[str], field: str = "urls", least: int = 1, most: int = 100) -> list[str]:
    if not isinstance(values, list) or not least <= len(values) <= most:
        raise ArgumentError(field, values, f"needs a list of {least} to {most} addresses")
    return [url(v, f"{field}[{k}]") for k, v in enumerate(values)]


def prompt(value: str, field: str = "prompt", most: int = 10_000) -> str:
    return query(value, field, 1, most)


def steps(value: int, field: str = "max_steps", most: int = 50) -> int:
    return number(value, field, 1, most)


def timeout(value: int | None, field: str = "timeout", default: int = 30_000, least: int = 1_000, most: int = 300_000) -> int:
    """Milliseconds, held within bounds; none named: the default."""
    return default if value is None else number(value, field, least, most)
