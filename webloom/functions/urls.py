"""URL forms: three normalisers, hosts, scopes, patterns, cache keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.addresses import refused

# Query parameters that say where a visitor came from. Fixed values.
TRACKING = ["_ga", "_gl", "fbclid", "gclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "share"]
CACHE_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "dclid", "msclkid", "ref", "source"]
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Country to (language, time zone). Fixed values.
COUNTRIES = {
    "AU": ("en-AU", "Australia/Sydney"), "US": ("en-US", "America/New_York"), "GB": ("en-GB", "Europe/London"),
    "DE": ("de-DE", "Europe/Berlin"), "FR": ("fr-FR", "Europe/Paris"), "JP": ("ja-JP", "Asia/Tokyo"),
    "CN": ("zh-CN", "Asia/Shanghai"), "IN": ("en-IN", "Asia/Kolkata"), "BR": ("pt-BR", "America/Sao_Paulo"),
    "CA": ("en-CA", "America/Toronto"), "NZ": ("en-NZ", "Pacific/Auckland"), "SG": ("en-SG", "Asia/Singapore"),
    "HK": ("zh-HK", "Asia/Hong_Kong"), "KR": ("ko-KR", "Asia/Seoul"), "ES": ("es-ES", "Europe/Madrid"),
    "IT": ("it-IT", "Europe/Rome"), "NL": ("nl-NL", "Europe/Amsterdam"), "SE": ("sv-SE", "Europe/Stockholm"),
    "CH": ("de-CH", "Europe/Zurich"), "AT": ("de-AT", "Europe/Vienna"), "BE": ("nl-BE", "Europe/Brussels"),
    "PL": ("pl-PL", "Europe/Warsaw"), "RU": ("ru-RU", "Europe/Moscow"), "MX": ("es-MX", "America/Mexico_City"),
    "AR": ("es-AR", "America/Buenos_Aires"),
}


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 netloc, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(url, _PARTS, k)


def _join(url: Column, query: Column, path: Column | None = None, fragment: bool = False) -> Column:
    scheme, netloc = F.lower(part(url, 1)), part(url, 2)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when((netloc != "") | F.contains(url, F.lit("://")), F.concat(F.lit("//"), netloc)).otherwise(""),
        part(url, 3) if path is None else path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise("") if fragment else F.lit(""),
    )


def _recode(x: Column) -> Column:
    """Decoded and encoded again, as form values are."""
    decoded = F.coalesce(F.try_url_decode(x), x)
    return F.replace(F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _params(query: Column, drop: list[str], prefix: str | None) -> Column:
    """Pairs (key, value) of a query, blanks kept, without the dropped keys."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _recode(F.substring_index(p, "=", 1)).alias("k"),
            _recode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    keep = lambda p: ~(F.lower(p["k"]).isin(*drop) | (F.lower(p["k"]).startswith(prefix) if prefix else F.lit(False)))
    return F.filter(pairs, keep)


def _encoded(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def strip_tracking(url: Column) -> Column:
    """Without tracking parameters; order, blanks and the fragment stay."""
    query = part(url, 4)
    return F.when(query == "", url).otherwise(_join(url, _encoded(_params(query, TRACKING, "utm_")), fragment=True))


def strip_fragment(url: Column) -> Column:
    return _join(url, part(url, 4))


def normalise(url: Column, link: Column | None = None) -> Column:
    """Without fragment and tracking parameters; of a page's canonical ``link``, where it has one."""
    return strip_tracking(strip_fragment(url if link is None else canonical(url, link)))


def normalise_for_dedupe(url: Column) -> Column:
    """As ``normalise``, with sorted parameters."""
    return _join(url, _encoded(F.array_sort(_params(part(url, 4), TRACKING, "utm_"))))


def normalise_for_cache(url: Column) -> Column:
    """The cache's own form: a shorter list of tracking names, repeated keys side by side, no slash at the end."""
    pairs = _params(part(url, 4), CACHE_TRACKING, None)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)))
    path = F.regexp_replace(part(url, 3), r"/+$", "")
    return _join(url, _encoded(grouped), F.when(path == "", F.lit("/")).otherwise(path))


def cache_key(url: Column, variant: Column | None = None) -> Column:
    """16 hex digits of the SHA-256 of the cache's form and the variant."""
    form = normalise_for_cache(url)
    if variant is not None:
        form = F.when(F.coalesce(variant, F.lit("")) != "", F.concat(form, F.lit("|"), variant)).otherwise(form)
    return F.substring(F.sha2(form, 256), 1, 16)


def headers_hash(headers: Column) -> Column:
    """12 hex digits of the SHA-256 of sorted headers, for the cache's variants."""
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.substring(F.sha2(F.array_join(pairs, "&"), 256), 1, 12)


def cache_variant(device: Column, full_page: Column, headers: Column) -> Column:
    """What beside the url makes a cached result another: parts joined by a bar, null for none."""
    text = F.concat_ws(
        "|",
        F.when(device.isNotNull(), F.concat(F.lit("device="), device)),
        F.when(~full_page, F.lit("screenshot_full_page=False")),
        F.when(F.size(headers) > 0, F.concat(F.lit("headers="), headers_hash(headers))),
    )
    return F.when(text != "", text)


def path_of(url: Column) -> Column:
    return F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))


def hostname(url: Column) -> Column:
    """Lower-cased host without userinfo and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def registrable_domain(url: Column) -> Column:
    host = hostname(url)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def origin(url: Column) -> Column:
    """Scheme, host and port (the scheme's own where none is named)."""
    scheme = F.lower(part(url, 1))
    port = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    own = F.when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    return F.concat(scheme, F.lit("://"), hostname(url), F.lit(":"), F.when(port != "", port).otherwise(own))


def in_domain(url: Column, base: str, subdomains: bool) -> Column:
    netloc = F.lower(part(url, 2))
    return (netloc == base) | netloc.endswith("." + base) if subdomains else netloc == base


def without_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"://[^@/?#]*@", "://")


def glob_pattern(glob: str) -> str:
    """A shell pattern as an anchored regular expression: ``*``, ``?`` and ``[...]``."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def matches(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of ``include`` (none: all) and none of ``exclude``."""
    out = F.lit(True)
    if include:
        out = F.lit(False)
        for g in include:
            out = out | url.rlike(glob_pattern(g))
    for g in exclude:
        out = out & ~url.rlike(glob_pattern(g))
    return out


def robots_pattern(pattern: Column) -> Column:
    """A robots.txt rule as a regular expression; ``*`` is any run, ``$`` at the end an anchor."""
    anchored = pattern.endswith("$")
    bare = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    quoted = F.regexp_replace(bare, r"([\\\.\+\?\(\)\[\]\{\}\^\$\|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(anchored, F.lit("$")).otherwise(""))


def accept_language(country: Column) -> dict[str, Column]:
    """Language, time zone and Accept-Language header of a country; en-US and UTC for others."""
    key = F.upper(country)
    look = lambda k, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in COUNTRIES.items() for x in (c, v[k])]), key), F.lit(default))
    language = look(0, "en-US")
    base = F.substring_index(language, "-", 1)
    header = F.when(base != language, F.concat(language, F.lit(","), base, F.lit(";q=0.9"))).otherwise(language)
    return {"language": language, "timezone": look(1, "UTC"), "accept_language": header}


def safe_slug(url: Column) -> Column:
    """A file name from host and path."""
    path = F.regexp_replace(F.regexp_replace(part(url, 3), r"^/+|/+$", ""), "/", "_")
    return F.when(path == "", F.lit("index")).otherwise(path)


def blocked_ipv4(host: Column, strict: Column) -> Column:
    """Whether a host is an IPv4 literal in a refused range: link-local always, private ranges where ``strict``. Null host: no."""
    quad = F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", 0)
    number = F.aggregate(F.split(quad, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + F.coalesce(x.try_cast("long"), F.lit(0)))
    within = lambda net, bits: (number >= net) & (number < net + 2 ** (32 - bits))
    at = lambda a, b=0, c=0, d=0: a * 2**24 + b * 2**16 + c * 2**8 + d
    always = within(at(169, 254), 16)
    private = within(at(10), 8) | within(at(172, 16), 12) | within(at(192, 168), 16) | within(at(127), 8) | within(at(0), 8) | within(at(100, 64), 10)
    return F.coalesce((quad != "") & (always | (strict & private)), F.lit(False))


def safe_url(url: Column, strict: Column) -> Column:
    """No backslash or control characters, http or https, an ASCII host that is not refused: IPv4 by an expression, IPv6 (which may carry an IPv4 address) by
    ``addresses.refused``, to which all other hosts go as null."""
    host = hostname(url)
    six = F.when(F.contains(host, F.lit(":")) | host.startswith("["), host)
    return (
        ~url.rlike(r"[\\\x00-\x1F\x7F]")
        & F.lower(part(url, 1)).isin("http", "https")
        & ~host.rlike(r"[^\x00-\x7F]")
        & ~blocked_ipv4(host, strict)
        & ~F.coalesce(refused(six, strict), F.lit(False))
    )


def canonical(url: Column, link: Column) -> Column:
    """The page's canonical link, where it has one, as an absolute url: full ones as they are, those without scheme, host or path completed from the page's."""
    scheme, netloc = F.lower(part(url, 1)), part(url, 2)
    root = F.concat(scheme, F.lit("://"), netloc)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    bare = F.trim(link)
    full = (
        F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare)).when(bare.startswith("/"), F.concat(root, bare))
        .when(bare.startswith("?"), F.concat(root, path_of(url), bare)).otherwise(F.concat(root, folder, bare))
    )
    return F.when(F.coalesce(bare, F.lit("")) == "", url).otherwise(full)
