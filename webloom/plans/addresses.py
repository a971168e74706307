"""Queries over page urls: normal forms, scopes, patterns, robots rules, address guards, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import discovery as D
from webloom.operators import redirects
from webloom.operators import services as S
from webloom.session import table

#: Dresses the table's urls with the forms that the normalisers tell apart, alike in both engines.
URL = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b=2&utm_medium=x&a=1&a=0&fbclid=9#frag'
 WHEN 2 THEN replace(url, '://', '://user:pw@') ELSE split_part(split_part(url, '#', 1), '?', 1) || '//?q=a+b%20c&empty=&Ref=home' END"""
_VIEW = f"WITH u AS (SELECT page_id, {URL} AS url FROM pages)"
ROBOTS = """# rules
User-agent: other
Disallow: /

User-agent: *
Disallow: /en/
Allow: /en/1
Disallow: /*.html$
Allow: /fr/
Disallow: /fr/*/
Crawl-delay: 2.5
Request-rate: 1/10
Sitemap: https://x.example/sitemap.xml  # main
Sitemap: https://x.example/news.xml
"""


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(URL).alias("url"))


def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dressed(spark, sf_dir).select(
        "page_id",
        U.strip_tracking(F.col("url")).alias("stripped"),
        U.normalise(F.col("url")).alias("normal"),
        U.normalise_for_dedupe(F.col("url")).alias("dedupe"),
        U.normalise_for_cache(F.col("url")).alias("cache"),
    )


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return dressed(spark, sf_dir).select(
        "page_id", U.path_of(u).alias("path"), F.lower(U.part(u, 2)).alias("netloc"), U.hostname(u).alias("host"), U.origin(u).alias("origin"),
        U.registrable_domain(u).alias("domain"), U.without_credentials(u).alias("clean"), U.without_query(u).alias("bare"),
    )


def url_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.create_map(F.lit("X-B"), F.col("page_id").cast("string"), F.lit("Accept"), F.lit("*/*"))
    variant = U.cache_variant(F.when(F.col("page_id") % 3 == 0, F.lit("iphone")), F.col("page_id") % 2 == 0, headers)
    return dressed(spark, sf_dir).select("page_id", variant.alias("variant"), U.cache_key(F.col("url"), variant).alias("cache_key"), U.cache_key(F.col("url")).alias("plain_key"))


def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain scope, glob patterns and text search over all urls."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.in_domain(u, "example.com", True).alias("in_domain"),
        U.in_domain(u, "www.cheap-pills.example.com", False).alias("in_exact"),
        U.matches(u, ["*/en/*", "https://m.*"], ["*.html", "*utm_*"]).alias("wanted"),
        U.matches(u, ["http*://[bm]*.example.*/[!e]?/*"], []).alias("classed"),
        F.contains(F.lower(u), F.lit("pills")).alias("found"),
    )


def url_dedupe_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first url, by page, of each aggressive normal form."""
    return D.first_of_form(dressed(spark, sf_dir), U.without_query(U.normalise_for_dedupe(F.regexp_replace("url", "user:pw@", ""))), "page_id").select("page_id", "url", "form")


def url_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url under the longest matching rule of a robots file that holds for all origins."""
    files = table(spark, sf_dir, "pages").select(U.origin(F.col("url")).alias("origin")).distinct().withColumn("content", F.lit(ROBOTS))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return D.allowed_by_robots(pages, D.robots_rules(files, "*")).select("page_id", "allowed", "longest_allow", "longest_disallow")


def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(U.origin(F.col("url")).alias("origin")).distinct().withColumn("content", F.lit(ROBOTS))
    return D.robots_rules(files, "*").groupBy("kind").agg(F.count("*").alias("n"), F.max("value").alias("last"))


def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe-url verdicts for addresses made of page numbers, in both policies."""
    host = F.expr("""CASE page_id % 8 WHEN 0 THEN '169.254.' || page_id % 256 || '.1' WHEN 1 THEN '10.0.' || page_id % 256 || '.9' WHEN 2 THEN '172.' || page_id % 64 || '.0.1'
 WHEN 3 THEN '192.168.1.' || page_id % 256 WHEN 4 THEN '100.' || page_id % 256 || '.3.4' WHEN 5 THEN '8.8.' || page_id % 256 || '.8' WHEN 6 THEN 'host' || page_id || '.example' ELSE '127.0.0.1' END""")
    scheme = F.expr("CASE page_id % 5 WHEN 0 THEN 'ftp' WHEN 1 THEN 'HTTP' ELSE 'https' END")
    u = F.concat(scheme, F.lit("://"), host, F.lit(":8080/"), F.when(F.col("page_id") % 9 == 0, F.lit("a\\b")).otherwise("x"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("url")).select(
        "page_id", U.safe_url(F.col("url"), F.lit(False)).alias("safe"), U.safe_url(F.col("url"), F.lit(True)).alias("safe_strict")
    )


#: Hosts that are IPv6 addresses, and whether they are refused: always, and in strict mode. Fixed values.
SIX = [("[fe80::1]", True, True), ("[::ffff:169.254.169.254]", True, True), ("[64:ff9b::a9fe:a9fe]", True, True), ("[2002:a9fe:a9fe::]", True, True), ("[::1]", False, True), ("[::ffff:10.0.0.1]", False, True), ("[fc00::7]", False, True),
       ("[::]", False, True), ("[2001:4860:4860::8888]", False, False), ("[::ffff:8.8.8.8]", False, False)]


def url_guard_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe-url verdicts for IPv6 hosts, among them forms that carry an IPv4 address, with and without a port."""
    host = F.element_at(F.array(*[F.lit(h) for h, _, _ in SIX]), (F.col("page_id") % len(SIX) + 1).cast("int"))
    u = F.concat(F.lit("http://"), host, F.when(F.col("page_id") % 3 == 0, ":80").otherwise(""), F.lit("/x"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("url")).select(
        "page_id", U.safe_url(F.col("url"), F.lit(False)).alias("safe"), U.safe_url(F.col("url"), F.lit(True)).alias("safe_strict")
    )


#: What a page's url answers: most lead to the next page's, some back, to a refused address or to a place without an answer; some end there.
_ANSWERS = """CASE WHEN n % 37 = 0 THEN 200 WHEN n % 2 = 0 THEN 301 ELSE 302 END AS status, CASE WHEN n % 37 = 0 THEN 'https://not.followed.example/' WHEN n % 29 = 7 THEN 'http://169.254.169.254/latest'
 WHEN n % 13 = 4 THEN '/moved?x=' || n || '#f' WHEN n % 23 = 5 THEN back WHEN n % 31 = 3 THEN ' ' ELSE ahead END AS location"""


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the urls of all pages end by redirects, each hop judged."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), "url")
    near = p.join(p.selectExpr("n - 1 AS n", "url AS ahead"), "n", "left").join(p.selectExpr("n + 1 AS n", "url AS back"), "n", "left")
    answers = near.select(U.strip_fragment(F.col("url")).alias("url"), *[F.expr(c) for c in _split(_ANSWERS)])
    return redirects.follow(answers.select("url").distinct(), answers)


def _split(pair: str) -> list[str]:
    """The two expressions of the answers."""
    first, second = pair.split(" AS status, ")
    return [f"{first} AS status", second]


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of pages that name a canonical link in one of its forms, or none."""
    link = F.expr("CASE page_id % 6 WHEN 0 THEN 'https://c.example/p?utm_source=x&a=' || page_id WHEN 1 THEN '//d.example/q' WHEN 2 THEN '/root/' || page_id || '#f' WHEN 3 THEN '?only=1' WHEN 4 THEN '' END")
    url = F.concat(F.lit("https://h.example/dir/"), F.col("page_id").cast("string"), F.lit(".html?ref=a&k=1#frag"))
    return table(spark, sf_dir, "pages").select("page_id", U.normalise(url, link).alias("normal"))


def locale_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = F.substring(F.upper("n_name"), 1, 2)
    got = U.accept_language(country)
    return table(spark, sf_dir, "nation").select("n_nationkey", country.alias("country"), *[c.alias(k) for k, c in got.items()])


def map_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery: breadth-first over the pages' own links to depth 3, joined with a sitemap that lists every page. Scope, limit and search are ``service_map``'s."""
    links = D.page_links(table(spark, sf_dir, "pages"))
    seeds = links.groupBy().agg(F.min("src").alias("url"))
    reached = D.reachable(links, seeds, max_depth=3)
    sitemap = table(spark, sf_dir, "pages").select(U.strip_fragment(F.col("url")).alias("url"))
    return D.discovered(reached, sitemap).select("url", "depth")


def service_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map service: from the first page, with a sitemap of all pages, its domain and those below, the first 300 urls, searched for a text."""
    p = table(spark, sf_dir, "pages")
    sitemap = p.select(U.strip_fragment(F.col("url")).alias("url"))
    return S.discover(p, "https://example.com/", sitemap, limit=300, search_text="EN/", subdomains=True)


QUERIES = {
    "service_map": service_map,
    "url_normalise": url_normalise,
    "url_parts": url_parts,
    "url_cache_key": url_cache_key,
    "url_scope": url_scope,
    "url_dedupe_similar": url_dedupe_similar,
    "url_robots": url_robots,
    "robots_parse": robots_parse,
    "url_guard": url_guard,
    "url_guard_six": url_guard_six,
    "url_redirects": url_redirects,
    "url_canonical": url_canonical,
    "locale_defaults": locale_defaults,
    "map_urls": map_urls,
}

# Query strings by hand: split, drop, decode and encode again.
_SPLIT = f"""{_VIEW}, p AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q,
 regexp_extract(url, '#(.*)$', 1) AS frag FROM u), kv AS (SELECT page_id, i, raw, split_part(raw, '=', 1) AS k0, CASE WHEN contains(raw, '=') THEN regexp_replace(raw, '^[^=]*=', '') ELSE '' END AS v0
 FROM (SELECT page_id, unnest(string_split(q, '&')) AS raw, generate_subscripts(string_split(q, '&'), 1) AS i FROM p WHERE q <> '') WHERE raw <> ''),
 e AS (SELECT page_id, i, replace(url_encode(url_decode(replace(k0, '+', ' '))), '%20', '+') AS k, replace(url_encode(url_decode(replace(v0, '+', ' '))), '%20', '+') AS v FROM kv),
 f AS (SELECT * FROM e WHERE NOT (lower(k) LIKE 'utm!_%' ESCAPE '!' OR lower(k) IN ({", ".join(f"'{t}'" for t in U.TRACKING)}))),
 h AS (SELECT *, min(i) OVER (PARTITION BY page_id, k) AS first_i FROM e WHERE lower(k) NOT IN ({", ".join(f"'{t}'" for t in U.CACHE_TRACKING)})),
 a AS (SELECT p.*, (SELECT string_agg(k || '=' || v, '&' ORDER BY i) FROM f WHERE f.page_id = p.page_id) AS kept,
  (SELECT string_agg(k || '=' || v, '&' ORDER BY k, v) FROM f WHERE f.page_id = p.page_id) AS sorted,
  (SELECT string_agg(k || '=' || v, '&' ORDER BY first_i, i) FROM h WHERE h.page_id = p.page_id) AS cached FROM p),
 n AS (SELECT page_id, url, CASE WHEN q = '' THEN url ELSE base || CASE WHEN kept IS NULL THEN '' ELSE '?' || kept END || CASE WHEN frag = '' THEN '' ELSE '#' || frag END END AS stripped,
  base || CASE WHEN kept IS NULL THEN '' ELSE '?' || kept END AS normal, base || CASE WHEN sorted IS NULL THEN '' ELSE '?' || sorted END AS dedupe,
  regexp_replace(base, '/+$', '') || CASE WHEN regexp_matches(base, '^[^/]*//[^/]*/*$') THEN '/' ELSE '' END || CASE WHEN cached IS NULL THEN '' ELSE '?' || cached END AS cache FROM a)"""
_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''))"
_IP = "(a * 16777216 + b * 65536 + c * 256 + d)"
_PATH = "regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1)"

ORACLES = {
    "service_map": r"""WITH RECURSIVE l AS (SELECT DISTINCT src, dst FROM (
 SELECT regexp_extract(url, '^([^#]*)', 1) AS src, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || unnest(regexp_extract_all(html, 'href="(/[^"#]*)', 1)) AS dst FROM pages)),
 r(url, depth) AS (SELECT 'https://example.com/', 0 UNION SELECT dst, depth + 1 FROM r JOIN l ON l.src = r.url WHERE depth < 3),
 a AS (SELECT url, min(depth)::INT AS depth FROM (SELECT * FROM r UNION ALL SELECT regexp_extract(url, '^([^#]*)', 1), 0 FROM pages) GROUP BY url),
 f AS (SELECT * FROM a WHERE regexp_matches(url, '^[a-z]+://([^/?#]*\.)?example\.com([/?#]|$)') ORDER BY url LIMIT 300)
 SELECT url, depth FROM f WHERE contains(lower(url), 'en/')""",
    "url_normalise": f"{_SPLIT} SELECT page_id, stripped, normal, dedupe, cache FROM n",
    "url_parts": rf"""{_VIEW} SELECT page_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS netloc, {_HOST} AS host,
 split_part(url, ':', 1) || '://' || {_HOST} || CASE split_part(url, ':', 1) WHEN 'https' THEN ':443' ELSE ':80' END AS origin,
 regexp_replace({_HOST}, '^www\.', '') AS domain, replace(url, '://user:pw@', '://') AS clean, regexp_extract(url, '^([^?#]*)', 1) AS bare FROM u""",
    "url_cache_key": f"""{_SPLIT}, w AS (SELECT *, concat_ws('|', CASE WHEN page_id % 3 = 0 THEN 'device=iphone' END, CASE WHEN page_id % 2 <> 0 THEN 'screenshot_full_page=False' END,
 'headers=' || substr(sha256('Accept=*/*&X-B=' || page_id), 1, 12)) AS variant FROM n)
 SELECT page_id, variant, substr(sha256(cache || '|' || variant), 1, 16) AS cache_key, substr(sha256(cache), 1, 16) AS plain_key FROM w""",
    "url_scope": r"""SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' AS in_domain, h = 'www.cheap-pills.example.com' AS in_exact,
 (url LIKE '%/en/%' OR url LIKE 'https://m.%') AND NOT (url LIKE '%.html' OR url LIKE '%utm!_%' ESCAPE '!') AS wanted,
 regexp_full_match(url, 'http.*://[bm].*\.example\..*/[^e]./.*') AS classed, lower(url) LIKE '%pills%' AS found
 FROM (SELECT *, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)""",
    "url_dedupe_similar": rf"""{_VIEW}, f AS (SELECT page_id, url, regexp_extract(replace(url, 'user:pw@', ''), '^([^?#]*)', 1) AS form FROM u)
 SELECT page_id, url, form FROM f QUALIFY row_number() OVER (PARTITION BY form ORDER BY page_id) = 1""",
    "url_robots": rf"""WITH r(kind, v, re) AS (VALUES ('disallow', '/en/', '^/en/'), ('allow', '/en/1', '^/en/1'), ('disallow', '/*.html$', '^/.*\.html$'), ('allow', '/fr/', '^/fr/'), ('disallow', '/fr/*/', '^/fr/.*/')),
 p AS (SELECT page_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path FROM pages),
 m AS (SELECT page_id, coalesce(max(length(v)) FILTER (kind = 'allow' AND regexp_matches(path, re)), -1) AS la, coalesce(max(length(v)) FILTER (kind = 'disallow' AND regexp_matches(path, re)), -1) AS ld FROM p, r GROUP BY page_id)
 SELECT page_id, ld = -1 OR la >= ld AS allowed, la::INT AS longest_allow, ld::INT AS longest_disallow FROM m""",
    "robots_parse": rf"""WITH n AS (SELECT count(DISTINCT split_part(url, ':', 1) || {_HOST}) AS k FROM pages),
 v(kind, m, last) AS (VALUES ('disallow', 3, '/fr/*/'), ('allow', 2, '/fr/'), ('crawl-delay', 1, '2.5'), ('request-rate', 1, '0.1'), ('sitemap', 2, 'https://x.example/sitemap.xml'))
 SELECT kind, k * m AS n, last FROM v, n""",
    "url_guard": rf"""WITH h AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN '169.254.' || page_id % 256 || '.1' WHEN 1 THEN '10.0.' || page_id % 256 || '.9' WHEN 2 THEN '172.' || page_id % 64 || '.0.1'
 WHEN 3 THEN '192.168.1.' || page_id % 256 WHEN 4 THEN '100.' || page_id % 256 || '.3.4' WHEN 5 THEN '8.8.' || page_id % 256 || '.8' WHEN 6 THEN 'host' || page_id || '.example' ELSE '127.0.0.1' END AS host FROM pages),
 o AS (SELECT page_id, host, try_cast(split_part(host, '.', 1) AS INT) AS a, try_cast(split_part(host, '.', 2) AS INT) AS b FROM h),
 s AS (SELECT page_id, page_id % 5 <> 0 AND page_id % 9 <> 0 AS base, coalesce(a = 169 AND b = 254, false) AS link,
 coalesce(a IN (10, 127, 0) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127), false) AS private FROM o)
 SELECT page_id, base AND NOT link AS safe, base AND NOT link AND NOT private AS safe_strict FROM s""",
    "url_guard_six": f"""WITH s(k, safe, safe_strict) AS (VALUES {", ".join(f"({k}, {not a}, {not b})" for k, (_, a, b) in enumerate(SIX))}) SELECT page_id, safe, safe_strict FROM pages JOIN s ON page_id % {len(SIX)} = k""",
    "url_redirects": f"""WITH RECURSIVE p AS (SELECT page_id AS n, url FROM pages),
 a AS (SELECT regexp_replace(p.url, '#.*$', '') AS url, {_ANSWERS} FROM p LEFT JOIN (SELECT n - 1 AS n, url AS ahead FROM p) USING (n) LEFT JOIN (SELECT n + 1 AS n, url AS back FROM p) USING (n)),
 o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY status, location NULLS FIRST) = 1),
 w AS (SELECT url, status, CASE WHEN status IN (301, 302) AND trim(location) <> '' THEN regexp_replace(CASE WHEN starts_with(location, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || location ELSE location END, '#.*$', '') END AS next FROM o),
 c(url, final, hops) AS (SELECT url, url, 0 FROM o UNION ALL SELECT c.url, w.next, c.hops + 1 FROM c JOIN w ON w.url = c.final WHERE w.next IS NOT NULL AND c.hops < 10),
 l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY hops DESC) = 1)
 SELECT l.url, l.final, l.hops, w.status, CASE WHEN contains(l.final, '169.254.169.254') THEN 'refused' WHEN w.next IS NOT NULL THEN 'too_many' ELSE 'ok' END AS outcome FROM l LEFT JOIN w ON w.url = l.final""",
    "url_canonical": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://c.example/p?a=' || page_id WHEN 1 THEN 'https://d.example/q' WHEN 2 THEN 'https://h.example/root/' || page_id WHEN 3 THEN 'https://h.example/dir/' || page_id || '.html?only=1'
 ELSE 'https://h.example/dir/' || page_id || '.html?k=1' END AS normal FROM pages""",
    "locale_defaults": f"""WITH c(country, language, timezone) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in U.COUNTRIES.items())}),
 n AS (SELECT n_nationkey, upper(substr(n_name, 1, 2)) AS country FROM nation)
 SELECT n_nationkey, n.country, coalesce(language, 'en-US') AS language, coalesce(timezone, 'UTC') AS timezone,
 coalesce(language, 'en-US') || ',' || split_part(coalesce(language, 'en-US'), '-', 1) || ';q=0.9' AS accept_language FROM n LEFT JOIN c USING (country)""",
    "map_urls": r"""WITH RECURSIVE l AS (SELECT DISTINCT src, dst FROM (
 SELECT regexp_extract(url, '^([^#]*)', 1) AS src, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || unnest(regexp_extract_all(html, 'href="(/[^"#]*)', 1)) AS dst FROM pages)),
 r(url, depth) AS (SELECT min(src), 0 FROM l UNION SELECT dst, depth + 1 FROM r JOIN l ON l.src = r.url WHERE depth < 3),
 s AS (SELECT regexp_extract(url, '^([^#]*)', 1) AS url, 0 AS depth FROM pages)
 SELECT url, min(depth)::INT AS depth FROM (SELECT * FROM r UNION ALL SELECT * FROM s) GROUP BY url""",
}
