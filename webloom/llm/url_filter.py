"""URL filter: allow and block rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import table

#: (action, rule): a rule is a host followed by a path prefix and also fits every subdomain of its host.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# The labelled URL table: 1 for pages that a crawl for training text shuns, 0 for ordinary ones. Fixed values.
BLOCK_URLS = """
http://cheap-pills-shop.example.com/buy/viagra  http://best-pills.example.net/order  https://casino-bonus.example.org/spins
http://casino-win-big.example.com/slots  https://win-jackpot.example.net/play  https://free-bets-today.example.org/odds
http://sports-bets.example.net/free  https://adult-cams.example.com/live  http://adult-xxx.example.net/en/12
http://www.hot-adult-x.example.org/de/4  https://ads-network.example.com/click?id=1  http://track-ads.example.net/fr/88
https://ad-track-server.example.org/es/310  https://spam-links.example.net/farm  https://m.link-farm-seo.example.com/de/75
http://buy-cheap-meds.example.org/pharmacy  https://replica-cheap.example.net/sale  http://payday-loan.example.com/apply
https://free-money-now.example.net/claim  http://win-free-phone.example.org/prize  https://crypto-double.example.com/en/9
http://poker-bonus-free.example.net/fr/5  https://escort-xxx.example.org/city  http://keygen-crack.example.com/download
https://click-ads-track.example.net/go  http://miracle-pills.example.com/es/61  https://blog.spam-blaster.example.org/en/7
http://www.casino-royal-win.example.net/en/23  https://www.spam-farm-links.example.com/es/61  http://www.free-casino.example.org/de/14
http://spam-farm-seo.example.com/de/402  https://bets-casino-live.example.net/roulette  http://www.xxx-adult.example.com/
https://popup-ads.example.org/serve  http://cheap-pills-deals.example.net/fr/90.html
"""
ALLOW_URLS = """
https://www.city-library.example.org/catalogue/history  https://docs.language.example.com/en/reference/strings
https://news.daily-herald.example.net/2021/05/local-election  https://blog.gardening.example.org/posts/roses
http://university.example.com/physics/lectures/12.html  https://wiki.encyclopedia.example.net/article/volcano
https://weather.example.org/forecast/north  https://museum.example.com/exhibits/ceramics
https://recipes.kitchen.example.net/bread  https://m.travel-guide.example.org/fr/505  https://forum.cycling.example.com/en/485
http://www.bookshop.example.net/de/230/  https://council.example.org/planning/minutes  https://health.example.com/es/19
https://maps.hiking.example.net/trails/coast  https://school.example.org/science/plants.html
https://www.orchestra.example.com/season  https://journal.letters.example.net/volume/7/issue/2
https://translation.example.org/de/180  https://archive.letters.example.com/en/833  https://opensource.example.net/readme
https://www.theatre.example.org/en/42  https://harvest.example.com/fr/754  https://bank.example.net/about/history
https://m.transport.example.org/de/638  http://blog.photography.example.com/en/571?page=2&ref=x
https://charity.example.net/es/797#top  https://law.example.org/statutes/section-12  https://ocean.example.com/de/49
https://astronomy.example.net/es/118  https://railway.example.org/en/417  https://blog.history.example.com/en/88.html
https://www.nature.example.net/de/605/  https://m.philosophy.example.org/es/874  https://painting.example.com/fr/414
https://literature.example.net/en/960  https://www.energy.example.org/en/12#top  https://village.example.com/en/301
http://weaving.example.net/fr/65.html  https://strength.example.org/de/357  http://thatcher.example.com/en/148.html
https://intention.example.net/es/252?utm_source=feed  https://other-thing.example.org/fr/925  https://nation.example.com/de/414
"""

#: The log odds of blocking a url of which nothing is known.
PRIOR = -1.0
#: The host says more about a page than its path does.
HOST_SHARE, PATH_SHARE = 1.0, 0.4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#``
    or the end. Both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    got = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(got, pattern, 1), upper, upper.lower()), F.regexp_extract(got, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (of equally long ones the first), as struct(action, rule), or null."""
    out = None
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        value = F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<action:string,rule:string>") if out is None else out


def _gram_buckets(text: Column, mark: str, n: int, dims: int) -> Column:
    """Buckets of the character n-grams of ``text`` between boundary marks; linear in the length of the text."""
    gram = lambda chars, i: F.concat(F.lit(mark), *[F.element_at(chars, i + k) for k in range(n)])
    starts = lambda chars: F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    # The outer lambda binds the characters, which would else be split anew for every gram.
    bound = F.array(F.concat(F.array(F.lit("^")), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("$"))))
    return F.get(
        F.transform(bound, lambda c: F.transform(starts(c), lambda i: F.pmod(F.xxhash64(gram(c, i)), F.lit(dims)).cast("int"))), 0
    )


def url_features(host: Column, path: Column, dims: int) -> tuple[Column, Column]:
    """Hashed 3- and 4-grams of host and of path."""
    return tuple(
        F.concat(_gram_buckets(text, mark, 3, dims), _gram_buckets(text, mark, 4, dims))
        for text, mark in ((host, "h"), (path, "p"))
    )


def fit_url_model(
    labelled: DataFrame, dims: int = 4096, max_labelled: int = 5000, epochs: int = 600, rate: float = 2.0, l2: float = 1e-4
) -> list[float]:
    """Full-batch gradient descent on a small table (url, label 0 or 1); last comes the bias, which is PRIOR. At most ``max_labelled``
    rows, those of the smallest url hashes, come to the driver. Rows with a null label are ignored; no rows: all zero."""
    host, path = host_and_path(F.col("url"))
    of_host, of_path = url_features(host, path, dims)
    rows = (
        labelled.where("url IS NOT NULL AND label IS NOT NULL")
        .select("label", of_host.alias("h"), of_path.alias("p"), F.xxhash64("url").alias("o"))
        .orderBy("o")
        .limit(max_labelled)
        .collect()
    )
    sparse = []
    for r in rows:
        v: dict[int, float] = {}
        for part, share in ((r.h, HOST_SHARE), (r.p, PATH_SHARE)):
            for b in part:
                v[b] = v.get(b, 0.0) + share / math.sqrt(len(part))
        sparse.append((v, r.label))
    w = [0.0] * dims + [PRIOR]
    for _ in range(epochs if sparse else 0):
        gradient: dict[int, float] = {}
        for v, y in sparse:
            z = w[dims] + sum(w[b] * x for b, x in v.items())
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            for b, x in v.items():
                gradient[b] = gradient.get(b, 0.0) + miss * x
        for b, g in gradient.items():
            w[b] -= rate * (g / len(sparse) + l2 * w[b])
    return w


def url_score(host: Column, path: Column, weights: list[float]) -> Column:
    """The probability that the url is to be blocked; the weights are one literal of a fixed length."""
    dims = len(weights) - 1
    table_of_weights = F.expr(f"array({', '.join(f'{x:.9e}D' for x in weights)})")
    z = F.lit(float(weights[-1]))
    for buckets, share in zip(url_features(host, path, dims), (HOST_SHARE, PATH_SHARE), strict=True):
        total = lambda own: F.aggregate(own, F.lit(0.0), lambda s, b: s + F.get(table_of_weights, b))
        part = F.transform(
            F.array(buckets),
            lambda own: F.when(F.size(own) > 0, share * total(own) / F.sqrt(F.size(own).cast("double"))).otherwise(F.lit(0.0)),  # noqa: B023
        )
        z = z + F.get(part, 0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Judges every url of ``pages`` (page_id, url): the longest fitting rule decides, else the regression.

    Null url or no ``://``: empty host and path, no rule, judged by the prior alone (allow). Very
    long urls are scored whole. Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    Returns page_id, host, path, rule, verdict, score (null where a rule decided).
    """
    weights = fit_url_model(labelled)
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = named.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("score", F.when(F.col("fit").isNull(), url_score(F.col("host"), F.col("path"), weights)))
    return scored.select(
        "page_id", "host", "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.action"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def default_labels(spark: SparkSession) -> DataFrame:
    """The labelled URL table above, built by SQL."""
    text = lambda urls: ", ".join(f"'{u}'" for u in urls.split())
    return spark.sql(
        f"SELECT explode(array({text(BLOCK_URLS)})) AS url, 1 AS label "
        f"UNION ALL SELECT explode(array({text(ALLOW_URLS)})) AS url, 0 AS label"
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages, judged."""
    return filter_urls(table(spark, sf_dir, "pages"), default_labels(spark))
