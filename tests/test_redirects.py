"""Redirect chains against a loop, and sitemap files in all the ways they come."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import discovery, redirects


def plain(starts, answers, most):
    told = {}
    for url, status, location in sorted((a for a in answers if a[0] is not None), key=lambda a: (a[0], a[1] is not None, a[1] or 0, a[2] is not None, a[2] or "")):
        told.setdefault(url, (status, location))
    out = []
    for url in starts:
        at, hops = url, 0
        while True:
            status, location = told.get(at, (None, None))
            safe = at is not None and at.startswith(("http://", "https://")) and "10.0.0." not in at and "\\" not in at
            leads = location.strip() if status in (301, 302, 303, 307, 308) and location and location.strip() else None
            if not safe:
                out.append((url, at, hops, status, "refused"))
                break
            if leads is None or hops == most:
                out.append((url, at, hops, status, "ok" if leads is None else "too_many"))
                break
            at, hops = (leads if "://" in leads else "https://h" + at.split("//h")[1].split("/")[0] + leads).split("#")[0], hops + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [0, 1, 3, 10, 13])
def test_chains(spark, most):
    rng = random.Random(most)
    name = lambda k: f"https://h{k % 5}.example/{k}"
    answers = []
    for k in range(400):
        target = rng.choice([name(k + 1)] * 12 + [name(rng.randrange(400)), name(k), f"/{rng.randrange(400)}", "http://10.0.0.7/", "ftp://h.example/", "https://nowhere.example/x#f", None, " ", "https://a\\b/"])
        answers.append((name(k), rng.choice([301, 302, 307, 302, 302, 302, 302, 200, 304, None]), target))
    answers += [(name(5), 200, None), (None, 301, name(1)), (name(6), 302, name(7)), (name(6), 302, name(7))]
    starts = [name(k) for k in range(400)] + [name(0), "http://10.0.0.1/", "unheard of", "https://none.example/"]
    got = redirects.follow(spark.createDataFrame([(s,) for s in starts], "url string"), spark.createDataFrame(answers, "url string, status int, location string").withColumn("hops", F.lit(1)), most)
    want = plain(starts, answers, most)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {w[4] for w in want} == {"ok", "refused", "too_many"}


def test_edges(spark):
    answers = spark.createDataFrame([("https://a.example/", 302, "https://a.example/")], "url string, status int, location string")
    got = redirects.follow(spark.createDataFrame([(None,), ("https://a.example/",)], "url string"), answers).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, None, 0, None, "refused"), ("https://a.example/", "https://a.example/", 10, 302, "too_many")], key=repr)
    none = answers.limit(0)
    assert redirects.follow(none.select("url"), none).count() == 0 and [r.outcome for r in redirects.follow(answers.select("url"), none).collect()] == ["ok"]


def test_sitemap_files(spark):
    page = "<urlset><url><loc>https://a.example/{}</loc></url></urlset>"
    files = [
        ("plain", page.format("é").encode()), ("gz", gzip.compress(page.format("gz").encode())), ("half", gzip.compress(page.format("half").encode())[:-6]), ("bom", b"\xef\xbb\xbf" + page.format("bom").encode()),
        ("latin", f'<?xml version="1.0" encoding="latin-1"?>{page.format("é")}'.encode("latin-1")), ("unknown", b'<?xml version="1.0" encoding="klingon"?><urlset/>'), ("bytes", b"\xff\xfe\x00"), ("none", None), ("empty", b""),
        ("open", b"<urlset><url><loc>https://a.example/open</loc></url>"), ("other", b"<rss><url><loc>https://a.example/rss</loc></url></rss>"), ("doctype", b"<!DOCTYPE urlset [<!ELEMENT x (y)>]>" + page.format("doctype").encode()),
        ("index", b'<?xml version="1.0"?>\n<!-- <urlset> --><s:sitemapindex xmlns:s="x"><s:sitemap><s:loc><![CDATA[https://a.example/m?a&b]]></s:loc></s:sitemap><s:url><s:loc>no</s:loc></s:url></s:sitemapindex>'),
        ("noloc", b"<urlset><url><lastmod>2024-01-01</lastmod></url><url><loc> </loc></url></urlset>"),
    ]
    frame = spark.createDataFrame(files, "url string, body binary").select("url", discovery.sitemap_text(F.col("body")).alias("xml"))
    got = {(r.url, r.kind, r.loc) for r in discovery.sitemap_entries(frame).collect()}
    at = "https://a.example/"
    assert got == {("plain", "page", f"{at}é"), ("gz", "page", f"{at}gz"), ("bom", "page", f"{at}bom"), ("latin", "page", f"{at}é"), ("doctype", "page", f"{at}doctype"), ("index", "index", f"{at}m?a&b")}


def test_sitemap_folder(spark, tmp_path):
    """Files below a folder, as bytes, through an index to the pages."""
    (tmp_path / "index.xml").write_bytes(b"<sitemapindex><sitemap><loc>https://a.example/one.xml.gz</loc></sitemap></sitemapindex>")
    (tmp_path / "one.xml.gz").write_bytes(gzip.compress(b"<urlset><url><loc>https://a.example/p</loc><lastmod>2024-02-03</lastmod></url></urlset>"))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.concat(F.lit("https://a.example/"), F.substring_index("path", "/", -1)).alias("url"), discovery.sitemap_text(F.col("content")).alias("xml"))
    pages = discovery.sitemap_urls(files, spark.createDataFrame([("https://a.example/index.xml",)], "url string"))
    assert [(r.loc, str(r.lastmod)) for r in pages.collect()] == [("https://a.example/p", "2024-02-03 00:00:00")]
