"""Functions and operators on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.dom import extract as E
from webloom.dom.markdown import convert
from webloom.dom.tree import SelectorError, compile_selector, parse, select
from webloom.functions import arguments, detection, edits, text, urls
from webloom.functions.addresses import is_refused, refused
from webloom.operators import benchmark, discovery, folds, outputs, pages, requests, search, services, telemetry, versions
from webloom.sources import readers, writers
from webloom.streaming import streams

PAGE = """<html lang="en"><head><title> A &amp; B </title><meta name="description" content="d"><meta property="og:image" content="/i.png"><link rel="canonical" href="/c">
<script type="application/ld+json">{"@graph":[{"@type":"X","timezone":"Europe/Paris"},{"a":1}]}</script><script type="application/ld+json">{broken</script>
<style>:root{--brand-color: #123; --gap-small: 4px;} body{font-family: "Inter", serif; font-size: 16px;} .x{background:url('bg.png')}</style></head><body><nav class="menu"><a href="/nav">nav</a></nav>
<article><h1>Title</h1><p>One <b>bold</b> and <a href="/rel?q=1">a link</a> and <a href="javascript:x()">no link</a>.<p>Second paragraph has several more words in it
<ul><li>first<li>second</ul><table><tr><th>h|1</th><th>h2</th></tr><tr><td>1</td><td>2</td></tr></table><pre><code class="language-py">x = 1
</code></pre><img src="a.png" alt="alt"><img src="/tracking/1x1.gif"></article><div itemscope itemtype="T"><span itemprop="n">v</span><span itemprop="n">w</span><div itemprop="in" itemscope><time itemprop="t" datetime="2024">x</time></div></div>
<footer>foot</footer><script>var s = "<p>not text</p>";</script></body></html>"""


def test_tree_and_markdown():
    md = convert(PAGE, "https://x.example/a/")
    assert "# Title" in md and "**bold**" in md and "[a link](https://x.example/rel?q=1)" in md and "no link" in md and "javascript" not in md
    assert "| h\\|1 | h2 |" in md and "| --- | --- |" in md and "```py\nx = 1\n```" in md and "![alt](https://x.example/a/a.png)" in md
    assert "nav" not in md and "foot" not in md and "not text" not in md
    assert "foot" in convert(PAGE, only_main=False)
    assert convert(PAGE, include=["h1"]) == "# Title" and "Title" not in convert(PAGE, exclude=["h1", "???"])
    assert convert("<p>a<p>b<b>c") == "a\n\nb**c**" and convert(None) == "" and convert("plain &lt;x&gt; <!-- no -->text") == "plain <x> text"
    assert convert("<div>" * 5000 + "deep") == "deep"


def test_extraction():
    root = parse(PAGE)
    meta = E.metadata(PAGE)
    assert (meta["title"], meta["language"], meta["canonical_url"], meta["og_image"], meta["timezone"]) == ("A & B", "en", "/c", "/i.png", "Europe/Paris")
    assert E.links(root, "https://x.example/") == ["https://x.example/nav", "https://x.example/rel?q=1"]
    assert E.images(root, "https://x.example/") == ["https://x.example/a.png", "https://x.example/bg.png"]
    assert [x.get("a") for x in E.json_ld(root)] == [None, 1]
    assert E.microdata(root) == [{"type": "T", "properties": {"n": ["v", "w"], "in": {"properties": {"t": "2024"}}}}]
    brand = E.branding(root, "https://x.example/")
    assert brand["colors"] == {"primary": "#123"} and brand["fonts"] == ["Inter"] and brand["spacing"] == {"gap-small": "4px"} and brand["font_sizes"] == {"body": "16px"}


def test_selectors():
    root = parse('<main id="m"><p class="a b" data-x="One">x</p><div><p>y</p></div></main>')
    counts = {s: len(select(root, s)) for s in ("p", "main > p", "main p", ".a.b", "#m .a", "[data-x]", "[data-x*='ne']", "[data-x='one' i]", "p, div", "p.c")}
    assert list(counts.values()) == [2, 1, 2, 1, 1, 1, 1, 1, 3, 0]
    for bad in ("p:hover", "", "p >", "??"):
        with pytest.raises(SelectorError):
            compile_selector(bad)


def test_sections_by_query():
    root = parse("<body><h2>apples</h2><p>apples are red apples</p><h2>boats</h2><p>boats float on water</p><h2>cars</h2><p>cars drive on roads</p></body>").first("body")
    kept = E.keep_sections(E.sections(root), 1.0, "apples")
    assert len(kept) == 1 and "apples" in kept[0].text(" ")
    assert len(E.keep_sections(E.sections(root), 0.0, None)) == 3


def test_lcs():
    assert benchmark.lcs_length(list("abcbdab"), list("bdcaba")) == 4
    assert benchmark.lcs_length([], ["a"]) == 0
    assert benchmark.lcs_length(["a"] * 500, ["a"] * 300) == 300


def test_addresses(spark):
    refused_hosts = ["169.254.169.254", "::ffff:169.254.169.254", "64:ff9b::a9fe:a9fe", "2002:a9fe:a9fe::", "::169.254.169.254", "fe80::1"]
    assert all(is_refused(h, False) for h in refused_hosts)
    private = ["10.1.2.3", "172.31.0.1", "127.0.0.1", "::1", "::", "fd00::1", "::ffff:10.0.0.1", "[::1]", "100.64.0.1"]
    assert not any(is_refused(h, False) for h in private) and all(is_refused(h, True) for h in private)
    assert not any(is_refused(h, True) for h in ["8.8.8.8", "example.com", None, "2606:4700::1111", "172.32.0.1"])
    frame = spark.createDataFrame([("::ffff:10.0.0.1", True), ("8.8.8.8", True)], "h string, s boolean")
    assert [r.x for r in frame.select(refused(F.col("h"), F.col("s")).alias("x")).collect()] == [True, False]


def test_globs(spark):
    frame = spark.createDataFrame([("https://x.example/blog/a.html",), ("https://x.example/shop/b",), (None,)], "url string")
    got = [r.x for r in frame.select(urls.matches(F.col("url"), ["*/blog/*"], ["*.pdf"]).alias("x")).collect()]
    assert got == [True, False, None]


def test_robots(spark):
    text = "User-agent: bot\nDisallow: /private\nAllow: /private/open$\nUser-agent: *\nDisallow: /\nCrawl-delay: x\nCrawl-delay: 3\n"
    files = spark.createDataFrame([("https://a.example:443", text), ("https://b.example:443", "User-agent: *\nDisallow: /"), ("https://c.example:443", None)], "origin string, content string")
    pages_ = spark.createDataFrame([(k, u) for k, u in enumerate(["https://a.example/x", "https://a.example/private/1", "https://a.example/private/open", "https://b.example/", "https://c.example/"])], "page_id long, url string")
    rules = discovery.robots_rules(files, "Bot")
    got = {r.page_id: r.allowed for r in discovery.allowed_by_robots(pages_, rules).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_fallback_and_health(spark):
    rows = [("p", k, o) for k, o in enumerate(["failure", "failure", "failure", "empty", "success", "empty", "empty", "empty", "failure"])]
    frame = spark.createDataFrame(rows, "provider string, seq long, outcome string").withColumn("ts", F.timestamp_seconds("seq"))
    assert [r.status for r in folds.provider_health(frame).orderBy("seq").collect()] == ["degraded", "degraded", "unavailable", "degraded", "healthy", "healthy", "healthy", "degraded", "degraded"]


def test_arguments():
    assert arguments.query("  x ") == "x" and arguments.number(99, "limit", 1, 10) == 10 and arguments.url("https://x.example/") and arguments.subset(["web", "web"], "sources", arguments.SOURCES) == ["web"]
    for bad in (lambda: arguments.query(" "), lambda: arguments.url("ftp://x"), lambda: arguments.number(True, "n", 1, 2), lambda: arguments.subset(["x"], "sources", arguments.SOURCES)):
        with pytest.raises(arguments.ArgumentError):
            bad()


def test_scrape_service(spark):
    raw = spark.createDataFrame([(1, "https://x.example/", PAGE.replace("Second", "word " * 60), 200), (2, "https://x.example/b", "<p>few", 404), (3, None, None, None)], "page_id long, url string, html string, status int")
    got = {r.page_id: r for r in services.scrape(raw).collect()}
    assert (got[1].verdict, got[1].success, got[1].error) == ("ok", True, None)
    assert (got[2].verdict, got[2].success) == ("error_status", False) and got[2].error
    assert got[3].verdict == "empty"
    history = spark.createDataFrame([(1, "x")], "k int, markdown string").select(urls.cache_key(F.lit("https://x.example/")).alias("cache_key"), F.lit("h").alias("content_hash"), "markdown", F.current_timestamp().alias("cached_at"))
    tracked = {r.page_id: r.change_status for r in services.track_changes(services.scrape(raw), history, ("git-diff",)).collect()}
    assert tracked == {1: "changed", 2: None, 3: None}
    found = services.discover(raw, "https://x.example/", depth=2)
    assert {r.url for r in found.collect()} == {"https://x.example/", "https://x.example/nav", "https://x.example/rel?q=1", "https://x.example/c"}


def test_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"kind":"scrape","ts":"2024-01-01T00:00:00+00:00","domain":"a"}\n\nbroken\n{"kind":"search","ts":"x"}\n')
    assert [r.domain for r in readers.read_events(spark, f"{tmp_path}/log.jsonl", "scrape").collect()] == ["a"]
    assert readers.read_events(spark, f"{tmp_path}/log.jsonl", since="2023-01-01").count() == 1
    (tmp_path / "urls.txt").write_text("# no\n\n https://a \nhttps://b\n")
    assert [r.url for r in readers.read_urls(spark, f"{tmp_path}/urls.txt").collect()] == ["https://a", "https://b"]
    (tmp_path / "map.json").write_text('\n [{"url":"https://a","allowed":false},\n{"url":"https://b"}]')
    (tmp_path / "map.jsonl").write_text('{"url":"https://b"}\n{"url":"https://a#f?utm_source=x"}\n')
    assert search.map_entries(readers.read_map(spark, f"{tmp_path}/map.json")).collect()[0].url == "https://b"
    assert readers.read_map(spark, f"{tmp_path}/map.jsonl").count() == 2
    (tmp_path / "corpus.yaml").write_text("cases:\n- {id: a, url: https://a, category: x, stable: false}\n- {id: b, url: https://b, category: y, scored: true, expect: [one]}\n")
    assert {r.id: r.is_scored for r in readers.read_corpus(spark, f"{tmp_path}/corpus.yaml").collect()} == {"a": False, "b": True}
    (tmp_path / "f.bin").write_bytes(b"junk%PDF-1.7 rest")
    assert readers.read_pdfs(spark, f"{tmp_path}/f.bin").select("is_pdf").first()[0]
    writers.append_events(spark.createDataFrame([("search", None)], "kind string, domain string"), f"{tmp_path}/out")
    writers.append_events(spark.createDataFrame([("scrape", "b")], "kind string, domain string"), f"{tmp_path}/out")
    assert readers.read_events(spark, f"{tmp_path}/out").count() == 2


def test_diff(spark):
    frame = spark.createDataFrame([("a\nb\n", "a\nc\n"), ("x", "x"), (None, "n")], "a string, b string")
    got = [r.d for r in frame.select(edits.unified_diff(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == "--- previous\n+++ current\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n" and got[1] is None and got[2].endswith("+n")


def test_champion_by_hand(spark):
    rows = [("d", 1, "camoufox", False, "ok", 90), ("d", 2, None, False, "ok", 86), ("d", 3, None, False, "ok", 96), ("d", 4, None, False, "captcha", 0), ("d", 5, None, True, "thin", 99), ("d", 6, None, True, "ok", 39)]
    frame = spark.createDataFrame(rows, "domain string, seq int, engine string, stealth boolean, verdict string, score int").withColumn("wait_for", F.lit(0)).withColumn("only_main", F.lit(True)).withColumn("ts", F.current_timestamp())
    assert [(r.engine, r.ewma, r.samples) for r in folds.champions(frame.where("seq <= 3")).collect()] == [(None, 91.0, 2)]
    assert folds.champions(frame).count() == 0


def test_recovery(spark):
    frame = spark.createDataFrame([("short", "long " * 60), ("short", "still short"), (None, None)], "markdown string, full_markdown string")
    assert [(r.markdown or "")[:5] for r in pages.recovered(frame).collect()] == ["long ", "short", ""]


def test_services_keep_every_row(spark):
    html = "<html><body><article><p>" + "word " * 80 + "</p></article></body></html>"
    raw = spark.createDataFrame([(1, "u", html, 200), (1, "u", html, 200), (1, "u", html, 200), (None, "v", html, 404), (2, None, None, None)], "page_id long, url string, html string, status int")
    got = services.scrape(raw).collect()
    assert sorted((r.page_id or 0, r.success) for r in got) == [(0, False), (1, True), (1, True), (1, True), (2, False)]
    urls = spark.createDataFrame([(1, "v"), (2, "u"), (3, "w"), (4, "u"), (5, None)], "ordinal long, url string")
    done = services.batch(urls, raw, formats=("markdown",)).collect()
    assert [(r.ordinal, r.success, r.error is None) for r in done] == [(1, False, False), (2, True, True), (3, False, False), (4, True, True), (5, False, False)]
    gathered = spark.createDataFrame([(k, f'{{"k":{k}}}') for k in range(100)], "position int, data string")
    compiled = services.compile_results(gathered, 100).first().compiled
    assert len(compiled) <= 100 and [x["k"] for x in json.loads(compiled)["items"]] == list(range(10))


def test_page_formats_from_one_tree():
    for options in ((True, None, None), (False, None, None), (True, ["h1"], None), (True, None, ["h1", "footer"])):
        got = pages._one("https://x.example/a/", PAGE, pages.FORMATS, *options, 0.5, None)
        alone = {f: pages._one("https://x.example/a/", PAGE, (f,), *options, 0.5, None)[f] for f in pages.FORMATS}
        assert got == alone and got["markdown"] == convert(PAGE, "https://x.example/a/", *options)
    cleaned = E.cleaned(parse(PAGE))
    assert cleaned.startswith("<article>") and "<b>bold</b>" in cleaned and "<script" not in cleaned
    assert E.cleaned(parse(PAGE), only_main=False).startswith("<body>") and "foot" not in E.cleaned(parse(PAGE), only_main=False)
    assert E.cleaned(parse(PAGE), include=["h1", "b", "???"]) == "<div><h1>Title</h1><b>bold</b></div>" and "Title" not in E.cleaned(parse(PAGE), exclude=["h1"])


@pytest.mark.parametrize(("error", "family"), [
    ("timeout resolving dns", "timeout"), ("Could not resolve host", "dns"), ("nodename nor servname provided", "dns"), ("net::ERR_CONNECTION_CLOSED", "connection"),
    ("SSL certificate expired", "certificate"), ("502 Bad Gateway", "server"), ("dns", None),
])
def test_error_families(spark, error, family):
    row = spark.range(1).select(detection.first_of(F.lower(F.lit(error)), detection.ERROR_FAMILIES).alias("f"), detection.remediation_hint(F.lit(error)).alias("h")).first()
    assert row.f == family and (row.h is None) == (family is None)


def test_words_and_dates(spark):
    row = spark.range(1).select(text.word_count(F.lit("a\x1cb c")).alias("n"), F.bround(F.lit(72.25), 1).alias("half")).first()
    assert (row.n, row.half) == (3, 72.2)
    entries = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-03-01 00:00:00"), ("c", None)], "loc string, t string").selectExpr("loc", "CAST(t AS TIMESTAMP) AS lastmod")
    assert [r.loc for r in discovery.modified_since(entries, "2024-02-01").collect()] == ["b"]


def test_files_are_written_one_a_row(spark, tmp_path):
    files = spark.createDataFrame([("a.md", "x"), ("b_1.html", "<p>é"), ("c.md", None)], "file string, content string")
    outputs.write_files(files, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.md", "b_1.html"] and (tmp_path / "out" / "b_1.html").read_text() == "<p>é"


def test_replay_stops_at_the_first_failure(spark):
    log = spark.createDataFrame([(k, "scrape" if k % 3 else "search", f"2024-01-0{1 + k % 3} 00:00:00") for k in range(40)], "event_id long, kind string, ts string")
    got: list = []
    done = telemetry.replay(log, lambda p: got.append(p) or 204, "j", batch=10)
    assert done == {"sent": 40, "complete": True, "last": {"ok": True, "status": 204, "detail": "ok"}} and all(len(p["streams"][0]["values"]) <= 10 for p in got)
    got.clear()
    done = telemetry.replay(log, lambda p: got.append(p) or (200 if len(got) < 3 else 401), "j", batch=10)
    assert (done["complete"], done["last"]["status"], len(got)) == (False, 401, 3) and done["sent"] == sum(len(p["streams"][0]["values"]) for p in got[:2])

    def broken(_: dict) -> int:
        raise OSError("no route")

    assert telemetry.check(broken, "j", 1) == {"ok": False, "status": None, "detail": "no route"}


def test_flush_in_parts(spark, tmp_path):
    spark.range(60).coalesce(1).write.parquet(f"{tmp_path}/in")
    sizes: list = []
    streams.flush(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda part: sizes.append(part.count()), checkpoint=f"{tmp_path}/state", at_exit=True).awaitTermination()
    assert sum(sizes) == 60 and len(sizes) == 3


def test_token_bucket(spark):
    asked = spark.createDataFrame([("p", k, 0.0, 10.0) for k in range(6)] + [("q", 1, 5.0, 1.0)], "provider string, seq long, arrival double, duration double")
    got = {(r.provider, r.seq): r.started for r in requests.token_bucket(asked, interval=1.0, burst=3, patience=11.5).collect()}
    assert got == {("p", 0): 0.0, ("p", 1): 1.0, ("p", 2): 2.0, ("p", 3): 10.0, ("p", 4): 11.0, ("p", 5): None, ("q", 1): 5.0}


def test_more_arguments():
    assert arguments.urls(["https://a.example"]) == ["https://a.example"] and arguments.steps(99) == 50 and arguments.timeout(None) == 30_000 and arguments.timeout(5) == 1_000
    for bad in ([], "x", ["ftp://a"]):
        with pytest.raises(arguments.ArgumentError):
            arguments.urls(bad)


def test_health_and_run_names(spark):
    parts = spark.createDataFrame([("browser", True, True), ("search", False, False)], "part string, needed boolean, ok boolean")
    assert tuple(requests.health(parts).first()) == ("degraded", ["search"])
    answers = spark.createDataFrame([("a", True, 5, None), ("b", True, 1, None), ("c", None, None, "x")], "provider string, success boolean, results int, error string")
    assert [r.ok for r in requests.probe(answers).collect()] == [True, False, False]
    moment = F.lit("2026-06-14 08:30:12").cast("timestamp")
    row = spark.range(1).select(requests.run_id(moment, F.lit("a1b2c3d4")).alias("a"), requests.run_id(moment, F.lit(None).cast("string")).alias("b")).first()
    assert tuple(row) == ("20260614T083012-a1b2c3d4", "20260614T083012")


def test_folds_in_slices_are_the_same(spark):
    """A history in many slices gives what it gives in one, also for a key that has nearly all rows."""
    rows = spark.range(3000).selectExpr("IF(id % 10 = 0, id % 7, 99) AS provider", "id AS seq", "timestamp_seconds(id) AS ts", "element_at(array('success', 'empty', 'failure', 'failure', 'empty'), CAST(pmod(xxhash64(id), 5) + 1 AS INT)) AS outcome")
    together = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    assert together(folds.provider_health(rows)) == together(folds.provider_health(rows, rows_per_slice=100))
    arrivals = rows.selectExpr("provider AS host", "seq AS ordinal", "CAST(pmod(xxhash64(seq), 900) AS DOUBLE) AS arrival", "CAST(0.25 AS DOUBLE) AS delay")
    assert together(folds.throttle(arrivals)) == together(folds.throttle(arrivals, rows_per_slice=100))
    made = rows.selectExpr("provider AS key", "seq AS version", "CAST(pmod(xxhash64(seq), 3) AS STRING) AS content_hash", "outcome <> 'failure' AS success")
    assert together(versions.change_status(made)) == together(versions.change_status(made, rows_per_slice=100))


def test_search_source(spark):
    from webloom.sources.providers import SearchSource

    class Stub(SearchSource):
        @classmethod
        def name(cls):
            return "tavily"

        @staticmethod
        def is_available():
            return True

        @staticmethod
        def search_web(query, limit):
            return '{"results":[{"url":"https://a.example/%s","title":"%d"}]}' % (query, limit)

    spark.dataSource.register(Stub)
    got = search.items(spark.read.format("tavily").option("queries", "x\n\ny").option("limit", "3").load()).orderBy("search").collect()
    assert [(r.search, r.provider, r.url, r.title) for r in got] == [(0, "tavily", "https://a.example/x", "3"), (1, "tavily", "https://a.example/y", "3")]


def test_f1_is_rounded_once(spark):
    """Ten words of which six are the reference's: exactly 0.75, which 2 * p * r / (p + r) misses by a bit; and 126 of 130 and 126."""
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [(1, f"{words('a', 6)} {words('x', 4)}", words("a", 6)), (2, f"{words('a', 126)} {words('x', 4)}", words("a", 126)), (3, "a", "b"), (4, "", None)]
    pairs = spark.createDataFrame(rows, "id int, e string, g string")
    got = benchmark.token_prf(pairs, "id", text.tokenize(F.col("e")), text.tokenize(F.col("g"))).orderBy("id").collect()
    assert [r.f1 for r in got] == [0.75, 252 / 256, 0.0, 0.0]


def test_sections_go_out_once(spark):
    """Words are counted before the shuffle: a row a section, a count a word, and twice a few counts go out. Rows of one section are one text."""
    rows = [(1, 0, "The cat"), (1, 1, "a dog"), (1, 1, "the dog the"), (1, 2, ""), (2, 0, "alone"), (3, 0, None)]
    scored = pages.bm25_sections(spark.createDataFrame(rows, "page int, section int, text string"), "the dog")
    # Section rows, words with a count of sections, those counts twice, and the words of sections of several rows.
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 5
    got = sorted((r.page, r.section, round(r.score, 5)) for r in scored.collect())
    assert [x[:2] for x in got] == [(1, 0), (1, 1), (1, 1), (1, 2), (2, 0), (3, 0)] and [x[2] for x in got[3:]] == [0.0, 0.0, 0.0] and got[1][2] == got[2][2]
