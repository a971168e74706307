"""What is handed to sinks, written as a run, and read back; search items and benchmark bags against plain versions."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import benchmark, search, telemetry
from webloom.sources import writers
from webloom.streaming import streams


def test_rows_in_one_pass(spark, tmp_path):
    """At most so many a call, each row once, in order within a task; a failing call fails the batch, which is sent again."""
    spark.range(330).repartition(3).write.parquet(f"{tmp_path}/in")
    (tmp_path / "got").mkdir()
    place, flag = str(tmp_path / "got"), str(tmp_path / "failed")

    def send(rows):
        import os
        import uuid

        if any(r.id == 77 for r in rows) and not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("no route")
        with open(f"{place}/{uuid.uuid4().hex}", "w") as f:
            f.write(" ".join(str(r.id) for r in rows))

    source = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    query = lambda: streams.send_rows(source(), send, checkpoint=f"{tmp_path}/state", most=25, at_exit=True, order="id")
    try:
        query().awaitTermination()
        raise AssertionError("a call failed")
    except Exception as e:  # noqa: BLE001
        assert "no route" in str(e)
    for f in (tmp_path / "got").iterdir():
        f.unlink()
    query().awaitTermination()
    calls = [list(map(int, f.read_text().split())) for f in (tmp_path / "got").iterdir()]
    assert sorted(k for c in calls for k in c) == list(range(330)) and max(map(len, calls)) == 25 and all(c == sorted(c) for c in calls)


def test_parts_are_never_larger(spark, tmp_path):
    spark.range(333).repartition(4).write.parquet(f"{tmp_path}/in")
    sizes: list = []
    streams.flush(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda part: sizes.append(part.count()), checkpoint=f"{tmp_path}/state", at_exit=True).awaitTermination()
    assert sum(sizes) == 333 and max(sizes) <= 25


def test_payloads_in_slices(spark):
    log = spark.range(700).selectExpr("id AS event_id", "IF(id % 9 = 0, 'search', 'scrape') AS kind", "CAST(timestamp_seconds(FLOOR(id / 3)) AS STRING) AS ts")
    plain = lambda rows: sorted((r.kind, r.batch, r.n, r["values"]) for r in rows.collect())
    whole = plain(telemetry.stream_batches(log, "j", 40))
    assert whole == plain(telemetry.stream_batches(log, "j", 40, rows_per_slice=50)) and sum(r[2] for r in whole) == 700 and max(r[2] for r in whole) == 40
    ids = [json.loads(v[1])["event_id"] for r in whole if r[0] == "scrape" for v in r[3]]
    assert ids == sorted(ids)


def test_runs(spark, tmp_path):
    rows = [(k, "a" if k % 2 else "b", True, k % 3 > 0, 10.0 * k, float(k)) for k in range(10)]
    cases = spark.createDataFrame(rows, "case_id int, category string, scored boolean, success boolean, quality double, latency_ms double")
    writers.write_run(cases, "r1", f"file://{tmp_path}")
    writers.write_run(cases.where("case_id < 4"), "r2", f"file://{tmp_path}")
    one = json.loads((tmp_path / "runs" / "r1.json").read_text())
    assert one["run_id"] == "r1" and one["overall"]["total_cases"] == 10 and [c["category"] for c in one["categories"]] == ["a", "b"] and one["categories"][0]["quality"] == 50.0
    index = spark.read.json(f"{tmp_path}/index")
    assert [r.run_id for r in writers.list_runs(index).collect()] == ["r2", "r1"] and spark.read.json(f"{tmp_path}/metrics").where("run_id = 'r2'").count() == 4
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["r1.json", "r2.json"]


def test_items_of_all_providers(spark):
    """One row an item by each provider's own fields; the answers are scanned once."""
    rows, want = [], set()
    for k, ((provider, source), (path, fields)) in enumerate(search.PROVIDERS.items()):
        item: dict = {}
        for name, field in fields.items():
            at = item
            *heads, last = field.split(".")
            for h in heads:
                at = at.setdefault(h, {})
            at[last] = 7 if name.startswith("image_") else f"{provider}-{source}-{name}"
        body: dict = {}
        at = body
        *heads, last = path.removeprefix("$.").split(".")
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = [item, item, {}]
        rows.append((k, provider, source, json.dumps(body)))
        want |= {(k, place, source, f"{provider}-{source}-title", 7 if "image_width" in fields else None) for place in (0, 1)}
        want.add((k, 2, source, None, None))
    rows += [(90, "unknown", "web", "{}"), (91, "brave", "web", "broken"), (92, None, "web", "{}"), (93, "brave", "web", None), (94, "brave", "maps", "{}")]
    frame = spark.createDataFrame(rows, "search int, provider string, source string, body string")
    got = search.items(frame)
    assert {(r.search, r.ordinal, r.source_type, r.title, r.image_width) for r in got.collect()} == want and got.count() == len(want)
    assert search.items(frame, limit=1).where("ordinal > 0").count() == 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_enriched_takes_the_latest(spark):
    found = spark.createDataFrame([(1, "u", "web"), (2, "u", "images"), (3, "v", "web")], "search int, url string, source_type string")
    scraped = [("u", "old", "2024-01-01"), ("u", "new", "2024-03-01"), ("u", "mid", "2024-02-01"), (None, "x", "2024-01-01")]
    frame = spark.createDataFrame(scraped, "url string, markdown string, scraped_at string")
    assert {(r.search, r.markdown) for r in search.enriched(found, frame).collect()} == {(1, "new"), (2, None), (3, None)}
    assert {(r.search, r.markdown) for r in search.enriched(found, frame.drop("scraped_at").repartition(3)).collect()} == {(1, "old"), (2, None), (3, None)}


def test_bags_of_two_texts(spark):
    """In one Arrow pass what the expressions give."""
    rng = random.Random(12)
    words = ["the", "The", "a_b", "über", "ÜBER", "日本", "x1", "don't", "½", "--", "é", "naïve", "Σας", "ſ"]
    rows = [(k, *[None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(2)]) for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, a string, b string")
    got = frame.select("k", benchmark.text_prf(F.col("a"), F.col("b")).alias("x"), benchmark.prf(T.tokenize(F.col("a")), T.tokenize(F.col("b"))).alias("y")).collect()
    assert all(tuple(r.x) == tuple(r.y) for r in got) and Counter(r.x.overlap > 0 for r in got)[True] > 100


def test_urls_of_a_table_are_fetched(spark):
    from webloom.sources.providers import PageSource, fetched

    class Stub(PageSource):
        @staticmethod
        def fetch(url):
            return url, f"<p>{url}</p>", None if url.endswith("9") else 200

    urls = spark.range(100).selectExpr("CONCAT('https://a.example/', id % 60) AS url").union(spark.sql("SELECT CAST(NULL AS STRING)"))
    got = fetched(urls, Stub, parts=4).collect()
    assert len(got) == 100 and sum(r.status_code is None for r in got) == 10 and all(r.html == f"<p>{r.url}</p>" for r in got)
    assert fetched(urls.limit(0), Stub).count() == 0


def test_summary_trim(spark):
    texts = ["short", "x" * 600, "a. " + "b" * 600, "c." * 300, "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.trimmed_summary(F.col("t"))).collect()]
    assert got == ["short", "x" * 497 + "...", "a.", "c." * 250, "", None]
