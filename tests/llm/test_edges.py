"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names; every stage too."""

import corpus_pipeline
from webloom.llm import decontamination, line_dedup, packing, pii, quality_model, quality_rules, sharding, simhash, toxicity, url_filter

N = 15


def benchmark(spark):
    text = "jumps over the lazy dog while the small grey cat sleeps near the old stone wall"
    return spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "two words"), (1, text)], "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS start")


def test_rows(spark, edge, empty, labels):
    for docs, n in ((edge, N), (empty, 0)):
        assert sharding.shard_by_size(docs).count() == n
        assert quality_rules.line_frequency_rules(docs).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert quality_model.score_quality(docs, labels).where("score BETWEEN 0 AND 1").count() == n
        assert toxicity.score_toxicity(docs, labels).where("score BETWEEN 0 AND 1").count() == n
        assert pii.pseudonymise(docs, b"k").count() == n
        assert line_dedup.dedup_lines(docs).count() == n
        packed = packing.pack(docs, packing.default_tokenizer())
        assert packed.where("start = 0").count() == n
    assert quality_model.score_quality(edge, labels.limit(0)).count() == N
    assert toxicity.score_toxicity(edge, labels.limit(0)).count() == N


def test_shards_of_edges(edge):
    rows = sharding.shard_by_size(edge).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_leaks(spark, edge, empty):
    got = decontamination.find_leaks(edge, benchmark(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (None, 1), (5, 1)}
    assert len(got) == 4
    assert decontamination.find_leaks(empty, benchmark(spark)).count() == 0
    assert decontamination.find_leaks(edge, benchmark(spark).limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.net/es/", "https://net", "x" * 50_000 + "://h", "https://ü.example/" + "p" * 20_000, "http://a\n.com/b"]
    pages = spark.createDataFrame([(k, u, "path", "rule") for k, u in enumerate([*urls, *urls])], "page_id long, url string, path string, rule string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.default_labels(spark)).collect()}
    assert len(rows) == 2 * len(urls)
    assert (rows[0].host, rows[0].path, rows[0].rule, rows[0].verdict) == ("", "", None, "allow")
    assert (rows[5].host, rows[5].path, rows[5].rule, rows[5].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (rows[6].rule, rows[6].verdict) == ("net/es/", "block")
    assert rows[7].rule is None
    assert url_filter.filter_urls(pages.limit(0), url_filter.default_labels(spark)).count() == 0
    assert url_filter.filter_urls(pages, url_filter.default_labels(spark).limit(0)).count() == 2 * len(urls)


def test_stages_keep_columns(spark, edge, empty, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.count()
