"""The pipeline, stage by stage, against plain versions of what each stage has to do, on whole documents; and each stage's edges."""

import duckdb
import numpy as np
import pytest
from tests.conftest import SF
from tests.llm.test_edges import benchmark
from tests.llm.test_operators import roots

import corpus_pipeline
from webloom.llm import decontamination, line_dedup, packing, quality_model
from webloom.llm.common import materialise

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before each stage, and the last stage's rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs
        docs = materialise(stage(spark, docs, SF))
    return out | {"end": docs}


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_order():
    assert list(STAGES) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def test_classifier_keeps_what_scores(spark, steps):
    before = steps["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_model.score_quality(before, labels).where("score >= 0.3").collect()}
    assert rows(steps["line_dedup"]) == [r for r in rows(before) if r[0] in good] and 0 < len(good) < before.count()


def test_lines_as_sql_cuts_them(steps):
    con = duckdb.connect()
    documents = steps["line_dedup"].toArrow()  # noqa: F841
    con.execute("CREATE TABLE d AS SELECT * FROM documents")
    con.execute("CREATE VIEW v AS SELECT * FROM d")
    cut = {r[0]: r[3] for r in con.execute(line_dedup.OP10_SQL.replace("FROM documents", "FROM v")).fetchall()}
    after = steps["simhash_near_dedup"]
    assert {r.doc_id: r.text for r in after.collect()} == cut and after.columns == steps["line_dedup"].columns


def test_one_text_of_each_group_stays(steps):
    before = {r.doc_id: r.text for r in steps["simhash_near_dedup"].collect()}
    words = {d: t.encode().lower().split() for d, t in before.items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    same = lambda a, b: sets[a] == sets[b] or (sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    group = roots(sorted(sets), [(a, b) for a in sets for b in sets if a < b and same(a, b)])
    kept = {r.doc_id: r.text for r in steps["benchmark_decontamination"].collect()}
    assert sorted(group[d] for d in kept) == sorted(set(group.values())) and all(before[d] == t for d, t in kept.items())


def test_leaking_documents_go(spark, steps):
    items = [decontamination.tokens_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(words):
        codes: dict = {}
        number = lambda ws: np.array([codes.setdefault(w, len(codes)) for w in ws], int)
        text = number(words)
        for item in items:
            span = min(12, len(item))
            if span < 5 or len(text) < span:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(text, span)
            for part in np.lib.stride_tricks.sliding_window_view(number(item), span):
                if ((windows == part).sum(1) >= 0.75 * span).any():
                    return True
        return False

    before = steps["benchmark_decontamination"].collect()
    clean = {r.doc_id for r in before if not leaks(decontamination.tokens_of(r.text))}
    assert {r.doc_id for r in steps["packing"].collect()} == clean


def test_every_token_is_packed(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 2] for r in steps["packing"].collect()}
    pieces: dict = {}
    for r in steps["end"].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for start, length, total in sorted(own):
            assert (start, total) == (at, len(ids[d]))
            at += length
        assert at == len(ids[d])


def test_run_is_its_stages(spark, steps):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(corpus_pipeline.run(spark, SF).select(*names)) == rows(steps["end"].select(*names))


def test_edges_of_each_stage(spark, edge, empty, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    of = lambda name, docs: STAGES[name](spark, docs, str(tmp_path))
    ids = lambda frame: sorted((r.doc_id is not None, r.doc_id or 0) for r in frame.collect())
    for name in list(STAGES)[:-1]:
        assert of(name, empty).count() == 0 and of(name, edge).columns == edge.columns
    # Labels of one kind: everything scores 1 and stays.
    assert of("quality_classifier", edge).count() == edge.count()
    lines = of("line_dedup", edge)
    assert ids(lines) == ids(edge) and lines.where("text IS NULL").count() == edge.where("text IS NULL").count()
    # The text without an id is the first of its copies, so it alone keeps the line; repeated rows end alike.
    assert [(r.doc_id, r.n) for r in lines.where("contains(text, 'lazy dog')").groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect()] == [(None, 1)]
    # Of the copies of one text the least doc_id stays, once; null, empty and blank texts are one group.
    kept = of("simhash_near_dedup", edge)
    clean = [r for r in kept.collect() if r.text and r.text.startswith("The quick")]
    # Written twice it shares 19 of 23 shingles with the text, so that both are one group, led by either.
    assert [r.doc_id for r in clean] in ([1], [5]) and [r.doc_id for r in kept.collect() if not (r.text or "").strip()] == [2]
    left = of("benchmark_decontamination", edge)
    assert ids(left) == ids(edge.where("text IS NULL OR NOT contains(text, 'jumps over the lazy dog')"))
    packed = of("packing", edge).collect()
    assert sum(r.start == 0 for r in packed) == edge.count() and [r.doc_tokens for r in packed if r.doc_id in (2, 3)] == [1, 1]
    assert of("packing", empty).count() == 0
