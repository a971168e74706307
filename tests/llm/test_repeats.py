"""Repeats against a table of all passages."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tests.conftest import SF

from webloom.llm import common, repeats


def plain(rows, window=200):
    """By every passage of every text (doc_id, text)."""
    rows = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[k : k + window] for _, t in rows for k in range(len(t) - window + 1))
    out = Counter()
    for doc, text in rows:
        gone = bytearray(len(text))
        for k in range(len(text) - window + 1):
            if seen[text[k : k + window]] > 1:
                gone[k : k + window] = b"\x01" * window
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[doc, len(text), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(text, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def result(docs):
    rows = repeats.remove_repeats(docs).collect()
    return Counter((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in repeats.op11_repeats(spark, SF).collect())
    assert got == plain(rows)


def test_planted(spark, monkeypatch):
    """Passages around 200 bytes at any place, copies, periodic texts and common passages; in pieces of a few windows, with most keys hot."""
    rng = random.Random(2)
    letters = "abcdefgh éß日"

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    common_part = [noise(n) for n in (120, 150, 160, 170, 180, 199, 200, 201, 230, 256, 257, 300, 600)]
    rows = []
    for k in range(160):
        text = noise(rng.randrange(0, 300))
        for _ in range(rng.randrange(0, 4)):
            part = rng.choice(common_part)
            first = rng.randrange(0, len(part) // 3)
            text += part[first : first + rng.randrange(100, 600)] + noise(rng.randrange(0, 150))
        rows.append((k, text))
    rows += [(k, rows[7][1]) for k in range(200, 230)] + [(300, "ab" * 300), (301, "ab" * 101), (302, "a" * 205), (303, "a" * 200), (304, "abc" * 66), (305, noise(40) + "xy" * 99 + noise(40)), (306, "z" * 210 + noise(50))]
    rows += [(400, "q" * 171 + noise(30) + "q" * 171), (401, ("n" * 150 + "m") * 3), (402, noise(60) + ("p" * 143 + "o") * 2)]
    want = plain(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(frame) == want
    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(repeats, "PIECE", 64)
    monkeypatch.setattr(repeats, "CHUNK", 777)
    assert result(frame) == want


def test_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    rows = [(d, t if t is None or len(t) < 100_000 else t[:100_000]) for d, t in rows]
    got = result(edge)
    ids = Counter((d, n, gone) for (d, n, gone, _, _), c in got.items() for _ in range(c))
    assert sum(got.values()) == len(rows) and ids[7, 100_000, 100_000] == 1 and ids[3, 0, 0] == 1 and ids[2, 0, 0] == 1 and ids[None, 0, 0] == 1
    assert result(empty) == Counter()


def test_cover():
    assert len(repeats.COVER) * (len(repeats.COVER) - 1) + 1 == repeats.PERIOD
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_hashes_and_sliding():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 500).astype(np.uint8)
    grams = repeats.Rolling(data, 9).grams(5)
    by = {}
    for k in range(496):
        by.setdefault(data[k : k + 5].tobytes(), set()).add(int(grams[k]))
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    for width in (1, 2, 7, 96):
        assert repeats.sliding(grams, width, np.minimum, 2**64 - 1).tolist() == [grams[k : k + width].min() for k in range(len(grams) - width + 1)]
        assert repeats.sliding(grams, width, np.maximum, 0).tolist() == [grams[k : k + width].max() for k in range(len(grams) - width + 1)]


def test_batches_are_bound_by_bytes(spark):
    """A thousand regions would be 64 MB in the executor's memory outside its heap, twice a task."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    repeats.remove_repeats(spark.createDataFrame([(1, "x" * 500)], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 1 << 22


def test_ranks_of_blocks_that_are_there_again(spark, monkeypatch):
    """What is there once gets no rank: no table of ranks has a block of which there is one in all."""
    once, write = [], repeats._written

    def spy(df, *used):
        out = write(df, *used)
        if {"name", "stretch", "one", "rows"} <= set(out.columns) and "repeated" not in out.columns:
            once.append(out.groupBy("name").agg(F.sum("n").alias("n")).where("n = 1").count())
        return out

    monkeypatch.setattr(repeats, "_written", spy)
    assert repeats.op11_repeats(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert once == [0]


def test_windows_travel_in_packs(spark, monkeypatch):
    """Hashes meet in rows of a pack and bucket: no step writes a row for every window that it compares."""
    rows, write = [], repeats._written
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(190))
    docs = [(k, "".join(rng.choice("abcdefgh ") for _ in range(100)) + part + "".join(rng.choice("abcdefgh ") for _ in range(100))) for k in range(300)]

    def spy(df, *used):
        out = write(df, *used)
        if "stretch" not in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(repeats, "_written", spy)
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == plain(docs)
    assert max(rows) <= 2000


def test_more_than_once(spark, monkeypatch):
    """Over packs and within, with equal first hashes of which the second ones differ, and hashes without second ones."""
    rng = np.random.default_rng(6)
    packs = [(rng.integers(0, 2**64, 40, dtype=np.uint64)[rng.integers(0, 40, n)], rng.integers(0, 2, n).astype(np.uint32), rng.integers(1, 3, n)) for n in (0, 1, 30, 200)]
    packs += [(one[::-1].copy(), two[::-1].copy(), weight) for one, two, weight in packs[2:]] + [(rng.integers(0, 2**64, 50, dtype=np.uint64), np.zeros(50, np.uint32), np.ones(50, np.int64))]
    for second in (True, False):
        seen, sent, ranks = Counter(), [], []
        for k, (one, two, weight) in enumerate(packs):
            rank, columns = repeats._sent(k, 7, one, two if second else None, weight)
            ranks.append(rank)
            sent.append(repeats._rows(repeats.SENT, *columns))
            for a, b, w in zip(one.tolist(), two.tolist(), weight.tolist(), strict=True):
                seen[a, b if second else 0] += w
        frame = spark.createDataFrame([tuple(r.values()) for batch in sent for r in batch.to_pylist()], repeats.SENT).repartition(3)
        answers = repeats.more_than_once(frame).toArrow()
        masks = dict(zip(answers.column("pack").to_pylist(), repeats._masks(answers.combine_chunks().to_batches()[0], 1), strict=True))
        for k, (one, two, _) in enumerate(packs):
            got = masks.get(k, np.zeros(0, bool))[ranks[k]].tolist()
            assert got == [seen[a, b if second else 0] > 1 for a, b in zip(one.tolist(), two.tolist(), strict=True)]


def test_marks_are_dealt_evenly():
    """Marks are least hashes; by their own first bits nearly all would meet in one bucket."""
    data = np.random.default_rng(7).integers(97, 123, 400_000).astype(np.uint8)
    name = repeats.marked_grams(data, np.array([0, len(data)]))[1]
    sent = repeats._rows(repeats.SENT, *repeats._sent(0, 16, repeats.evenly(name.tobytes()), None, np.ones(len(name), np.int64))[1])
    sizes = [len(v) for v in sent.column(2).to_pylist()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)


def test_large_rows_are_read_a_few_at_a_time(spark):
    """A row group of packs is read at once, up to 4096 rows: by Spark's usual 128 MB a small heap is full."""
    rows = spark.range(40, numPartitions=1).select(F.col("id").alias("pack"), F.expr("cast(array_join(transform(sequence(1, 30000), x -> sha2(cast(id * 100000 + x AS string), 256)), '') AS binary)").alias("body"))
    found = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in repeats._written(rows).inputFiles()]
    groups = [meta.row_group(k) for meta in found for k in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40 and max(g.total_byte_size for g in groups) < 1 << 25
