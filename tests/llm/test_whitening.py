"""Whitening against whole-number arithmetic over all rows on the driver."""

import numpy as np
import pytest
from tests.conftest import SF

from webloom.llm import whitening


def plain(rows, components=16):
    """What ``whiten`` has to return for rows (id, vector), by Python's whole numbers; the sign of a component is open."""
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], object)
    fit = np.array(sorted({tuple(v) for _, v in kept}), object)
    n, sums = len(fit), fit.sum(0)
    d = n * fit - sums
    covariance = np.array((d.T @ d) / n**3, float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    own = n * x - sums
    return [i for i, _ in kept], n, (own**2).sum(1).tolist(), np.array(own / n, float) @ vectors / np.sqrt(values), values / np.trace(covariance)


def check(got, rows, components=16):
    ids, n, deviation, white, explained = plain(rows, components)
    got = got.toPandas().sort_values(["vec_id", "component"], kind="stable")
    order = np.argsort(ids, kind="stable")
    assert set(got.n) == {n} and got.identity_error.max() < 1e-9
    mine = got.whitened.to_numpy().reshape(len(ids), -1)
    assert np.allclose(np.abs(mine), np.abs(white[order]), atol=1e-7)
    signs = np.sign((mine * white[order]).sum(0))
    assert np.allclose(mine * signs, white[order], atol=1e-7)
    assert got.deviation.astype(object).map(int).tolist() == np.repeat(np.array(deviation, object)[order], white.shape[1]).tolist()
    assert np.allclose(got.explained.to_numpy().reshape(len(ids), -1), explained, rtol=1e-9)


def test_all_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(whitening.op12_whitening(spark, SF), rows)


def test_copies_and_wide_values(spark, monkeypatch):
    """Equal vectors count once, sums of several blocks and primes stay exact, and values far from zero do not blur the covariance."""
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 5)) * [1, 100, 1e3, 1e4, 3] + 1e7
    rows = [(k, base[k % 60 if k % 3 else 0].tolist()) for k in range(200)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)


def test_deviations_beyond_a_long(spark):
    rows = [(1, [1e13, 0.0]), (2, [-1e13, 5.0]), (3, [0.0, 1e12])]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows, 2)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (None, [1.5, -1.0, 2.0]), (3, None), (4, [1.0, None, 2.0]), (5, [1.0, nan, 2.0]), (6, [1.0, -inf, 2.0]), (7, []), (8, [1.0]), (9, [1e300, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS x", "1 AS n", "2 AS component", "'b' AS id", "3 AS deviation")
    got = whitening.whiten(frame).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (1, 1, 0) for c in (1, 2, 3))
    # Two distinct vectors have one direction; the other components have no variance.
    assert {(r.component, r.whitened is None, r.n) for r in got} == {(1, False, 2), (2, True, 2), (3, True, 2)}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in got if r.component == 1)
    assert whitening.whiten(frame.limit(0)).count() == 0
    one = whitening.whiten(frame.where("vec_id = 1")).collect()
    assert {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one} == {(None, None, None, 0)}


@pytest.mark.parametrize("bound", [1, 10**6, 10**40])
def test_primes(bound):
    found = whitening.primes_above(bound)
    assert int(np.prod(np.array(found, object))) > bound and len(set(found)) == len(found)
    assert all(p % q for p in found for q in (2, 3, 5, 7, 11, 13, 1009)) and all(whitening.BLOCK * (p // 2) ** 2 <= 2**53 for p in found)
