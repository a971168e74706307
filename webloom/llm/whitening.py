"""Embedding whitening with an exact scatter matrix: each partition multiplies its centred vectors modulo several primes, the residues are
summed by Spark, and Chinese remaindering makes of them the whole numbers that a double ``eigh`` then decomposes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import materialise, small_batches, table

#: Residues lie within half a prime of zero, so that the products of BLOCK rows of them add up below 2 ** 53, where doubles are whole numbers.
PRIME_BITS, BLOCK = 21, 8192
#: Entries of this size and more have no place in a long once scaled; such rows are left out.
MOST = 2.0**50


def primes_above(bound: int, bits: int = PRIME_BITS) -> list[int]:
    """The largest primes below ``2 ** bits``, as many as their product needs to exceed ``bound``."""
    sieve = np.ones(1 << bits, bool)
    sieve[:2] = False
    for k in range(2, int((1 << bits) ** 0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    found, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > bound:
            break
        found.append(p)
        product *= p
    return found


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id and ``x`` (array of long, ``floor(scale * c) + shift`` of each entry c as double) of the rows that have a vector without null or
    non-finite entries. Vectors of another length than most rows have (of two as frequent, the greater) are not in the space and go, and
    so do vectors with an entry beyond MOST."""

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(MOST))

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda c: F.coalesce(usable(c), F.lit(False))))
    usual = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        rows = rows.limit(0)
    else:
        rows = rows.where(F.size("v") == usual.dims)
    return rows.select("id", F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Centre:
    """n vectors, their sums by dimension, and the greatest distance of a vector from their mean, times n."""

    n: int
    sums: list[int]
    widest: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact; as longs where they fit, as Python's whole numbers elsewhere."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        if self.widest < 2**62:
            return self.n * (x - whole) - np.array(rest, np.int64)
        return self.n * (x - whole).astype(object) - np.array(rest, object)


def centre(fit: DataFrame) -> Centre | None:
    """What centring needs of the distinct vectors ``x``: one row a dimension reaches the driver. Sums are taken of high and low bits
    apart, so that none overflows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, least, most = 0, 0, 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n += len(x)
                high, low = high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)
                least = x.min(0) if least is None else np.minimum(least, x.min(0))
                most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            columns = [np.arange(len(high)), np.full(len(high), n), high, low, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["dim", "n", "high", "low", "least", "most"])

    parts = small_batches(fit).mapInArrow(part, "dim long, n long, high long, low long, least long, most long")
    by_dim = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")], F.min("least").alias("least"), F.max("most").alias("most"))
    rows = sorted(by_dim.collect(), key=lambda r: r.dim)
    if not rows:
        return None
    sums = [(r.high << 24) + r.low for r in rows]
    return Centre(rows[0].n, sums, max(max(r.n * r.most - s, s - r.n * r.least) for r, s in zip(rows, sums, strict=True)))


def exact_scatter(fit: DataFrame, at: Centre) -> np.ndarray:
    """The sum over the vectors of ``d d'`` with ``d = n * x - sums``, as Python's whole numbers. Each partition multiplies residues of d, in
    blocks whose sums doubles hold exactly; there are as many primes as n times the square of the widest deviation needs. Residues of one cell and
    prime a partition are shuffled; the driver gets their sums, a number that depends on the dimensions alone."""
    primes = primes_above(2 * at.n * at.widest**2 + 1)
    n, sums, dims = at.n, at.sums, len(at.sums)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(primes), dims, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                for k, p in enumerate(primes):
                    s = np.array([v % p for v in sums], np.int64)
                    for first in range(0, len(x), BLOCK):
                        d = (n % p * (x[first : first + BLOCK] % p) - s) % p
                        d = np.where(2 * d > p, d - p, d).astype(np.float64)
                        total[k] = (total[k] + (d.T @ d).astype(np.int64)) % p
        i, j = np.triu_indices(dims)
        for k in range(len(primes)):
            columns = [pa.array(np.full(len(i), k), pa.int32()), pa.array(i * dims + j, pa.int64()), pa.array(total[k][i, j], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["prime", "cell", "residue"])

    sums_of = small_batches(fit).mapInArrow(part, "prime int, cell long, residue long").groupBy("cell", "prime").agg(F.sum("residue").alias("residue"))
    found: dict[int, list[int]] = {}
    for r in sums_of.collect():
        found.setdefault(r.cell, [0] * len(primes))[r.prime] = r.residue % primes[r.prime]
    product = int(np.prod(np.array(primes, object)))
    parts = [product // p * pow(product // p, -1, p) for p in primes]
    out = np.zeros((dims, dims), object)
    for cell, residues in found.items():
        whole = sum(a * b for a, b in zip(residues, parts, strict=True)) % product
        out[divmod(cell, dims)] = out[divmod(cell, dims)[::-1]] = whole - product if 2 * whole > product else whole
    return out


@dataclass
class Whitening:
    """A fitted transform: components by falling eigenvalue of the covariance, which has the divisor n."""

    at: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    defined: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The vectors in units of standard deviations along each component; not a number where a component has no variance."""
        scale = np.where(self.defined, np.sqrt(np.where(self.defined, self.values, 1)), np.nan)
        return (self.at.deviations(x).astype(np.float64) / self.at.n) @ self.vectors / scale


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening | None:
    """The transform of the distinct vectors ``x``, or None without any. A component has no variance where its eigenvalue is no more than
    the rounding of the largest."""
    at = centre(fit)
    if at is None:
        return None
    scatter = exact_scatter(fit, at)
    trace = sum(scatter.diagonal().tolist())
    cube = at.n**3
    covariance = np.array([[int(c) / cube for c in row] for row in scatter])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    defined = values > max(values[0], 0) * len(covariance) * np.finfo(float).eps
    return Whitening(at, values, vectors, [float(e) / (trace / cube) if trace else None for e in values], defined)


def identity_error(fit: DataFrame, made: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of ``fit``; None without a
    component that has a variance."""
    used = np.flatnonzero(made.defined)
    if not len(used):
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used), len(used)))
        for batch in batches:
            if batch.num_rows:
                z = made.apply(_matrix(batch.column(0)))[:, used]
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "total"])

    cells = small_batches(fit).mapInArrow(part, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    covariance = np.zeros(len(used) ** 2)
    for r in cells:
        covariance[r.cell] = r.total / made.at.n
    return float(np.abs(covariance.reshape(len(used), -1) - np.eye(len(used))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of every usable vector, fitted on each distinct whole-number vector once (``integer_vectors``).

    Null vectors, null or non-finite entries, vectors of another length than most: the row goes. Ties and repeated rows: equal vectors
    are fitted once and whitened each. Null id: kept. Empty table: no rows. Extra columns are ignored. Fewer dimensions than
    ``components``: as many as there are. A component without variance (one vector only, or vectors in a plane): whitened and, without any variance at all,
    explained and identity_error are null.
    Returns one row a vector and component: the id, component (from 1), n, deviation (decimal), whitened, explained, identity_error.
    """
    vectors = integer_vectors(df, id_col, vector_col, scale, shift)
    fit = materialise(vectors.select("x").distinct())
    made = fit_whitening(fit, components)
    id_type = vectors.schema["id"].dataType.simpleString()
    if made is None:
        none = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
        return vectors.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    error = identity_error(fit, made)
    kept = len(made.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column(1))
            d = made.at.deviations(x)
            if made.at.widest**2 * x.shape[1] < 2**63:
                deviation = (d * d).sum(1).tolist()
            else:
                deviation = [sum(int(v) ** 2 for v in row) for row in d]
            every = np.repeat(np.arange(rows), kept)
            white = made.apply(x).ravel()
            columns = [
                batch.column(0).take(pa.array(every)),
                pa.array(np.tile(np.arange(1, kept + 1), rows), pa.int32()),
                pa.array([str(v) for v in deviation]).take(pa.array(every)),
                pa.array(white, mask=np.isnan(white)),
                pa.array(made.explained * rows, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "deviation", "whitened", "explained"])

    out = small_batches(vectors).mapInArrow(run, f"id {id_type}, component int, deviation string, whitened double, explained double")
    return out.select(
        F.col("id").alias(id_col),
        "component",
        F.lit(made.at.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the 16 widest directions. A deviation that no long holds is null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
