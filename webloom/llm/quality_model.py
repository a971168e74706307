"""Quality classifier: random-indexing word vectors, pooled per document, feed a two-layer numpy network whose
probabilities are calibrated with a temperature."""

from __future__ import annotations

import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import one_text_an_id, small_batches, table

#: Hashed vocabulary, vector length, neighbours on each side, nonzero entries of an index vector.
WORDS, DIMS, REACH, NONZERO = 8192, 32, 2, 2
#: Labelled documents learned from at most: those of the smallest hashes.
MAX_LABELLED = 20_000
HELD_OUT = 5
MEMO = 350_000
#: The vector table travels in so many rows, added up in so many strands before the last sum.
BLOCKS, STRANDS = 16, 32

#: What may stand around a word's body.
SIGNS = string.punctuation + "«»“”„‘’…–—¿¡"
_CAPITALS, _MIXED, _NUMBER = 0, 1, 2


def _bucket(unit: str) -> int:
    return 8 + xxhash.xxh32_intdigest(unit, 3) % (WORDS - 8)


class Units(dict):
    """A text as units of a hashed vocabulary: each word's body, the signs around it, and a mark for odd shapes. The dictionary remembers
    words; it is emptied when it has too many."""

    def __missing__(self, word: str) -> bytes:
        body = word.strip(SIGNS)
        units = []
        if not body:
            units.append(_bucket(">" + word))
        else:
            at = 0 if body is word else word.index(body)
            if at:
                units.append(_bucket("<" + word[:at]))
            low = body.lower()
            units.append(_bucket(low))
            if low != body and len(body) > 1:
                if body.isupper():
                    units.append(_CAPITALS)
                elif low[1:] != body[1:]:
                    units.append(_MIXED)
            elif not body.isalpha() and any(map(str.isdigit, body)):
                units.append(_NUMBER)
            if at + len(body) < len(word):
                units.append(_bucket(">" + word[at + len(body) :]))
        ids = self[word] = array("H", units).tobytes()
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").split())), np.uint16)


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every unit's random index vector, the same in every process."""
    rng = np.random.default_rng(2024)
    return rng.integers(0, DIMS, (NONZERO, WORDS)), rng.choice([-1.0, 1.0], (NONZERO, WORDS))


def _chunks(texts: list[str | None], units: Units, size: int = 25_000) -> Iterator[tuple[list[np.ndarray], int]]:
    """Runs of texts of about ``size`` units, with the place of the first."""
    own, n, first = [], 0, 0
    for k, text in enumerate(texts):
        u = units(text)
        own.append(u)
        n += len(u)
        if n >= size:
            yield own, first
            own, n, first = [], 0, k + 1
    if own:
        yield own, first


def context_vectors(docs: DataFrame) -> np.ndarray:
    """WORDS x DIMS sums, over every neighbour of every word of all documents, of the neighbours' index vectors. The
    partial sums are whole numbers, so their order does not matter; a fixed number of rows reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, (places, signs) = Units(), index_entries()
        total = np.zeros(WORDS * DIMS)
        strand = 0
        for batch in batches:
            for own, _ in _chunks(batch.column(0).to_pylist(), units, 200_000):
                u = np.concatenate(own).astype(np.int64)
                doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
                strand = (strand + len(u)) % STRANDS
                for gap in range(1, REACH + 1):
                    same = doc[gap:] == doc[:-gap]
                    a, b = u[:-gap][same], u[gap:][same]
                    for k in range(NONZERO):
                        total += np.bincount(a * DIMS + places[k][b], signs[k][b], WORDS * DIMS)
                        total += np.bincount(b * DIMS + places[k][a], signs[k][a], WORDS * DIMS)
        yield from _as_rows({(strand, k): part for k, part in enumerate(np.split(total, BLOCKS))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for strand, block, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sums[strand, block] = sums.get((strand, block), 0) + np.frombuffer(part)
        yield from _as_rows(sums)

    schema = "strand int, block int, part binary"
    partial = small_batches(docs).select("text").mapInArrow(count, schema)
    strands = partial.repartition("strand", "block").mapInArrow(add, schema)
    whole = strands.select(F.lit(0).alias("strand"), "block", "part").repartition("block").mapInArrow(add, schema)
    out = np.zeros((BLOCKS, WORDS * DIMS // BLOCKS))
    for r in whole.collect():
        out[r.block] += np.frombuffer(r.part)
    return out.reshape(WORDS, DIMS)


def _as_rows(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([np.asarray(v, float).tobytes() for v in sums.values()], pa.binary())],
            names=["strand", "block", "part"],
        )


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Per unit its context vector, of length one and less the mean direction, beside its own index vector."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    unit = np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)
    used = norm[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(0)
    own = np.zeros((WORDS, DIMS))
    places, signs = index_entries()
    for k in range(NONZERO):
        np.add.at(own, (np.arange(WORDS), places[k]), signs[k])
    return np.concatenate([unit, own], axis=1).astype(np.float32)


def pooled(own: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Per document the mean of its units' vectors, how often a unit equals one of the two before it, and its length."""
    sizes = np.array([len(x) for x in own])
    out = np.zeros((len(own), vectors.shape[1] + 3), np.float32)
    u = np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
        n = sizes[some][:, None]
        out[some, :-3] = np.add.reduceat(vectors.take(u, axis=0), starts, axis=0) / n
        doc = np.repeat(np.arange(len(own)), sizes)
        for gap in (1, 2):
            again = np.zeros(len(u))
            if len(u) > gap:
                again[gap:] = (u[gap:] == u[:-gap]) & (doc[gap:] == doc[:-gap])
            out[some, -4 + gap] = np.add.reduceat(again, starts) / n[:, 0]
        out[some, -1] = np.log1p(n[:, 0])
    return out


class Network:
    """Input, one hidden layer of tanh units, one logistic output; trained by Adam, then calibrated by a temperature."""

    def __init__(self, hidden: int = 24, seed: int = 1):
        self.hidden, self.seed, self.temperature = hidden, seed, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, l2: float = 1e-4) -> Network:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        held = order[: len(x) // 5]
        rest = order[len(x) // 5 :]
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        best, kept = np.inf, [w.copy() for w in self.w]
        for _ in range(epochs):
            rng.shuffle(rest)
            for at in range(0, len(rest), 128):
                b = rest[at : at + 128]
                h = np.tanh(x[b] @ self.w[0] + self.w[1])
                miss = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y[b]) / len(b)
                back = np.outer(miss, self.w[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((x[b].T @ back + l2 * self.w[0], back.sum(0), h.T @ miss + l2 * self.w[2], miss.sum(keepdims=True))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(x[held], y[held], 1.0) if len(held) else 0.0
            if loss <= best:
                best, kept = loss, [w.copy() for w in self.w]
        self.w = kept
        if len(held):
            self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: self._loss(x[held], y[held], t))
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def _loss(self, x: np.ndarray, y: np.ndarray, temperature: float) -> float:
        z = np.clip(self._logit(x) / temperature, -30, 30)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, Network | float]:
    """Word vectors of all documents' texts and a network of at most ``MAX_LABELLED`` labelled ones that are not held out; if
    all labels are of one kind, their share in place of a network (none: one half)."""
    vectors = word_vectors(context_vectors(docs))
    wanted = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            for own, first in _chunks(batch.column(0).to_pylist(), units):
                rows = list(pooled(own, vectors))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), batch.column(1).slice(first, len(rows))], names=["x", "label"])

    # At most MAX_LABELLED ids are sent to the executors, rather than all texts to each other, and as many rows come back.
    rows = one_text_an_id(docs, wanted).select("text", "label").mapInArrow(describe, "x array<float>, label double").collect()
    # Their order decides the split and the batches.
    rows.sort(key=lambda r: (r.x, r.label))
    y = np.array([r.label for r in rows])
    if len(set(y)) < 2:
        return vectors, float(y[0]) if len(y) else 0.5
    return vectors, Network().fit(np.array([r.x for r in rows], float), y)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores every whole text with the probability that its quality label is 1.

    Word vectors come from all documents; the network is fitted on a bounded sample of labelled documents with
    crc32(doc_id as text) mod 5 other than 0. Null or empty text: the score of zero vectors. Very long text: whole. A label given twice:
    the larger; an id that several rows have: learned from one of them. No labels, or labels of one kind: their share as every score. Repeated rows: scored alike. Empty table: no rows. Extra columns
    are ignored. Returns doc_id, held_out, score, predicted (1 from ``threshold`` on).
    """
    score = scorer(*train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            scores = score(batch.column(2).to_pylist(), units)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scorer(vectors: np.ndarray, network: Network | float):
    """Texts to probabilities."""

    def score(texts: list[str | None], units: Units) -> np.ndarray:
        out = np.zeros(len(texts))
        for own, first in _chunks(texts, units):
            x = pooled(own, vectors)
            out[first : first + len(own)] = network(x) if isinstance(network, Network) else network
        return out

    return score


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns; see ``score_quality``.

    Null and empty texts: judged by the score of zero vectors, all alike. Null doc_id: judged by its text, never learned from. Repeated rows and ties: judged
    alike, all stay or all go. Very long texts: whole. No labels, or labels of one kind: that share is every score, so all stay or all go. Empty table: no
    rows. Columns of any names are kept as they are."""
    score = scorer(*train(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(place).to_pylist(), units) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
