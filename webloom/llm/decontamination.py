"""Benchmark decontamination by spaced-seed hashing: fixed masks leave token positions out of a window's hash, so that a
substitution there does not hide a match; hashes of benchmark and documents are joined, overlaps are verified around the hits."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import materialise, salted_join, small_batches, table

#: An overlap is a window of SPAN tokens (an item with fewer: all of its own) of which this share is equal, place by place.
SPAN, MIN_EQUAL = 12, 0.75
#: Items of fewer tokens are never sought: three or four words in a row are found by chance in any large corpus.
MIN_ITEM = 5
#: So many blocks of a window have to be equal for a seed; the window is parted into that many and one more for each substitution it may have.
WHOLE = 3
#: The filter of seeds has 2 ** 13 to 2 ** BLOOM bits (128 MB): what is broadcast is bounded whatever the benchmark; a full one passes more windows on.
BLOOM = 30
#: Tokens hashed at once, and word hashes remembered by a worker.
CHUNK, MEMO = 2**16, 500_000

_FACTORS = (np.random.default_rng(11).integers(1, 2**63, 64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TO_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_WINDOW = "doc_id long, text_hash long, place long, span int, w long, tokens array<long>, seeds array<long>"


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_TO_BLANK).split()


def needed(span: int) -> int:
    """How many tokens of a window have to be equal."""
    return math.ceil(MIN_EQUAL * span)


@lru_cache
def blocks_of(span: int) -> list[range]:
    """A window's parts. As many substitutions as it may have leave WHOLE of them untouched."""
    n = span - needed(span) + WHOLE
    return [range(span * b // n, span * (b + 1) // n) for b in range(n)]


@lru_cache
def masks_of(span: int) -> list[tuple[int, ...]]:
    """Every choice of WHOLE blocks: the masks, as numbers of blocks. Together they miss no window with enough equal tokens."""
    return list(combinations(range(len(blocks_of(span))), WHOLE))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


def hashed(words: list[bytes], memo: _Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def seeds_of(tokens: np.ndarray, span: int, starts: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Per mask the hashes of the windows of ``span`` tokens that begin at ``starts`` (None: of all)."""
    n = max(0, len(tokens) - span + 1)
    if not (n if starts is None else len(starts)):
        return
    parts = []
    for block in blocks_of(span):
        part = np.zeros(n if starts is None else len(starts), np.uint64)
        for k in block:
            part += (tokens[k : k + n] if starts is None else tokens[starts + k]) * _FACTORS[k]
        parts.append(part)
    for number, mask in enumerate(masks_of(span)):
        out = parts[mask[0]] + np.uint64((span << 16 | number) * 0x9E3779B1)
        for b in mask[1:]:
            out += parts[b]
        yield out * _MIX


def run_of(span: int) -> int:
    """So many tokens in a row are equal in any window with enough equal ones: the others part them into one run more than there are of them."""
    return math.ceil(needed(span) / (span - needed(span) + 1))


def grams_of(tokens: np.ndarray, span: int) -> np.ndarray:
    """The hashes of all runs of ``run_of`` tokens, told apart by span."""
    n = max(0, len(tokens) - run_of(span) + 1)
    out = np.full(n, (span << 32) * 0x9E3779B1 % 2**64, np.uint64)
    for k in range(run_of(span) if n else 0):
        out += tokens[k : k + n] * _FACTORS[k + 16]
    return out * _MIX


def likely(tokens: np.ndarray, span: int, bits: int, filled: np.ndarray) -> np.ndarray:
    """The windows that hold a run which the filter knows: all that can have enough equal tokens, and far fewer than all."""
    n, reach = max(0, len(tokens) - span + 1), span - run_of(span)
    change = np.zeros(len(tokens) + 2, np.int64)
    at = _found(bits, filled, grams_of(tokens, span))
    np.add.at(change, np.maximum(at - reach, 0), 1)
    np.add.at(change, at + 1, -1)
    return np.flatnonzero(np.cumsum(change)[:n] > 0)


def whole_of(tokens: np.ndarray, span: int, starts: np.ndarray) -> np.ndarray:
    """The hashes of the windows that begin at ``starts``, no token left out."""
    out = np.full(len(starts), span, np.uint64)
    for k in range(span if len(starts) else 0):
        out += tokens[starts + k] * _FACTORS[k + 32]
    return out * _MIX


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix of unsigned values as rows of longs."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1])), pa.int32()), pa.array(rows.ravel().view(np.int64)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Every window of every item: item_id, at, span, w (a hash of the tokens), tokens, seeds and grams (the window's runs)."""
    names = ["item_id", "at", "span", "w", "tokens", "seeds", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = hashed(tokens_of(text), memo)
                span = min(SPAN, len(tokens))
                if span < MIN_ITEM:
                    continue
                n = len(tokens) - span + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.full(n, span, np.int32)), pa.array(whole_of(tokens, span, np.arange(n)).view(np.int64)),
                        _lists(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(tokens, span))), _lists(np.stack(list(seeds_of(tokens, span)), axis=1)),
                        _lists(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(grams_of(tokens, span), span - run_of(span) + 1))),
                    ],
                    names=names,
                )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.mapInArrow(run, "item_id long, at long, span int, w long, tokens array<long>, seeds array<long>, grams array<long>")


def _probes(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return seeds >> shift, (seeds * _FACTORS[63]) >> shift


def seed_filter(windows: DataFrame) -> np.ndarray:
    """A Bloom filter of all seeds and of the runs of tokens, eight bits a byte. The driver sees the filter's filled words only, never the seeds."""
    seeds = windows.select(F.explode(F.concat("seeds", "grams")).alias("s"))
    n = seeds.count()
    bits = min(BLOOM, max(13, math.ceil(math.log2(n + 1)) + 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_probes(batch.column(0).to_numpy().view(np.uint64), bits)))
            byte, first = np.unique(at >> np.uint64(3), return_index=True)
            value = np.add.reduceat(np.uint64(1) << (at & np.uint64(7)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(byte.view(np.int64)), pa.array(value.astype(np.int32))], names=["byte", "value"])

    filled = seeds.mapInArrow(run, "byte long, value int").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(1 << bits - 3, np.uint8)
    out[filled.column(0).to_numpy()] = filled.column(1).to_numpy()
    return out


def _found(bits: int, filled: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Places of the seeds that the filter knows."""
    one, two = _probes(seeds, bits)
    at = np.flatnonzero(filled[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1)
    two = two[at]
    return at[(filled[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1) > 0]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(place of the first text, words of some texts): together about CHUNK words, or one longer text."""
    first, words, n = 0, [], 0
    for k, text in enumerate(texts):
        words.append(tokens_of(text))
        n += len(words[-1])
        if n >= CHUNK or k == len(texts) - 1:
            yield first, words
            first, words, n = k + 1, [], 0


def document_windows(docs: DataFrame, spans: list[int], filled: np.ndarray) -> DataFrame:
    """The windows of all documents that have a seed which the filter knows, with those seeds: one pass over the texts, no shuffle."""
    spark, bits = docs.sparkSession, len(filled).bit_length() + 2
    shared = spark.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = _Hashes(), shared.value
        for batch in batches:
            for first, words in _groups(batch.column(2).to_pylist()):
                flat = hashed([w for own in words for w in own], memo)
                ends = np.cumsum([len(own) for own in words])
                for span in spans:
                    for low in range(0, len(flat), CHUNK):
                        part = flat[low : low + CHUNK + span - 1]
                        places, seeds, starts = [], [], likely(part, span, bits, known)
                        for s in seeds_of(part, span, starts):
                            at = _found(bits, known, s)
                            places.append(starts[at])
                            seeds.append(s[at])
                        if not sum(map(len, places)):
                            continue
                        places, seeds = np.concatenate(places), np.concatenate(seeds)
                        text = np.searchsorted(ends, places + low, "right")
                        inside = places + low + span <= ends[text]
                        places, seeds = places[inside], seeds[inside]
                        order = np.argsort(places, kind="stable")
                        at, begin = np.unique(places[order], return_index=True)
                        if not len(at):
                            continue
                        text = np.searchsorted(ends, at + low, "right")
                        rows = pa.array(first + text)
                        start = at + low - np.concatenate([[0], ends])[text]
                        windows = np.lib.stride_tricks.sliding_window_view(part, span)[at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int64)), pa.array(np.full(len(at), span, np.int32)),
                                pa.array(whole_of(part, span, at).view(np.int64)), _lists(windows),
                                pa.ListArray.from_arrays(pa.array(np.append(begin, len(seeds)), pa.int32()), pa.array(seeds[order].view(np.int64))),
                            ],
                            names=["doc_id", "text_hash", "place", "span", "w", "tokens", "seeds"],
                        )

    return small_batches(docs).select(*_document_key(), "text").mapInArrow(run, _WINDOW)


def _document_key() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def _matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of documents (doc_id, text_hash, place, span, w), pairs of windows that overlap (span, w, of, equal: the equal places) and the benchmark's
    windows (item_id, at, of). Windows of the same tokens are one in the join, however many documents and items hold them."""
    own = materialise(benchmark_windows(benchmark))
    spans = sorted(r.span for r in own.select("span").distinct().collect())
    hits = materialise(document_windows(docs, spans, seed_filter(own)))
    distinct = lambda rows: rows.groupBy("span", "w").agg(F.first("tokens").alias("tokens"), F.first("seeds").alias("seeds"))
    tests = distinct(own).select("span", F.col("w").alias("of"), F.col("tokens").alias("test"), "seeds")
    texts = materialise(distinct(hits))
    sought = texts.select("span", "w", F.explode("seeds").alias("seed"))
    live = tests.select("of", F.explode("seeds").alias("seed")).join(sought.select("seed").distinct(), "seed", "left_semi")
    pairs = salted_join(sought, live, ["seed"]).select("span", "w", "of").distinct()
    same = F.filter(F.sequence(F.lit(0), F.col("span") - 1), lambda k: F.get("tokens", k) == F.get("test", k))
    verified = pairs.join(texts.select("span", "w", "tokens"), ["span", "w"]).join(tests.select("of", "test"), "of").withColumn("equal", same)
    least = F.ceil(F.col("span") * F.lit(MIN_EQUAL))
    matches = materialise(verified.where(F.size("equal") >= least).select("span", "w", "of", "equal"))
    return hits.drop("tokens", "seeds"), matches, own.select("item_id", "at", F.col("w").alias("of"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document and benchmark item with an overlap: a window of SPAN tokens of both, in which MIN_EQUAL of the tokens are equal, place by place (an
    item of MIN_ITEM to SPAN - 1 tokens: all of it). The rule is met without loss: every such window has WHOLE blocks untouched, and a mask for them.

    One pass over the documents, whatever the benchmark's size; only windows that share a seed with it go on, and equal windows are one until they are
    verified, so copies and frequent passages are no skew. One row a document and item, with the overlap of most equal tokens: of the windows on one
    diagonal the first to the last equal token. Null or empty text: no leak. Null item text, or one under MIN_ITEM tokens: never found. Null doc_id or
    item_id: like any other value. Repeated items: once. Repeated documents: a row each. Very long texts: whole. Empty tables: no rows.
    Extra columns are ignored. Returns doc_id, item_id, start (in tokens), length, equal_tokens.
    """
    hits, matches, items = _matches(docs, benchmark)
    overlaps = salted_join(hits, matches, ["span", "w"]).join(items, "of").select(
        "doc_id", "text_hash", "item_id", "place", (F.col("place") - F.col("at")).alias("shift"), F.transform("equal", lambda k: F.col("place") + k).alias("equal")
    )
    told = overlaps.groupBy("doc_id", "text_hash", "item_id", "shift").agg(
        F.array_distinct(F.flatten(F.collect_list("equal"))).alias("equal"), (F.count("*") / F.count_distinct("place")).cast("int").alias("rows")
    )
    facts = F.struct(F.size("equal").alias("equal_tokens"), (-F.array_min("equal")).alias("before"), (F.array_max("equal") - F.array_min("equal") + 1).alias("length"), "rows")
    best = told.groupBy("doc_id", "text_hash", "item_id").agg(F.max(facts).alias("b"))
    return best.select(
        "doc_id", "item_id", (-F.col("b.before")).alias("start"), "b.length", F.col("b.equal_tokens").cast("long").alias("equal_tokens"), F.explode(F.sequence(F.lit(1), "b.rows")).alias("row")
    ).drop("row")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no benchmark item, by the rule of ``find_leaks``, with all their columns.

    Null and empty texts stay. Null doc_id: judged by the text. Repeated rows and copies: judged alike, all stay or all go. Very long texts: whole. Empty
    tables: all documents stay. Columns of any names are kept as they are."""
    hits, matches, _ = _matches(docs, benchmark)
    leaking = materialise(hits.join(matches, ["span", "w"], "left_semi").select(F.col("text_hash").alias("__leaking")).distinct())
    return docs.join(leaking, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == leaking["__leaking"], "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold passages of the benchmark, with the items: one row a leak."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
