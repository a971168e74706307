"""Packing by minimum bin slack: a subset-sum dynamic programme on bitsets picks the multiset of remaining
lengths that fills a window closest to its capacity; each choice is repeated as often as its lengths last."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import materialise, small_batches, table

#: Word beginnings, and whole words, whose ids a worker remembers; it forgets all of a kind when there are more.
BODIES, MEMO = 500_000, 200_000
#: These characters part words for Python but not for the tokenizer's white-space rule.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Signs that may follow a word. The tokenizer never merges across the border between letters and these; an apostrophe is not
#: among them, as some words go with it.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Bodies(dict):
    """Ids of pieces that the tokenizer takes as they are."""

    def __init__(self, path: str):
        # Spark's tasks are the parallelism; the library's own threads would only add memory and waiting.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.encode = t.encode
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        #: What all added tokens begin with, as far as it has no letters; texts with it go through the tokenizer whole. None: no added tokens.
        self.mark = re.match(r"[\W_]*", os.path.commonprefix(special))[0] if special else None

    def of(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, text: str) -> bytes:
        if len(self) > BODIES:
            self.clear()
        ids = self[text] = self.of(text)
        return ids


class _Words(dict):
    """Ids of words, put together from a body of letters and the signs after it."""

    def __init__(self, bodies: _Bodies):
        self.bodies = bodies

    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(SIGNS)
        # In the tokenizer's normal form a letter may end in a mark, which goes with the signs behind it.
        if body is not word and body.isalpha() and (body[-1] <= "ÿ" or unicodedata.normalize("NFC", body).lower()[-1].isalpha()):
            ids = self.bodies[body] + self.bodies[word[len(body) :]]
        else:
            ids = self.bodies[word]
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(_Bodies(path))


class WordEncoder:
    """Ids of texts as unsigned 32-bit bytes, those that the tokenizer gives without added end or start ids, word by word from a memo. Needs a
    tokenizer that lowers case, drops white space and never merges across it, so that a text's ids are its words' ids in a row. Texts
    that may hold one of its added tokens, which it finds before all else, go through it whole."""

    def __init__(self, path: str):
        self.words = _words(path)

    @staticmethod
    def _lower(text: str) -> str:
        """Lower case where it cannot interfere with the tokenizer's normal form: plain Latin letters."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def __call__(self, text: str) -> bytes:
        mark = self.words.bodies.mark
        if NOT_SPACE.search(text) or (mark is not None and mark in text):
            return self.words.bodies.of(text)
        if len(self.words) > MEMO:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, self._lower(text).split()))


def fill_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (how many of each length, how many such windows). Each holds the longest item left and, of all multisets of
    the rest, one that leaves the least slack; all items are used up."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        longest = max(left)
        target = capacity - longest
        mask = (1 << (target + 1)) - 1
        reach, steps = 1, []
        for length in sorted(left, reverse=True):
            have = min(left[length] - (length == longest), target // length)
            size = 1
            while have > 0 and not reach >> target & 1:
                take = min(size, have)
                more = reach | reach << length * take & mask
                if more != reach:
                    steps.append((length, take, reach))
                    reach = more
                have -= take
                size *= 2
            if reach >> target & 1:
                break
        at = reach.bit_length() - 1
        chosen = {longest: 1}
        for length, take, before in reversed(steps):
            if not before >> at & 1:
                chosen[length] = chosen.get(length, 0) + take
                at -= length * take
        times = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((chosen, times))
    return out


def _plan(patterns: list[tuple[dict[int, int], int]], base: int = 0) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, how many a window, first window, first offset) sorted by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    for chosen, times in patterns:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.setdefault(length, []).append((used.get(length, 0), n, base, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        base += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut_pieces(docs: DataFrame, tokenizer_path: str, eos: int, capacity: int) -> DataFrame:
    """Each document's ids and ``eos``, cut at multiples of ``capacity``: doc_id (null: null), start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer_path)
        end = np.array([eos], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                view = memoryview(ids)
                for start in range(0, total, capacity):
                    stop = min(total, start + capacity)
                    for column, value in zip(out, (doc, start, stop - start, zlib.crc32(view[4 * start : 4 * stop]), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows).mapInArrow(cut, ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, tokenizer_path: str, eos: int = 2, capacity: int = 4096) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; see ``cut_pieces`` and ``fill_patterns``.

    Only the count of each length (at most ``capacity`` numbers) reaches the driver, and only the plan made of it goes
    back to the executors. A length that a third of all pieces have is ranked in buckets of rows, never in one task.
    Null or empty text: the end id alone. Null doc_id: packed like any other. Very long text: as many full sequences as it fills and a rest. Repeated rows are
    packed each; equal ones are interchangeable. Empty table: no rows. Extra columns are ignored.
    Returns one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = materialise(
        cut_pieces(docs, tokenizer_path, eos, capacity).withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int")
        )
    )
    tally = materialise(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _plan(fill_patterns(counts, capacity))
    by_bucket = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = tally.select("length", "bucket", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(in_bucket) - 1)
        .join(before, ["length", "bucket"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                of = np.flatnonzero(length == value)
                rows = plan[int(value)]
                row = rows[np.searchsorted(rows[:, 0], rank[of], side="right") - 1]
                step, slot = np.divmod(rank[of] - row[:, 0], row[:, 1])
                sequence[of] = row[:, 2] + step
                offset[of] = row[:, 3] + slot * value
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    return ranked.mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
