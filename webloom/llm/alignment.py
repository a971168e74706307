"""Cross-tokenizer alignment: two tokenizers cut the same bytes, and every pair of overlapping tokens is a link. Pairs are dealt to stripes of B ids,
``np.add.at`` counts them in a dense matrix a stripe, row maxima give each B id's best partner, and links are scored where their stripe is."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, groupby, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import light_slices, materialise, small_batches, table, trim

#: Text of a block of documents, whose distinct words and id pairs are listed once. It bounds what a task holds.
BLOCK_BYTES = 8_000_000
#: B ids of a stripe. A dense block has this many rows and a column for each A id, 8 bytes a cell.
STRIPE = 64
#: Cells that one task counts or scores before a stripe is dealt to more of them.
CELLS = 2**25
#: Words whose encoding a worker remembers, in two halves of so many, and the longest of them; it forgets the half not met of late when there are more.
MEMO, MEMO_CHARS = 150_000, 64
#: Words that go to the tokenizers as one text.
RUN = 64
#: What no cut may stand beside: white space by any definition in use, and the sign that stands for a space.
SPACES = "\\s\u180e\u2581"
ODD = re.compile("[\u180e\u2581%s]" % "".join(c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n"))
SAFE_SPACE = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 letters are themselves, the rest follow from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def unsafe(text: str) -> bool:
    """Whether a text has two of SPACES in a row, one at an end, or one that is neither a space nor a line end."""
    return text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD.search(text) is not None


class Aligned(NamedTuple):
    """A stretch of text that both tokenizers cut off: counts, its groups as text and its links as codes ``B id * width + A id``, 8 bytes each.
    ``fits`` is false where bytes are lost."""

    fits: bool
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    links: bytes = b""


def places(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of the same bytes, by where each ends: where both sides end together, which cuts them into groups, the A and the B tokens up to
    each such end, and for every stretch between two ends of either side the one A and the one B token that overlap there."""
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    ends = np.union1d(a_ends, b_ends)
    return shared, np.searchsorted(a_ends, shared) + 1, np.searchsorted(b_ends, shared) + 1, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def groups_and_links(a_ids: list[int], a_ends: np.ndarray, b_ids: list[int], b_ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """``places`` with the groups as text: them, where they end, and the overlapping tokens as places in ``a_ids`` and ``b_ids``."""
    shared, a_cuts, b_cuts, of_a, of_b = places(a_ends, b_ends)
    a_text, b_text = list(map(str, a_ids)), list(map(str, b_ids))
    groups = [f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip([0, *a_cuts], a_cuts, [0, *b_cuts], b_cuts, strict=False)]
    return groups, shared, of_a, of_b


class Aligner:
    """Aligned words by key: a word stands for itself with a space before it, a word that begins with a line end for just that, a tuple of one
    for a stretch with a space before it that is never cut."""

    def __init__(self, a_path: str, b_path: str):
        # Spark's tasks are the parallelism; the library's own threads would only add memory and waiting.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        letters = byte_alphabet()
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.a.get_vocab()
        self.width = max(vocabulary.values()) + 1
        self.a_bytes = [b""] * self.width
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters.get(c, 63) for c in t)
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: Each id as text with what can follow it in a group, and how long that is: a comma, or the sign for the end of a side.
        ids = range(max(self.width, len(pieces)))
        self.texts = np.array([f"{i}{sign}" for i in ids for sign in ",|;"], object)
        self.text_sizes = np.array([len(t) for t in self.texts], np.int64)
        #: Words met since half of the memo was last dropped, and those met before and not since.
        self.young: dict[str | tuple[str], Aligned] = {}
        self.old: dict[str | tuple[str], Aligned] = {}

    def together(self, a_ids: np.ndarray, b_ids: np.ndarray, ends: np.ndarray) -> list[Aligned]:
        """Words aligned by one pass over all of their tokens, whose bytes are theirs; ``ends`` has where each word ends, as a token of either side does."""
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        shared, a_cuts, b_cuts, of_a, of_b = places(a_ends, b_ends)
        codes = b_ids[of_b] * self.width + a_ids[of_a]
        # The groups' text: a group's A tokens, then its B tokens, each with the sign after it.
        n_a, n_b = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
        a_signs, b_signs = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        a_signs[a_cuts - 1], b_signs[b_cuts - 1] = 1, 2
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + np.repeat(b_cuts - n_b, n_a)] = 3 * a_ids + a_signs
        order[np.arange(len(b_ids)) + np.repeat(a_cuts, n_b)] = 3 * b_ids + b_signs
        text, text_ends = "".join(self.texts[order].tolist()), np.cumsum(self.text_sizes[order])
        # A link lies where the nearer of its tokens' ends is.
        link_cuts = (8 * (np.searchsorted(np.minimum(a_ends[of_a], b_ends[of_b]), ends) + 1)).tolist()
        group_cuts, a_words, b_words = (np.searchsorted(v, ends) + 1 for v in (shared, a_ends, b_ends))
        text_cuts, codes = text_ends[a_words + b_words - 1].tolist(), codes.tobytes()
        counts = (np.diff(v, prepend=0).tolist() for v in (a_words, b_words, group_cuts))
        return [
            Aligned(True, x, y, g, text[t0 : t1 - 1], codes[c0:c1])
            for x, y, g, t0, t1, c0, c1 in zip(*counts, [0, *text_cuts], text_cuts, [0, *link_cuts], link_cuts, strict=False)
        ]

    def encode(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sides' ids of each run of text, which has the space that A gets before it unless it begins with a line end."""
        a = [x.ids for x in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        # B puts a space before all it gets; a line end never merges with it.
        b = self.b.encode([r if r[0] == "\n" else r[1:] for r in runs], num_threads=1)
        return a, [x[1:] if r[0] == "\n" else x for x, r in zip(b, runs, strict=True)]

    def align(self, words: list[str], many: int) -> list[Aligned]:
        """Words with the space before them, or their line end, encoded ``many`` at a time, as they would stand in a text; where bytes are lost, one by one."""
        parts = [words[k : k + many] for k in range(0, len(words), many)]
        runs = ["".join(p) for p in parts]
        a, b = self.encode(runs)
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        raw = "".join(runs).encode()
        fits = [True] * len(runs)
        if not b"".join(map(of_a, chain.from_iterable(a))) == raw == b"".join(map(of_b, chain.from_iterable(b))):
            fits = [b"".join(map(of_a, x)) == r.encode() == b"".join(map(of_b, y)) for x, y, r in zip(a, b, runs, strict=True)]
        good = [p for p, f in zip(parts, fits, strict=True) if f]
        ids = [np.fromiter(chain.from_iterable(x for x, f in zip(side, fits, strict=True) if f), np.int64) for side in (a, b)]
        sizes = [len(w) if w.isascii() else len(w.encode()) for p in good for w in p]
        made = iter(self.together(*ids, np.cumsum(sizes)) if good else ())
        lost = [w for p, f in zip(parts, fits, strict=True) if not f for w in p]
        singly = iter(self.align(lost, 1) if lost and many > 1 else [Aligned(False)] * len(lost))
        return list(chain.from_iterable(islice(made if f else singly, len(p)) for p, f in zip(parts, fits, strict=True)))

    def look_up(self, keys: list[str | tuple[str]]) -> list[Aligned]:
        """The words of ``keys``, which are there once each, from the memo or encoded together."""
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        known, missing = [], []
        for k in keys:
            if (word := young.get(k)) is None:
                if (word := old.get(k)) is None:
                    missing.append(k)
                else:
                    young[k] = word
            known.append(word)
        plain = [k for k in missing if type(k) is str]
        stretches = [k for k in missing if type(k) is tuple]
        plain_made = self.align([k if k[0] == "\n" else " " + k for k in plain], RUN)
        made = [(plain, plain_made), (stretches, self.align([" " + k[0] for k in stretches], 1))]
        for new, words in made:
            young.update((k, w) for k, w in zip(new, words, strict=True) if len(k if type(k) is str else k[0]) <= MEMO_CHARS)
        of_plain, of_stretches = (iter(words) for _, words in made)
        return [w if w is not None else next(of_plain if type(k) is str else of_stretches) for k, w in zip(keys, known, strict=True)]

    @staticmethod
    def keys(text: str) -> list[str | tuple[str]]:
        """The words of a text that is not empty. Both tokenizers cut before a single space or line end between other characters."""
        if unsafe(text):
            return [(part,) for part in SAFE_SPACE.split(text)]
        return text.replace("\n", " \n").split(" ")


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def forget() -> None:
    """Ends a worker's use of the tokenizers and of the words it remembers: once all texts are encoded, they only take room from what comes next."""
    if aligner.cache_info().currsize:
        aligner.cache_clear()
        trim()


ENCODED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, "
    "link_slots binary, links_each binary, stripe int, first long, n_cells long, cells binary, counts binary"
)
NAMES = [part.split()[0] for part in ENCODED.split(", ")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
ARROW = {part.split()[0]: TYPES[part.split()[1]] for part in ENCODED.split(", ")}


class _Numbers(dict):
    """A number for each key, in the order they come."""

    def __missing__(self, key: str | tuple[str]) -> int:
        at = self[key] = len(self)
        return at


class _Block:
    """Documents of one block: their words by number, and what has to be known of each word and each pair of ids."""

    def __init__(self, made: Aligner):
        self.made, self.number = made, _Numbers()
        self.known: list[Aligned] = []
        self.docs: list = []
        self.words: list[np.ndarray] = []
        self.bytes = 0

    def add(self, docs: list[int | None], texts: list[str | None]) -> None:
        look = self.number.__getitem__
        for text in texts:
            self.words.append(np.fromiter(map(look, self.made.keys(text)), np.int32) if text else np.zeros(0, np.int32))
            self.bytes += len(text or "") + 64
        self.docs += docs
        self.known += self.made.look_up(list(islice(self.number, len(self.known), None)))

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """Document rows, one row of the words' links, and a row of pairs with their counts for every stripe."""
        width, known = self.made.width, self.known
        fits = np.array([w.fits for w in known], bool)
        self.words = [w if fits[w].all() else w[:0] for w in self.words]
        each = np.array([len(w.links) // 8 for w in known], np.int64)
        figures = {"n_a": np.array([w.n_a for w in known]), "n_b": np.array([w.n_b for w in known]), "n_groups": np.array([w.n_groups for w in known]), "n_links": each}
        texts = [w.groups for w in known]
        for first in range(0, len(self.docs), 500):
            words = self.words[first : first + 500]
            sums = {c: [int(v[w].sum()) for w in words] for c, v in figures.items()}
            hashed = [hashlib.sha256(";".join(map(texts.__getitem__, w.tolist())).encode()).hexdigest() if len(w) else "" for w in words]
            yield _batch(len(words), block=[block] * len(words), doc_id=self.docs[first : first + 500], groups_sha256=hashed, words=[w.tobytes() for w in words], **sums)
        used = np.bincount(np.concatenate(self.words), minlength=len(known)) if known else np.zeros(0, np.int64)
        pairs, slots = np.unique(np.frombuffer(b"".join([w.links for w in known]), np.int64), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, slots, np.repeat(used, each))
        yield _batch(1, block=[block], link_slots=[slots.astype(np.int32).tobytes()], links_each=[each.astype(np.int32).tobytes()])
        stripe, cells = np.divmod(pairs, STRIPE * width)
        starts = np.flatnonzero(np.r_[True, stripe[1:] != stripe[:-1]])
        parts = [slice(a, z) for a, z in zip(starts, [*starts[1:], len(pairs)], strict=True)] if len(pairs) else []
        for first in range(0, len(parts), 100):
            some = parts[first : first + 100]
            yield _batch(
                len(some), block=[block] * len(some), stripe=[int(stripe[p.start]) for p in some], first=[int(p.start) for p in some], n_cells=[int(p.stop - p.start) for p in some],
                cells=[cells[p].astype(np.int32).tobytes() for p in some], counts=[counts[p].tobytes() for p in some],
            )


def _batch(rows: int, **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], ARROW[c]) if c in columns else pa.nulls(rows, ARROW[c]) for c in NAMES], names=NAMES)


def encode(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every document and, a block of documents at a time, what their words link; see ``_Block.rows``. Block numbers are unique in one run only, so write it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(a_path, b_path)
        at, block = TaskContext.get().partitionId() << 32, _Block(made)
        for batch in (part for whole in batches for part in light_slices(whole, 1)):
            block.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if block.bytes > BLOCK_BYTES:
                yield from block.rows(at)
                at, block = at + 1, _Block(made)
        if block.docs:
            yield from block.rows(at)
        del block
        trim()

    return small_batches(docs, size=1 << 22).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def _by_stripe(rows: DataFrame, keys: list[str], order: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(key values, rows of that key as a stream of lists)`` for every key, one after the other in its task. ``run`` makes tuples of ``schema``."""
    columns = [part.split() for part in schema.split(", ")]
    at = [rows.columns.index(k) for k in keys]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        stream = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for key, group in groupby(stream, key=lambda r: tuple(r[i] for i in at)):
            for made in run(key, group):
                yield pa.RecordBatch.from_arrays([pa.array([v], TYPES[t]) for v, (_, t) in zip(made, columns, strict=True)], names=[c for c, _ in columns])

    return small_batches(rows, 64, 1 << 22).repartition(*keys).sortWithinPartitions(*order).mapInArrow(over, schema)


@lru_cache(maxsize=1)
def dense_block(width: int) -> np.ndarray:
    """The worker's matrix of a stripe, flat and all zeros; who uses it leaves it so."""
    return np.zeros(STRIPE * width, np.int64)


def count_pairs(cells: DataFrame, width: int) -> DataFrame:
    """Totals of all blocks' cells (stripe, slice, cells, counts), added up in a dense block a stripe: (stripe, cells, counts, best), where ``best`` has the
    greatest count of each row of the stripe. A stripe's rows may be dealt to slices, which are counted apart and then together."""

    def add(group, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells that the rows use, and their sums. The block is left empty for the next stripe of the task."""
        block, used = dense_block(width), np.zeros(0, np.int32)
        for row in group:
            of = np.frombuffer(row[at], np.int32)
            np.add.at(block, of, np.frombuffer(row[at + 1], np.int64))
            used = np.union1d(used, of)
        sums = block[used]
        block[used] = 0
        return used, sums

    def part(key, group):
        used, sums = add(group, 2)
        yield key[0], used.tobytes(), sums.tobytes()

    def whole(key, group):
        used, sums = add(group, 1)
        best = np.zeros(STRIPE, np.int64)
        np.maximum.at(best, used // width, sums)
        yield key[0], used.tobytes(), sums.tobytes(), best.tobytes()

    parts = _by_stripe(cells.select("stripe", "slice", "cells", "counts"), ["stripe", "slice"], ["stripe", "slice"], part, "stripe int, cells binary, counts binary")
    return _by_stripe(parts, ["stripe"], ["stripe"], whole, "stripe int, cells binary, counts binary, best binary")


def score_cells(cells: DataFrame, totals: DataFrame, slices: int, width: int) -> DataFrame:
    """The corpus-wide count of every cell of every block, and whether it is its row's greatest: (block, first, counts, best). Totals go to
    each slice of their stripe, come first there and fill the dense block in which the rest is looked up."""

    def look(key, group):
        block, used, best = dense_block(width), np.zeros(0, np.int32), np.zeros(STRIPE, np.int64)
        try:
            for _, _, of, first, at, counts, most in group:
                at = np.frombuffer(at, np.int32)
                if of is None:
                    used, best = at, np.frombuffer(most, np.int64)
                    block[used] = np.frombuffer(counts, np.int64)
                else:
                    yield of, first, block[at].tobytes(), (block[at] == best[at // width]).tobytes()
        finally:
            block[used] = 0

    sent = totals.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("first"), "cells", "counts", "best")
    both = sent.union(cells.select("stripe", "slice", "block", "first", "cells", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    return _by_stripe(both, ["stripe", "slice"], ["stripe", "slice", F.col("block").asc_nulls_first()], look, "block long, first long, counts binary, best binary")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How two tokenizers cut each whole text, and how common its links are in the corpus.

    A (byte level) gets a space and the text, B (which adds that space) the text. Texts are encoded in blocks of BLOCK_BYTES; a block lists its
    words once, and the id pairs they link with counts, so that a pair of a block is shuffled once however often it occurs. Memory: a block of texts,
    and a dense block of STRIPE rows. A stripe with more than CELLS cells is dealt to several tasks.
    Null and empty text, and texts that one tokenizer does not give back byte for byte: zeros and ''. Very long text: a block of its own. Null doc_id, ties and repeated
    rows: a row each, which counts each time. Empty table: no rows. Extra columns are ignored.
    Returns a row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    """
    width = aligner(a_path, b_path).width
    encoded = materialise(encode(docs, a_path, b_path))
    cells = encoded.where("stripe IS NOT NULL")
    most = cells.groupBy("stripe").agg(F.sum("n_cells").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = 1 + most // CELLS
    cells = cells.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))
    scored = score_cells(cells, materialise(count_pairs(cells, width)), slices, width)
    sides = encoded.where("link_slots IS NOT NULL").select("block", "link_slots", "links_each", *[F.lit(None).cast(t).alias(c) for c, t in (("first", "long"), ("counts", "binary"), ("best", "binary"))])
    sides = sides.unionByName(scored, allowMissingColumns=True)
    figures = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        forget()
        dense_block.cache_clear()
        parts = sorted((r["first"], r["counts"], r["best"]) for r in right.to_pylist() if r["first"] is not None)
        words = next((r for r in right.to_pylist() if r["link_slots"] is not None), None)
        sums, bests = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        if parts:
            counts = np.concatenate([np.frombuffer(c, np.int64) for _, c, _ in parts])
            best = np.concatenate([np.frombuffer(b, bool) for _, _, b in parts])
            slots, each = np.frombuffer(words["link_slots"], np.int32), np.frombuffer(words["links_each"], np.int32)
            ends = np.r_[0, np.cumsum(each)]
            sum_of = np.diff(np.r_[0, np.cumsum(counts[slots])][ends])
            best_of = np.diff(np.r_[0, np.cumsum(best[slots], dtype=np.int64)][ends])
            for k, own in enumerate(left.column("words").to_pylist()):
                own = np.frombuffer(own, np.int32)
                sums[k], bests[k] = sum_of[own].sum(), best_of[own].sum()
        out = left.select(figures)
        return out.append_column("n_best", pa.array(bests)).append_column("count_sum", pa.array(sums))

    texts = encoded.where("words IS NOT NULL").select("block", "words", *figures)
    done = texts.groupBy("block").cogroup(sides.groupBy("block")).applyInArrow(
        score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between the byte-level and the piece tokenizer."""
    return align(table(spark, sf_dir, "documents"), *default_tokenizers())
