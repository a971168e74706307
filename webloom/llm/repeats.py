"""Suffix-array dedup: every passage of a given length that also starts elsewhere goes. Suffixes are compared block by block with a difference cover: blocks of
text at its positions are ranked once, a suffix inside two equal stretches around such a block is settled by their rank however long the tie is, and only the
suffixes at the borders of repeated passages are dealt to buckets and compared there."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import LARGE_ROWS, discard, hot_keys, light_slices, materialise, salted_join, small_batches, table, trim

#: Length of the repeats that go, in bytes.
WINDOW = 200
#: A perfect difference cover. Every number modulo PERIOD is the difference of two of these.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Any window of the text has a gram of this many bytes that is the least of SPREAD neighbours, which finds the regions worth a suffix.
GRAM, SPREAD = 64, 96
#: Positions that are hashed together, and the most windows of a region; longer ones are cut into several that overlap by a window.
CHUNK, PIECE = 1 << 18, 1 << 16
#: Bytes of regions in a pack, whose hashes travel together, and about how many hashes meet in a bucket; a bucket is a range of hashes, and there are LEAST at least.
PACK, BUCKET, LEAST = 1 << 20, 1 << 19, 48
#: A batch of texts or regions on its way to Python: a region has up to PIECE bytes, a thousand of them would fill the memory outside the heap.
light = partial(small_batches, size=1 << 22)
#: Names one text: its hash and its length.
TEXT = ["key", "size"]
#: What hashes are for; each kind has random values of its own for the bytes.
MARK, BLOCK, STRETCH, SUFFIX, SUFFIX_TOO = range(5)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A random odd number's powers up to the n-th, and their inverses, modulo 2 ** 64."""
    factor = int(np.random.default_rng(11).integers(2**61)) * 8 + 5
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, f, np.uint64)]) for f in (factor, pow(factor, -1, 2**64)))


@lru_cache(maxsize=8)
def byte_values(kind: int) -> np.ndarray:
    return np.random.default_rng(kind).integers(2**64, size=256, dtype=np.uint64)


class Rolling:
    """Hashes of any stretches of a few bytes from sums over their beginnings."""

    def __init__(self, data: np.ndarray, kind: int):
        by, self.inverse = powers(max(len(data), CHUNK + 2 * WINDOW))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values(kind)[data] * by[: len(data)], out=self.sums[1:])

    def between(self, first: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        """Hashes of the stretches from ``first`` to ``stop``."""
        h = (self.sums[stop] - self.sums[first]) * self.inverse[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ h >> np.uint64(29)

    def grams(self, length: int) -> np.ndarray:
        return self.between(slice(0, len(self.sums) - length), slice(length, len(self.sums)))


def sliding(values: np.ndarray, width: int, pick: np.ufunc, rest: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, from running ones over blocks of that width."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, rest, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = pick.accumulate(blocks, 1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(flags: np.ndarray) -> np.ndarray:
    """Where flags are set: rows (first, stop)."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).reshape(-1, 2)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column without nulls as one array, and where each value begins, with the end."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of longs without nulls: all values, and for each the row it is in."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def in_row(values: np.ndarray, rows: np.ndarray, known: np.ndarray, known_rows: np.ndarray) -> np.ndarray:
    """Whether each value is among those known in its row."""
    mixed = lambda v, r: v.view(np.uint64) + r.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return np.isin(mixed(values, rows), mixed(known, known_rows))


def chunks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' bytes, the starts of CHUNK windows at a time: where a part begins, its bytes, the row of each, and how many bytes its row goes on."""
    for first in range(0, max(0, len(data) - WINDOW + 1), CHUNK):
        stop = min(len(data), first + CHUNK + WINDOW - 1)
        place = np.arange(first, stop)
        row = np.searchsorted(bounds, place, side="right") - 1
        yield first, data[first:stop], row, bounds[row + 1] - place


def least_grams(data: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and the least of every SPREAD neighbours; 0 for neighbours that are not in one text."""
    grams = Rolling(data, MARK).grams(GRAM)
    least = sliding(grams, SPREAD, np.minimum, 2**64 - 1)
    return grams, np.where(ahead[: len(least)] >= GRAM + SPREAD - 1, least, np.uint64(0))


def marked_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams that are the least around them: row, hash, and how often the row has each. Equal windows have the same ones. What lies in two
    chunks counts twice, which only makes more regions worth a look."""
    rows, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, part, row, ahead in chunks(data, bounds):
        grams, least = least_grams(part, ahead)
        # Each gram's greatest least value: its own if it is the least of some neighbourhood. Beyond both ends there is none.
        beyond = np.zeros(SPREAD - 1, np.uint64)
        at = np.flatnonzero((grams == sliding(np.r_[beyond, least, beyond], SPREAD, np.maximum, 0)) & (grams != 0))
        rows.append(row[at])
        names.append(grams[at].view(np.int64))
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (name[1:] != name[:-1])][: len(row)])
    return row[first], name[first], np.diff(np.r_[first, len(row)])


def regions_of(data: np.ndarray, bounds: np.ndarray, repeated: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The regions all of whose windows have nothing but marked grams that are ``repeated`` (by row): row, where it begins there, and its bytes."""
    inside = WINDOW - GRAM - SPREAD + 2  # neighbourhoods of a window
    for start, part, row, ahead in chunks(data, bounds):
        least = least_grams(part, ahead)[1]
        change = np.r_[0, np.flatnonzero((least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])) + 1]
        known = np.repeat(in_row(least[change].view(np.int64), row[change], repeated, rows) & (least[change] != 0), np.diff(np.r_[change, len(least)]))
        so_far = np.r_[0, np.cumsum(~known)]
        for first, stop in runs_of((so_far[inside:] == so_far[:-inside]) & (ahead[: len(least) + 1 - inside] >= WINDOW)):
            for k in range(int(first), int(stop), PIECE):
                end = min(int(stop), k + PIECE) + WINDOW - 1
                yield int(row[k]), int(start + k - bounds[row[k]]), part[k:end].tobytes()


def cover_blocks(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cover's positions in regions that begin at ``starts``: the region, the rank of the block of ``WINDOW - PERIOD + 1`` bytes there, the rank of the
    stretch that any window with that block among its first PERIOD positions lies in, and that stretch's ends. A rank is a hash: equal for equal bytes."""
    block = WINDOW - PERIOD + 1
    place = np.arange(len(data))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    covered = np.isin(np.arange(PERIOD), COVER)
    at = np.flatnonzero(covered[(starts[row] + place - bounds[row]) % PERIOD] & (bounds[row + 1] - place >= block))
    row = row[at]
    first, stop = np.maximum(at - PERIOD + 1, bounds[row]), np.minimum(at + WINDOW, bounds[row + 1])
    long_enough = stop - first >= WINDOW
    row, at, first, stop = (v[long_enough] for v in (row, at, first, stop))
    return row, Rolling(data, BLOCK).between(at, at + block).view(np.int64), Rolling(data, STRETCH).between(first, stop).view(np.int64), first, stop


def within(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of n window starts those whose window lies in one of the stretches."""
    change = np.bincount(first, minlength=n + 1) - np.bincount(stop - WINDOW + 1, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def ranked(one: np.ndarray, two: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by ``one`` (and ``two``), and in that order which differ from the one before."""
    order = np.argsort(one)
    new = np.diff(one[order], prepend=np.uint64(0)) != 0
    new[:1] = True
    if two is not None and (np.diff(two[order]) != 0)[~new[1:]].any():
        order = np.lexsort((two, one))
        new = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]
    return order, new


MARKS = "key array<long>, size array<long>, n array<int>, name binary, many binary, entries long"
NAMES = "key long, size long, names array<long>"
REGIONS = "key long, size long, start long, body binary"
PACKS = "key array<long>, size array<long>, start array<long>, copies array<long>, length array<long>, body binary, entries long"
STRETCHES = "pack long, name long, stretch long, n long"
SENT = "pack long, bucket int, one binary, two binary, many binary"
ANSWERS = "pack long, bucket int, mask binary"
#: Bucket -1: a pack's own row, which is not sent: settled runs of window starts (rank -1) and windows that ask, with the rank of their hash in the pack.
SUFFIXES = SENT + ", key array<long>, size array<long>, own binary, first binary, stop binary, rank binary"
RUNS = "key long, size long, first int, stop int"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _rows(schema: str, *columns: np.ndarray | list) -> pa.RecordBatch:
    names = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c.cast(KINDS[t]) if isinstance(c, pa.Array) else pa.array(c, KINDS[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _cut(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values' bytes as a binary column whose rows have so many of them."""
    offsets = np.r_[0, np.cumsum(counts)] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _sent(pack: int, buckets: int, one: np.ndarray, two: np.ndarray | None, weight: np.ndarray) -> tuple[np.ndarray, list]:
    """A pack's different hashes, dealt to buckets: the rank of each hash among them, and the columns of SENT. What is there more than once in the pack is marked."""
    order, new = ranked(one, two)
    at = np.flatnonzero(new)
    rank = np.empty(len(one), np.int32)
    rank[order] = np.cumsum(new) - 1
    many = np.add.reduceat(weight[order], at) > 1 if len(at) else np.zeros(0, bool)
    values = one[order[at]]
    bucket, counts = np.unique((values >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24), return_counts=True)
    others = _cut(two[order[at]], counts) if two is not None else [b""] * len(bucket)
    return rank, [np.full(len(bucket), pack), bucket.astype(np.int32), _cut(values, counts), others, _cut(many, counts)]


def _answer(sent: pa.Table) -> pa.Table:
    """Which of a bucket's hashes are there more than once over all packs: a byte each."""
    pack, bucket = (sent.column(k).to_numpy() for k in (0, 1))
    (one, bounds), (two, _), (many, _) = (bytes_of(pa.concat_arrays(sent.column(k).chunks)) for k in (2, 3, 4))
    order, new = ranked(one.view(np.uint64), two.view(np.uint32) if len(two) else None)
    mask = np.empty(len(many), bool)
    mask[order] = (np.add.reduceat(1 + many[order].astype(np.int64), np.flatnonzero(new)) > 1)[np.cumsum(new) - 1]
    return pa.Table.from_batches([_rows(ANSWERS, pack, bucket, _cut(mask, np.diff(bounds) // 8))])


def more_than_once(sent: DataFrame) -> DataFrame:
    """A pack's answers, each a bucket and its mask. A bucket has a hash once a pack at most, so that none is crowded by what is common."""
    return sent.select(*SENT.replace(",", "").split()[::2]).groupBy("bucket").applyInArrow(_answer, ANSWERS).groupBy("pack").agg(F.collect_list(F.struct("bucket", "mask")).alias("answers"))


def buckets_for(table: DataFrame) -> int:
    """How many buckets the hashes of a written table need."""
    return max(LEAST, -(-(table.agg(F.sum("entries")).first()[0] or 0) // BUCKET))


def _masks(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """By row the answers in column ``k``, as flags by the rank of a hash."""
    for answers in batch.column(k):
        parts = sorted((a["bucket"], a["mask"]) for a in answers.as_py() or [])
        yield np.frombuffer(b"".join(m for _, m in parts), bool)


def _parts(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in runs of about a chunk of bytes, with the bytes of column ``texts`` and their bounds."""
    for whole in batches:
        for batch in light_slices(whole, texts, CHUNK):
            yield batch, *bytes_of(batch.column(texts))
    trim()


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for some in light_slices(whole, 2, 4 * PACK):
            counts, names, many = [], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for batch in light_slices(some, 2, CHUNK):
                row, name, n = marked_grams(*bytes_of(batch.column(2)))
                counts.append(np.bincount(row, minlength=len(batch)))
                names.append(name)
                many.append(n > 1)
            name = np.concatenate(names)
            key, size = (some.column(k).to_numpy() for k in (0, 1))
            yield _rows(MARKS, [key], [size], [np.concatenate(counts).astype(np.int32)], [name.tobytes()], [np.concatenate(many).tobytes()], [len(name)])
    trim()


def evenly(name: bytes) -> np.ndarray:
    """Marks as hashes that are spread over all buckets: as the least of many, nearly all of them are small."""
    return np.frombuffer(name, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _send_marks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack, name, many in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield _rows(SENT, *_sent(pack, buckets, evenly(name), None, 1 + np.frombuffer(many, np.uint8).astype(np.int64))[1])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, mask in enumerate(_masks(batch, 4)):
            key, size, n = (batch.column(c)[k].values.to_numpy() for c in range(3))
            name = np.frombuffer(batch.column(3)[k].as_py(), np.int64)
            order, new = ranked(evenly(name))
            again = np.zeros(len(name), bool)
            again[order] = mask[np.cumsum(new) - 1]
            counts = np.bincount(np.repeat(np.arange(len(n)), n)[again], minlength=len(n))
            names = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(name[again]))
            yield _rows(NAMES, key, size, names).filter(pa.array(counts > 0))


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, bounds in _parts(batches, 2):
        found = list(regions_of(data, bounds, *lists_of(batch.column(3))))
        rows = [r for r, _, _ in found]
        key, size = (batch.column(k).to_numpy() for k in (0, 1))
        yield _rows(REGIONS, key[rows], size[rows], [s for _, s, _ in found], [b for _, _, b in found])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in light_slices(whole, 3, PACK):
            data, bounds = bytes_of(batch.column(3))
            yield _rows(PACKS, *([batch.column(k).to_numpy()] for k in (0, 1, 2, 4)), [np.diff(bounds)], [data.tobytes()], [len(data)])


class Pack:
    """Regions of one row of PACKS, of which hashes are taken a chunk of bytes at a time."""

    def __init__(self, row: pa.RecordBatch | pa.Table):
        of = {n: row.column(n)[0] for n in ("key", "size", "start", "copies", "length")}
        self.key, self.size, self.start, self.copies, length = (v.values.to_numpy() for v in of.values())
        self.id, self.data, self.bounds = row.column("pack")[0].as_py(), np.frombuffer(row.column("body")[0].as_buffer(), np.uint8), np.r_[0, np.cumsum(length)]

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of regions: the first, the end, their bytes and bounds."""
        first, last = 0, len(self.key)
        while first < last:
            stop = max(first + 1, int(np.searchsorted(self.bounds, self.bounds[first] + CHUNK, side="right")) - 1)
            yield first, stop, self.data[self.bounds[first] : self.bounds[stop]], self.bounds[first : stop + 1] - self.bounds[first]
            first = stop

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The blocks at the cover's positions: rank, the stretch's rank, and how many copies of the region there are."""
        out = []
        for first, stop, data, bounds in self.parts():
            row, name, stretch, begin, end = cover_blocks(data, bounds, self.start[first:stop])
            # A stretch counts once a place: where it is the whole region, several blocks can be equal.
            whole = np.flatnonzero((begin == bounds[row]) & (end == bounds[row + 1]))
            whole = whole[np.lexsort((name[whole], row[whole]))]
            keep = np.ones(len(row), bool)
            keep[whole[1:][(np.diff(row[whole]) == 0) & (np.diff(name[whole]) == 0)]] = False
            out.append((name[keep], stretch[keep], self.copies[first + row[keep]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _send_blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            pack = Pack(batch.slice(k, 1))
            name, _, copies = pack.blocks()
            yield _rows(SENT, *_sent(pack.id, buckets, name.view(np.uint64), None, copies)[1])
    trim()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, mask in enumerate(_masks(batch, batch.schema.get_field_index("answers"))):
            pack = Pack(batch.slice(k, 1))
            name, stretch, copies = pack.blocks()
            order, new = ranked(name.view(np.uint64))
            order = order[mask[np.cumsum(new) - 1]]
            name, stretch, copies = name[order], stretch[order], copies[order]
            order, new = ranked(name.view(np.uint64), stretch.view(np.uint64))
            at = np.flatnonzero(new)
            n = np.add.reduceat(copies[order], at) if len(at) else np.zeros(0, np.int64)
            yield _rows(STRETCHES, np.full(len(at), pack.id), name[order[at]], stretch[order[at]], n)
    trim()


def _suffixes(packs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """A pack and what is told of its stretches: those of them that are repeated settle their windows, others' windows are compared."""
    if not len(packs) or not len(told):
        return pa.Table.from_batches([], _rows(SUFFIXES, *[[]] * 11).schema)
    pack, parts = Pack(packs), []
    known = told.column("stretch").to_numpy()
    chosen = [np.unique(known[told.column(c).to_numpy()]) for c in ("settle", "compare")]
    for start, end, data, bounds in pack.parts():
        row, _, stretch, first, stop = cover_blocks(data, bounds, pack.start[start:end])
        settled, compared = (within(len(data), first[c], stop[c]) for c in (np.isin(stretch, values) for values in chosen))
        runs, at = runs_of(settled), np.flatnonzero(compared)
        one, two = (Rolling(data, kind).between(at, at + WINDOW) for kind in (SUFFIX, SUFFIX_TOO))
        own = np.searchsorted(bounds, np.r_[runs[:, 0], at], side="right") - 1
        shift = pack.start[start + own] - bounds[own]
        parts.append((start + own, np.r_[runs[:, 0], at] + shift, np.r_[runs[:, 1], at + 1] + shift, np.arange(len(own)) >= len(runs), np.r_[np.ones(len(runs), bool), ~settled[at]], one, (two >> np.uint64(32)).astype(np.uint32)))
    own, first, stop, window, asks, one, two = (np.concatenate(x) for x in zip(*parts, strict=True))
    rank = np.full(len(own), -1, np.int32)
    rank[window], sent = _sent(pack.id, buckets, one, two, pack.copies[own[window]])
    places = [[v[asks].astype(np.int32).tobytes()] for v in (own, first, stop, rank)]
    nothing, n = [None], len(sent[0])
    return pa.Table.from_batches([_rows(SUFFIXES, *sent, *[[None] * n] * 6), _rows(SUFFIXES, [pack.id], [-1], *[nothing] * 3, [pack.key], [pack.size], *places)])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, mask in enumerate(_masks(batch, 6)):
            key, size = (batch.column(c)[k].values.to_numpy() for c in (0, 1))
            own, first, stop, rank = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in (2, 3, 4, 5))
            hit = np.r_[mask, True][rank]
            own, first, stop = own[hit], first[hit], stop[hit]
            begins = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (first[1:] != stop[:-1])][: len(own)])
            ends = np.r_[begins[1:], len(own)][: len(begins)] - 1
            yield _rows(RUNS, key[own[begins]], size[own[begins]], first[begins], stop[ends])


def _written(df: DataFrame, *used: DataFrame) -> DataFrame:
    """``materialise``; the tables ``used`` for it go, and so do its shuffle files, as soon as the driver's JVM has collected the plan: Spark drops them then, and
    on a large driver heap that may otherwise be long after."""
    out = materialise(df, LARGE_ROWS if "binary" in dict(df.dtypes).values() and "pack" in df.columns else None)
    for old in used:
        discard(old)
    df.sparkSession._jvm.System.gc()
    return out


def repeated_windows(texts: DataFrame) -> DataFrame:
    """Runs of window starts (key, size, first, stop) whose WINDOW bytes start more than once in ``texts`` (key, size, text as binary, row to tell copies
    apart by); a row is a text of its own. Runs may overlap. Complete and, but for equal hashes of different bytes (64 bits inside a block's bucket, 96 bits elsewhere), exact.

    Every step's rows are written and its sources deleted, so that the shared folder never holds more than two steps."""
    marks = _written(light(texts).select(*TEXT, "text").mapInArrow(_mark, MARKS).select(F.monotonically_increasing_id().alias("pack"), "*"))
    sent = light(marks).select("pack", "name", "many").mapInArrow(partial(_send_marks, buckets=buckets_for(marks)), SENT)
    own = light(marks.join(more_than_once(sent), "pack")).select(*TEXT, "n", "name", "answers").mapInArrow(_names, NAMES)
    own = _written(own.groupBy(*TEXT).agg(F.flatten(F.collect_set("names")).alias("names")), marks)
    found = light(salted_join(texts, own, TEXT)).select(*TEXT, "text", "names").mapInArrow(_regions, REGIONS)
    # Copies of a text have the same regions; one stands for all from here on.
    copies = found.groupBy(*TEXT, "start", F.xxhash64("body").alias("hash")).agg(F.any_value("body").alias("body"), F.count("*").alias("copies"))
    packs = light(copies).select(*TEXT, "start", "body", "copies").mapInArrow(_pack, PACKS)
    packs = _written(packs.select(F.monotonically_increasing_id().alias("pack"), "*"), own)
    buckets = buckets_for(packs)

    # Blocks that are there once, nine in ten of them, have nothing to tell; ranks are given to what the others lie in.
    sent = light(packs).mapInArrow(partial(_send_blocks, buckets=buckets), SENT)
    again = _written(light(packs.join(more_than_once(sent), "pack")).mapInArrow(_stretches, STRETCHES))
    ranks = _written(again.groupBy("name", "stretch").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("pack").alias("one")))
    shared = _written(ranks.groupBy("name").agg(F.count("*").alias("stretches")).where("stretches > 1"))
    ranks_of = salted_join(ranks, shared, ["name"], "left", hot=hot_keys(shared, ["name"], "stretches")).where("n > 1 OR stretches > 1")
    told = _written(ranks_of.select("name", "stretch", "rows", "one", (F.col("n") > 1).alias("repeated"), F.col("stretches").isNotNull().alias("shared")), ranks, shared)
    # A repeated stretch settles its windows. Where a block is in several stretches, those that are there once, and one of each that is repeated, are compared.
    joined = salted_join(again.select("pack", "name", "stretch"), told.drop("rows"), ["name", "stretch"], hot=hot_keys(told, ["name", "stretch"], "rows"))
    compare = F.col("shared") & (~F.col("repeated") | (F.col("one") == F.col("pack")))
    of_pack = _written(joined.select("pack", "stretch", F.col("repeated").alias("settle"), compare.alias("compare")), told, again)
    taken = packs.groupBy("pack").cogroup(of_pack.groupBy("pack")).applyInArrow(partial(_suffixes, buckets=buckets), SUFFIXES)
    suffixes = _written(taken, packs, of_pack)

    places = suffixes.where("bucket < 0").select("pack", *TEXT, "own", "first", "stop", "rank")
    hits = places.join(more_than_once(suffixes.where("bucket >= 0")), "pack", "left")
    return _written(light(hits).select(*TEXT, "own", "first", "stop", "rank", "answers").mapInArrow(_hits, RUNS), suffixes)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Takes every byte out of the texts that a passage of WINDOW bytes covers which also starts elsewhere, in the same text or another.

    Texts are their UTF-8 bytes; passages are judged on the input and never cross texts. Null text: empty. Texts shorter than a passage: untouched.
    Very long texts: in chunks, and in regions of at most PIECE windows. Null doc_id, ties and repeated rows: a row each; equal texts are each other's repeats.
    Empty table: no rows. Extra columns are ignored. A text or passage that a third of all rows have is dealt to several tasks.
    Returns a row a document: doc_id, n_bytes, spans (removed runs as start and stop), kept (the bytes that are left; a cut may part a letter).
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    runs = repeated_windows(rows.where(F.col("size") >= WINDOW))
    of_text = _written(runs.groupBy(*TEXT).agg(F.collect_list(F.struct("first", "stop")).alias("runs")), runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in light_slices(whole, 1)):
            spans, kept = [], []
            for whole, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not runs:
                    spans.append([])
                    kept.append(whole)
                    continue
                own = np.array([(r["first"], r["stop"] - 1 + WINDOW) for r in runs], np.int64)
                own = own[np.argsort(own[:, 0], kind="stable")]
                reach = np.maximum.accumulate(own[:, 1])
                new = np.r_[True, own[1:, 0] > reach[:-1]]
                firsts, stops = own[new, 0].tolist(), reach[np.r_[new[1:], True]].tolist()
                spans.append([{"start": a, "stop": z} for a, z in zip(firsts, stops, strict=True)])
                kept.append(b"".join(whole[a:z] for a, z in zip([0, *stops], [*firsts, len(whole)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            sizes = pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = light(salted_join(rows, of_text, TEXT, "left")).select("doc_id", "text", "runs")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def removed(spans: str) -> Column:
    """How many bytes the spans have."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep without passages of 200 bytes that start more than once."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", removed("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
