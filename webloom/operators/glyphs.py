"""Glyphs of many pages at once, in numpy arrays: set from texts as a typesetter places them, and read again by their boxes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose glyphs are in memory at once, or one longer page; longer documents are cut between pages.
CHUNK_BYTES = 1 << 18
#: White space: these bytes, and in UTF-8 the separators of Unicode (general category Z).
_BLANK = np.isin(np.arange(256), [9, 10, 12, 13, 32])
_SEPARATORS = np.array([int.from_bytes(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
#: Accents and descenders sit a little off the line, by a glyph's first byte.
_OFF = np.where(np.arange(256) >= 0x80, -0.8, np.where(np.isin(np.arange(256), list(b"gpqy")), 0.6, 0.0))


class Glyphs(NamedTuple):
    """``pages``: the first glyph of each page, none of which is empty; ``text``: the UTF-8 of all glyphs, of which glyph k begins at ``at[k]``."""

    pages: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    top: np.ndarray
    text: np.ndarray
    at: np.ndarray


class Lines(NamedTuple):
    """Lines of pages, from top to bottom: number of the page, height, text's bytes and where each line begins in them, words by tolerance."""

    page: np.ndarray
    top: np.ndarray
    text: np.ndarray
    at: np.ndarray
    words: list[np.ndarray]


def blank(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are white space."""
    out = _BLANK[data]
    if data.size and data.max() >= 0x80:
        two = np.flatnonzero(data[:-1] == 0xC2)
        two = two[data[two + 1] == 0xA0]
        three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
        code = data[three].astype(np.int64) << 16 | data[three + 1].astype(np.int64) << 8 | data[three + 2]
        three = three[np.isin(code, _SEPARATORS)]
        out[np.concatenate([two, two + 1, three, three + 1, three + 2])] = True
    return out


def typeset(data: np.ndarray, starts: np.ndarray, gaps: np.ndarray, per_page: int, pitch: float) -> tuple[Glyphs, np.ndarray, np.ndarray]:
    """Glyphs of texts that begin at ``starts`` of the UTF-8 ``data``, as ``layout.laid_out`` places them; of each page its text and its number there."""
    white = blank(data)
    ink = ~white
    text, lead = data[ink], ink
    if data.size and data.max() >= 0x80:
        lead = ink & ((data & 0xC0) != 0x80)
    byte = np.flatnonzero(lead)
    n = len(byte)
    at = np.append(np.flatnonzero(lead[ink]), len(text)) if len(text) > n else np.arange(n + 1)
    # Lines begin with texts and behind line ends; of each that has glyphs: its text, its place there and its first glyph.
    ends = np.flatnonzero(data == 10)
    heads = np.concatenate([ends + 1, starts])
    order = np.argsort(heads, kind="stable")
    bounds = np.append(np.searchsorted(byte, heads[order]), n)
    of = np.cumsum(order >= len(ends)) - 1
    place = np.arange(len(order)) - np.flatnonzero(order >= len(ends))[of]
    used = np.flatnonzero(np.diff(bounds))
    begins, of, place = bounds[used], of[used], place[used]
    # Words, and how many are before each on its line.
    new = white[byte - 1]
    new[begins] = True
    word = np.flatnonzero(new)
    many = np.diff(np.append(begins, n))
    first = np.searchsorted(word, begins)
    nth = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
    shift = nth * np.repeat(gaps[of] - 1, np.diff(np.append(first, len(word))))
    x0 = (np.arange(n) - np.repeat(begins, many)) * pitch
    x0 += np.repeat(shift, np.diff(np.append(word, n)))
    top = np.repeat(place % per_page * 12.0, many)
    top += _OFF[text[at[:-1]] if len(text) > n else text]
    number = place // per_page
    page = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(number) != 0))[: len(of)])
    return Glyphs(begins[page], x0, x0 + (pitch - 1), top, text, at), of[page], number[page]


def _reach(begins: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """How far glyphs of each line reach, up to each of them; lines stand together and begin at ``begins``."""
    back = x1[1:] < x1[:-1]
    back[begins[1:] - 1] = False
    if not back.any():
        return x1
    order = np.argsort(x1, kind="stable")
    rank = np.empty(len(x1), np.int64)
    rank[order] = np.arange(len(x1))
    line = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(x1)))) * len(x1)
    return x1[order[np.maximum.accumulate(line + rank) - line]]


def read(glyphs: Glyphs, x_tolerances: tuple[float, ...], y_tolerance: float) -> Lines:
    """What ``layout.words`` and ``layout.page_text`` read on each page, with the texts of the first tolerance. Glyphs may stand in any order on their page; all have a place and ink."""
    pages, x0, x1, top, text, at = glyphs
    n = len(x0)
    if not n:
        return Lines(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint8), np.zeros(1, np.int64), [np.zeros(0, np.int64) for _ in x_tolerances])
    # Heights are sorted by runs of glyphs that have the same: a line ends where the next is more than the tolerance below.
    new = np.empty(n, bool)
    np.not_equal(top[1:], top[:-1], out=new[1:])
    new[pages] = True
    runs = np.flatnonzero(new)
    page, high = np.searchsorted(pages, runs, "right") - 1, top[runs]
    order = np.lexsort((high, page))
    page, high = page[order], high[order]
    apart = np.append(True, (page[1:] != page[:-1]) | (high[1:] - high[:-1] > y_tolerance))
    number = np.empty(len(runs), np.int64)
    number[order] = np.cumsum(apart) - 1
    begins = runs[np.append(True, number[1:] != number[:-1])]
    # Most pages hold their glyphs in reading order; others are sorted, at one place by text.
    back = x0[1:] <= x0[:-1]
    back[begins[1:] - 1] = False
    if back.any() or np.any(number[1:] < number[:-1]):
        line = np.repeat(number, np.diff(np.append(runs, n)))
        drawn = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)])
        table = pa.table({"line": line, "x0": x0, "x1": x1, "text": drawn})
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in table.column_names]))
        line, x0, x1 = (table[c].to_numpy() for c in table.column_names[:3])
        drawn = pa.concat_arrays(table["text"].chunks)
        at = np.frombuffer(drawn.buffers()[1], np.int64, n + 1, 8 * drawn.offset)
        at, text = at - at[0], np.frombuffer(drawn.buffers()[2], np.uint8)[at[0] : at[-1]]
        begins = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    # Breaks between words of a line, by the glyph that comes next.
    space = x0[1:] - _reach(begins, x1)[:-1]
    space[begins[1:] - 1] = -np.inf
    breaks = [np.flatnonzero(space > x) + 1 for x in x_tolerances]
    before = [np.searchsorted(b, np.append(begins, n)) for b in breaks]
    return Lines(page[apart], high[apart], np.insert(text, at[breaks[0]], 32), at[np.append(begins, n)] + before[0], [np.diff(b) + 1 for b in before])


def _pieces(data: np.ndarray, offsets: np.ndarray, per_page: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, first page) of texts, those of more than ``most`` bytes cut between pages."""
    rows, starts, numbers = [np.arange(len(offsets) - 1)], [offsets[:-1]], [np.zeros(len(offsets) - 1, np.int64)]
    for row in np.flatnonzero(np.diff(offsets) > most):
        cuts = offsets[row] + np.flatnonzero(data[offsets[row] : offsets[row + 1]] == 10)[per_page - 1 :: per_page] + 1
        # Of the cuts within ``most`` bytes, the last.
        kept = np.flatnonzero(np.diff((cuts - offsets[row]) // most, append=-1))
        rows.append(np.full(len(kept), row))
        starts.append(cuts[kept])
        numbers.append(kept + 1)
    row, start, number = map(np.concatenate, (rows, starts, numbers))
    order = np.lexsort((number, row))
    return row[order], start[order], number[order]


def _chunks(starts: np.ndarray, end: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Runs of pieces of about ``most`` bytes together, and the byte where each ends."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most)))
        yield a, b, int(starts[b]) if b < len(starts) else end
        a = b


def read_back(rows: pa.Array, x_tolerances: tuple[float, ...], y_tolerance: float, per_page: int, pitch: float, most: int = CHUNK_BYTES) -> pa.Array:
    """Of each list of texts (text, gap) the lines (page, top, text) that are read from its texts' glyphs, and how many words there are by each tolerance. Null texts and gaps: no lines."""
    each, owner = rows.flatten(), np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
    given = pc.and_(each.field("gap").is_valid(), each.field("text").is_valid())
    each, owner = each.filter(given), owner[given.to_numpy(zero_copy_only=False)]
    texts, gap = each.field("text").cast(pa.large_string()), each.field("gap").cast(pa.float64()).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    row, start, number = _pieces(data, offsets, per_page, most)
    words, n_lines = np.zeros((len(rows), len(x_tolerances)), np.int64), np.zeros(len(rows), np.int64)
    pages, tops, parts, begins, shift = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], 0
    for a, b, end in _chunks(start, int(offsets[-1]), most):
        glyphs, piece, page = typeset(data[start[a] : end], start[a:b] - start[a], gap[row[a:b]], per_page, pitch)
        lines = read(glyphs, x_tolerances, y_tolerance)
        piece = piece[lines.page] + a
        np.add.at(n_lines, owner[row[piece]], 1)
        for k, n in enumerate(lines.words):
            np.add.at(words[:, k], owner[row[piece]], n)
        pages.append(page[lines.page] + number[piece])
        tops.append(lines.top)
        parts.append(lines.text)
        begins.append(lines.at[:-1] + shift)
        shift += int(lines.at[-1])
    at = np.concatenate([*begins, [shift]]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.concatenate(parts))).cast(pa.string())
    lines = pa.StructArray.from_arrays([pa.array(np.concatenate(pages), pa.int64()), pa.array(np.concatenate(tops)), text], ["page", "top", "text"])
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_lines)), pa.int32()), lines)
    counted = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(x_tolerances), pa.int32()), pa.array(words.reshape(-1)))
    return pa.StructArray.from_arrays([listed, counted], ["lines", "words"])
