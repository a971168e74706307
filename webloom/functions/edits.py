"""Line diffs: a shortest edit script by Myers' divide and conquer, and the unified format made of it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equal lines shown around a change.
CONTEXT = 3
NO_END = "\\ No newline at end of file\n"


def lines(text: str | None) -> list[str]:
    """A text's lines with their ends."""
    return re.findall(r"[^\n]*\n|[^\n]+", text or "")


def reached(reach: dict[int, int], k: int, n: int, m: int) -> int:
    """How far a path with one edit more gets on diagonal ``k`` inside n by m, by a deletion or an insertion; -1 if not at all."""
    ends = (reach.get(k + 1, -1), reach.get(k - 1, -2) + 1)
    return max((x for x in ends if 0 <= x <= n and 0 <= x - k <= m), default=-1)


def middle_snake(a: list, b: list, box: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """Where a shortest script through the box (a0, a1, b0, b1) has its middle run of equal lines: from (x, y) to (u, v). Furthest reaching
    paths from both ends, a step at a time, until they meet; memory grows with the number of edits only."""
    a0, a1, b0, b1 = box
    n, m = a1 - a0, b1 - b0
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            start = x = reached(ahead, k, n, m)
            while 0 <= x < n and x - k < m and a[a0 + x] == b[b0 + x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and x >= 0 and abs(delta - k) < d and 0 <= back.get(delta - k, -1) and x + back[delta - k] >= n:
                return a0 + start, b0 + start - k, a0 + x, b0 + x - k
        for k in range(-d, d + 1, 2):
            start = x = reached(back, k, n, m)
            while 0 <= x < n and x - k < m and a[a1 - 1 - x] == b[b1 - 1 - x + k]:
                x += 1
            back[k] = x
            if not delta % 2 and x >= 0 and abs(delta - k) <= d and 0 <= ahead.get(delta - k, -1) and x + ahead[delta - k] >= n:
                return a1 - x, b1 - x + k, a1 - start, b1 - start + k
    raise AssertionError("paths always meet")


def common_runs(a: list, b: list) -> list[tuple[int, int, int]]:
    """Runs (place in a, place in b, length) of a longest common subsequence. Common beginnings and ends are cut off first, and elements that the
    other side has not are left out, as no script can keep them."""
    in_a, in_b = Counter(a), Counter(b)
    rows = [k for k, v in enumerate(a) if v in in_b]
    columns = [k for k, v in enumerate(b) if v in in_a]
    a, b = [a[k] for k in rows], [b[k] for k in columns]
    found, boxes = [], [(0, len(a), 0, len(b))]
    while boxes:
        a0, a1, b0, b1 = boxes.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 < a1 and b0 < b1:
            x, y, u, v = middle_snake(a, b, (a0, a1, b0, b1))
            found += zip(range(x, u), range(y, v), strict=True)
            boxes += [(a0, x, b0, y), (u, a1, v, b1)]
    runs: list[list[int]] = []
    for i, j in sorted((rows[i], columns[j]) for i, j in found):
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    return [tuple(r) for r in runs]


def changes(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """What a shortest script replaces: lines i to j of ``a`` by lines k to l of ``b``."""
    out, i, k = [], 0, 0
    for x, y, n in [*common_runs(a, b), (len(a), len(b), 0)]:
        if i < x or k < y:
            out.append((i, x, k, y))
        i, k = x + n, y + n
    return out


def _range(first: int, stop: int) -> str:
    n = stop - first
    return f"{first + 1}" if n == 1 else f"{first + 1 if n else first},{n}"


def unified(old: str | None, new: str | None, context: int = CONTEXT) -> str | None:
    """The unified diff of two texts, null for equal ones; nulls count as empty. A text's last line without an end is marked where more of the
    diff follows, so that the diff can be applied."""
    a, b = lines(old), lines(new)
    edits = changes(a, b)
    if not edits:
        return None
    hunks: list[list[tuple[int, int, int, int]]] = []
    for e in edits:
        if hunks and e[0] - hunks[-1][-1][1] <= 2 * context:
            hunks[-1].append(e)
        else:
            hunks.append([e])
    out = ["--- previous\n", "+++ current\n"]
    put = lambda sign, rows: out.extend(f"{sign}{r}" if r.endswith("\n") else f"{sign}{r}\n{NO_END}" for r in rows)
    for hunk in hunks:
        before, after = min(context, hunk[0][0]), min(context, len(a) - hunk[-1][1])
        first, stop = hunk[0][0] - before, hunk[-1][1] + after
        out.append(f"@@ -{_range(first, stop)} +{_range(hunk[0][2] - before, hunk[-1][3] + after)} @@\n")
        for i, j, k, m in hunk:
            put(" ", a[first:i])
            put("-", a[i:j])
            put("+", b[k:m])
            first = j
        put(" ", a[first:stop])
    return "".join(out).removesuffix(f"\n{NO_END}")


def applied(old: str | None, diff: str | None) -> str:
    """What a unified diff makes of a text."""
    a, out, at, added = lines(old), [], 0, False
    for row in lines(diff)[2:]:
        if row.startswith("@@ -"):
            first, n = ([*row[4:].split(" ", 1)[0].split(","), "1"])[:2]
            upto = int(first) - (n != "0")
            out += a[at:upto]
            at = upto
        elif row == NO_END:
            if added:
                out[-1] = out[-1].removesuffix("\n")
        else:
            added = row[0] == "+"
            out += [row[1:]] if added else a[at : at + 1] if row[0] == " " else []
            at += not added
    return "".join([*out, *a[at:]])


def edit_sizes(previous: Column, current: Column) -> Column:
    """How many lines a shortest edit script removes and adds, and in how many places; nulls count as empty."""

    @F.pandas_udf("struct<removed:long,added:long,hunks:long>")
    def sizes(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for old, new in parts:
            rows = [changes(lines(a), lines(b)) for a, b in zip(old.where(old.notna(), None), new.where(new.notna(), None), strict=True)]
            yield pd.DataFrame([(sum(j - i for i, j, _, _ in r), sum(m - k for _, _, k, m in r), len(r)) for r in rows], columns=["removed", "added", "hunks"])

    return sizes(previous, current)


def unified_diff(previous: Column, current: Column) -> Column:
    """``unified`` of two columns, a row at a time in Arrow batches."""

    @F.pandas_udf("string")
    def diff(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in parts:
            yield pd.Series([unified(a, b) for a, b in zip(old.where(old.notna(), None), new.where(new.notna(), None), strict=True)], dtype=object)

    return diff(previous, current)
