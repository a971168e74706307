"""Diffs against the table of longest common subsequences, and applied again."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import edits


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnop"])
def test_scripts_are_shortest(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        runs = edits.common_runs(a, b)
        assert sum(n for _, _, n in runs) == longest(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in runs)
        assert all(i + n <= k and j + n <= m for (i, j, n), (k, m, _) in zip(runs, runs[1:], strict=False))


def test_diffs_apply():
    rng = random.Random(8)
    for _ in range(1500):
        old = "".join(rng.choice(["x\n", "y\n", "z\n", "\n", "-\n", "+++ a\n", "@@ -1 +1 @@\n", "é \n", "a\rb\n"]) for _ in range(rng.randrange(0, 25)))
        parts = edits.lines(old)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(0, len(parts) + 1)
            parts[k : k + rng.randrange(0, 3)] = [rng.choice(["new\n", "x\n", "\\ not this\n"])] * rng.randrange(0, 3)
        new = "".join(parts) + rng.choice(["", "", "open end"])
        old += rng.choice(["", "", "open end", "other end"])
        diff = edits.unified(old, new)
        assert (diff is None) == (old == new) and edits.applied(old, diff) == new


def test_format():
    old = "".join(f"{k}\n" for k in range(1, 31))
    new = old.replace("\n5\n", "\nfive\n").replace("\n9\n", "\n").replace("\n25\n", "\n25\n25a\n")
    assert edits.unified(old, new) == (
        "--- previous\n+++ current\n@@ -2,11 +2,10 @@\n 2\n 3\n 4\n-5\n+five\n 6\n 7\n 8\n-9\n 10\n 11\n 12\n@@ -23,6 +22,7 @@\n 23\n 24\n 25\n+25a\n 26\n 27\n 28\n"
    )
    assert edits.unified(None, "n") == "--- previous\n+++ current\n@@ -0,0 +1 @@\n+n"
    assert edits.unified("x\ny", "") == "--- previous\n+++ current\n@@ -1,2 +0,0 @@\n-x\n-y"
    assert edits.unified("y", "z") == "--- previous\n+++ current\n@@ -1 +1 @@\n-y\n\\ No newline at end of file\n+z"
    assert edits.unified("x", "x") is None and edits.unified("", None) is None


def test_long_texts():
    rng = random.Random(1)
    old = [f"line {rng.randrange(3000)}\n" for _ in range(20_000)]
    new = [x for x in old if rng.random() > 0.005]
    runs = edits.common_runs(old, new)
    assert sum(n for _, _, n in runs) == len(new)
    assert edits.applied("".join(old), edits.unified("".join(old), "".join(new))) == "".join(new)


def test_columns(spark):
    rows = [(1, "a\nb\n", "a\nc\nd\n"), (2, None, None), (3, None, "x"), (4, "x", None), (4, "x", None), (None, "", "")]
    frame = spark.createDataFrame(rows, "k int, a string, b string").select("k", edits.edit_sizes(F.col("a"), F.col("b")).alias("e"), edits.unified_diff(F.col("a"), F.col("b")).alias("d"))
    got = sorted((r.k or 0, *r.e, r.d is None) for r in frame.collect())
    assert got == [(0, 0, 0, 0, True), (1, 1, 2, 1, False), (2, 0, 0, 0, True), (3, 0, 1, 1, False), (4, 1, 0, 1, False), (4, 1, 0, 1, False)]
