"""Runs of equal tokens: no window with enough equal ones is without."""

from itertools import combinations

import numpy as np
import pytest

from webloom.llm import decontamination as D


@pytest.mark.parametrize("span", range(D.MIN_ITEM, D.SPAN + 1))
def test_every_window_has_a_run(span):
    least = span
    for other in combinations(range(span), span - D.needed(span)):
        best = run = 0
        for k in range(span):
            run = 0 if k in other else run + 1
            best = max(best, run)
        least = min(least, best)
    assert 2 <= D.run_of(span) <= least


def test_likely_windows():
    rng = np.random.default_rng(3)
    for span in (5, 8, 12):
        tokens, item = rng.integers(0, 40, 400).astype(np.uint64), rng.integers(0, 40, 60).astype(np.uint64)
        bits = 16
        filled = np.zeros(1 << bits - 3, np.uint8)
        for places in D._probes(D.grams_of(item, span), bits):
            np.bitwise_or.at(filled, places >> np.uint64(3), (np.uint64(1) << (places & np.uint64(7))).astype(np.uint8))
        known = {tuple(item[k : k + D.run_of(span)]) for k in range(len(item) - D.run_of(span) + 1)}
        want = {k for k in range(len(tokens) - span + 1) if any(tuple(tokens[j : j + D.run_of(span)]) in known for j in range(k, k + span - D.run_of(span) + 1))}
        got = D.likely(tokens, span, bits, filled)
        assert want <= set(got.tolist()) and len(got) <= 1.1 * len(want) + 20
        starts = got[::3] if len(got) else np.arange(5)
        assert all((a[starts] == b).all() for a, b in zip(D.seeds_of(tokens, span), D.seeds_of(tokens, span, starts), strict=True))
    assert len(D.likely(tokens[:3], 12, bits, filled)) == 0
