"""Ordered folds against plain loops, in one slice and in many."""

import datetime
import random

import pytest

from webloom.operators import folds, requests

START = datetime.datetime(2024, 1, 1)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def plain_champion(history):
    """One domain's champion by the rules, an observation at a time."""
    champion = None
    cost = lambda engine, stealth: int(stealth) if engine in (None, "playwright") else 2
    for engine, stealth, wait, main, verdict, score, ts in history:
        if verdict in ("bot_challenge", "captcha"):
            if champion and champion[:2] == [engine, stealth]:
                champion = None
        elif verdict == "ok" and score >= 40:
            new = [engine, stealth, wait, main, float(score), 1, ts]
            if champion is None:
                champion = new
            elif champion[:2] == [engine, stealth]:
                champion[4:] = [0.5 * score + 0.5 * champion[4], champion[5] + 1, ts]
            elif (cost(engine, stealth) < cost(*champion[:2]) and score >= champion[4] - 5) or score > champion[4] + 5:
                champion = new
    return champion


@pytest.mark.parametrize("slice_rows", [10**6, 100])
def test_champions(spark, slice_rows):
    rng = random.Random(6)
    rows = []
    for seq in range(1500):
        domain = rng.choice(["hot"] * 8 + ["a", "b", None])
        rows.append((domain, seq, rng.choice([None, "playwright", "camoufox"]), rng.random() < 0.5, rng.randrange(3), rng.random() < 0.5, rng.choice(["ok", "ok", "ok", "captcha", "thin", None]), rng.randrange(30, 100), START + datetime.timedelta(hours=seq)))
    rows.append(("early", -5, "camoufox", False, 1, True, "ok", 77, START))
    rows.append(("blocked", 2000, None, False, 1, True, "captcha", 0, START))
    frame = spark.createDataFrame(rows, "domain string, seq long, engine string, stealth boolean, wait_for int, only_main boolean, verdict string, score int, ts timestamp")
    want = {d: plain_champion([r[2:] for r in sorted(rows, key=lambda r: r[1]) if r[0] == d]) for d in {r[0] for r in rows}}
    got = folds.champions(frame, rows_per_slice=slice_rows)
    assert {r[0]: list(r[1:]) for r in got.collect()} == {d: c for d, c in want.items() if c}
    assert folds.champions(frame.limit(0), rows_per_slice=slice_rows).count() == 0


@pytest.mark.parametrize("slice_rows", [10**6, 60])
def test_recent_window(spark, slice_rows):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 9 + ["rare", None]), seq, rng.random() < 0.8) for seq in range(700)]
    got = folds.recent_window(spark.createDataFrame(rows, "scope string, seq long, empty boolean"), rows_per_slice=slice_rows)
    want, last = [], {}
    for scope, seq, empty in rows:
        own = last[scope] = [*last.get(scope, []), empty][-5:]
        want.append((scope, seq, len(own), sum(own), len(own) == 5 and all(own)))
    assert rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("slice_rows", [10**6, 80])
@pytest.mark.parametrize("gap", [20, 150, 400])
def test_alerts(spark, slice_rows, gap):
    """Dense failures without a silence, some with, and some that are at the same time or a debounce apart to the second."""
    rng = random.Random(gap)
    rows, at = [], 0
    for seq in range(600):
        at += rng.choice([0, 1, gap, gap, 299, 300, 301]) if seq % 50 else rng.choice([0, 1000])
        rows.append((rng.choice(["hot"] * 6 + ["a", None]), seq, START + datetime.timedelta(seconds=at)))
    rows = [r for r in rows if r[0]]
    got = requests.alerts(spark.createDataFrame(rows, "provider string, seq long, ts timestamp"), rows_per_slice=slice_rows)
    want, last = [], {}
    for provider, seq, ts in rows:
        fires = provider not in last or (ts - last[provider]).total_seconds() >= requests.DEBOUNCE
        if fires:
            last[provider] = ts
        want.append((provider, seq, fires))
    assert rows_of(got) == sorted(want, key=repr)


def test_one_long_burst(spark):
    rows = spark.range(2000).selectExpr("1 AS provider", "id AS seq", "timestamp_seconds(id * 7) AS ts")
    assert requests.alerts(rows).where("alert").count() == -(-2000 * 7 // 301)
    assert requests.alerts(rows.limit(0)).count() == 0


def test_fallback_chain_at_one_position(spark):
    """Calls at one position count by their outcome, then in the table's order, however the rows are dealt."""
    calls = [
        ("a", 1, "x", "hard_error", 0), ("a", 1, "y", "results", 1), ("a", 1, "z", "empty", 2), ("b", 1, "x", "hard_error", 0), ("b", 1, "y", "empty", 1), ("c", 2, "x", "empty", 1), ("c", 2, "y", "empty", 0),
        ("c", 3, "z", "fallback_error", 2), ("d", 5, "b", "results", 0), ("d", 5, "c", "results", 1), ("e", 1, None, "results", 0), ("e", 2, "z", "results", 1),
    ]
    want = [("a", "results", "y", 1), ("b", "empty", "y", 1), ("c", "empty", "y", 3), ("d", "results", "c", 5), ("e", "error", None, 1)]
    for rows in (calls, calls[::-1]):
        frame = spark.createDataFrame(rows, "search string, position long, provider string, outcome string, row int")
        assert rows_of(folds.fallback_chain(frame)) == want
