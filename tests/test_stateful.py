"""Stateful streams over several micro-batches against plain loops, with late rows, keys of other types and state that goes."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.helpers import same_rows
from webloom import plans
from webloom.operators import folds
from webloom.streaming import stateful

START = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)


def run(spark, tmp_path, parts, schema, make):
    """The rows that a stream makes of parts, a micro-batch each, and how many rows of state are left."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect(), query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("key", ["string", "bigint"])
def test_jobs(spark, tmp_path, key):
    rng = random.Random(2)
    name = (lambda k: k) if key == "bigint" else (lambda k: f"job {k}")
    rows, at = [], START
    for seq in range(300):
        at += HOUR * rng.choice([0.1, 1, 3])
        rows.append((name(seq // 30 if rng.random() < 0.9 else rng.randrange(10)), seq, at, rng.choice(["page", "page", "error", "started", "completed", "cancelled"])))
    parts = [rows[k : k + 60] for k in range(0, 300, 60)]
    # Rows behind the watermark are left out, wherever they would belong.
    parts[3] = [*parts[3], (name(0), 10_000, START, "page"), (name(77), 10_001, START, "page")]
    got, left = run(spark, tmp_path, parts, f"job {key}, seq long, ts timestamp, kind string", stateful.job_stream)
    want, state = [], {}
    for job, seq, ts, kind in rows:
        if job in state and ts - state[job][3] >= 24 * HOUR:
            want.append((job, state[job][3] + 24 * HOUR, None, "expired", *state.pop(job)[1:3]))
        status, pages, errors, _ = state.get(job, ("scraping", 0, 0, None))
        if status == "scraping":
            pages, errors = pages + (kind == "page"), errors + (kind == "error")
            status = kind if kind in ("completed", "cancelled") else status
        state[job] = (status, pages, errors, ts)
        want.append((job, ts, seq, status, pages, errors))
    end = at - datetime.timedelta(minutes=10)
    gone = [job for job, s in state.items() if s[3] + 24 * HOUR <= end]
    want += [(job, state[job][3] + 24 * HOUR, None, "expired", *state[job][1:3]) for job in gone]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    # A value and a timer, which is kept in two orders, for each job that is still there; nothing for the others.
    assert len(gone) > 5 and left <= 3 * (len(state) - len(gone))


def test_crawls(spark, tmp_path):
    events = [("found", None), ("found", None), ("page", "new"), ("error", None), ("page", "same"), ("done", None), ("found", None), ("page", None)]
    rows = [("c", k, START + HOUR * k, kind, change) for k, (kind, change) in enumerate(events)]
    other = [("d", 100, START + HOUR * 100, "found", None)]
    got, left = run(spark, tmp_path, [rows[:4], rows[4:], other], "crawl string, seq long, ts timestamp, kind string, change string", stateful.crawl_stream)
    mine = sorted([tuple(r)[1:] for r in got if r.crawl == "c"], key=lambda r: (r[0], r[2] == "complete", r[3]))
    assert [r[1:] for r in mine] == [
        (0, "mapping", 1, 0, None), (1, "mapping", 2, 0, None), (2, "progress", 0, 2, None), (2, "page", 1, 2, None), (2, "progress", 1, 2, None), (3, "error", 2, 2, None), (3, "progress", 2, 2, None),
        (4, "page", 3, 2, None), (4, "progress", 3, 2, None), (5, "complete", 3, 2, "new:1,same:1"), (6, "mapping", 1, 0, None), (7, "progress", 0, 1, None), (7, "page", 1, 1, None), (7, "progress", 1, 1, None), (None, "error", 1, 1, ""),
    ]
    assert left <= 3


def test_champions(spark, tmp_path):
    """Micro-batches leave what one pass over the history leaves, but for champions that nobody confirms for two weeks."""
    rng = random.Random(9)
    rows = []
    for seq in range(400):
        rows.append((rng.choice(["a", "b", "c"]), seq, rng.choice([None, "playwright", "camoufox"]), rng.random() < 0.5, 5, True, rng.choice(["ok", "ok", "captcha", "thin"]), rng.randrange(30, 100), START + HOUR * seq * 0.5))
    stale = ("old", -1, "camoufox", True, 5, False, "ok", 90, START)
    late = ("end", 900, None, False, 5, True, "thin", 0, START + HOUR * 24 * 15)
    schema = "domain string, seq long, engine string, stealth boolean, wait_for int, only_main boolean, verdict string, score int, ts timestamp"
    got, _ = run(spark, tmp_path, [[stale, *rows[:150]], rows[150:300], [*rows[300:], late]], schema, stateful.champion_stream)
    last = {}
    for r in sorted(got, key=lambda r: (r.at, r.seq or 0)):
        last[r.domain] = r
    want = {r.domain: r for r in folds.champions(spark.createDataFrame(rows, schema)).collect()}
    assert {d: (r.engine, r.stealth, r.wait_for, r.only_main, round(r.ewma, 9), r.samples) for d, r in last.items() if r.known} == {d: (r.engine, r.stealth, r.wait_for, r.only_main, round(r.ewma, 9), r.samples) for d, r in want.items()}
    assert not last["old"].known and last["old"].at == START + HOUR * 24 * 14 and "end" not in last


def test_no_rows(spark, tmp_path):
    spark.range(0).selectExpr("id AS job", "id AS seq", "timestamp_seconds(id) AS ts", "'page' AS kind").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("job long, seq long, ts timestamp, kind string").parquet(f"{tmp_path}/in")
    query = stateful.job_stream(source).writeStream.format("memory").queryName("none").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("none").agg(F.count("*")).first()[0] == 0


@pytest.mark.parametrize(("name", "hours"), [("stream_jobs", 24), ("stream_crawl", 48)])
def test_parts_of_a_millisecond(spark, tmp_path, name, hours):
    """Lives that end within a millisecond of the key's next event or of the last watermark, against the query's SQL."""
    start, life = "TIMESTAMP '2024-01-01 00:00:00.500'", f"INTERVAL {hours} HOUR"
    places = [-1600, -1100, -900, -600, -500, -400, -1, 0, 1, 400, 499, 500, 501, 900, 1100, 1600]
    # Two events a user, a life apart but for parts of milliseconds; users with one event, a life before the watermark; the last event of all.
    pairs = [(len(places) * k + j, a, b) for k, a in enumerate(places) for j, b in enumerate(places)]
    rows = [f"({2 * u}, {start} + INTERVAL ({a}) MICROSECOND, {u}), ({2 * u + 1}, {start} + {life} + INTERVAL ({b}) MICROSECOND, {u})" for u, a, b in pairs]
    rows += [f"({9000 + k}, {start} + {life} + INTERVAL ({a}) MICROSECOND, {1000 + k})" for k, a in enumerate(places)]
    rows.append(f"(9999, {start} + {life} + {life} + INTERVAL 10 MINUTE + INTERVAL 1 MICROSECOND, 5000)")
    events = f"SELECT id::BIGINT AS event_id, ts, u::BIGINT AS user_id, CASE WHEN id % 2 = 0 THEN 'view' ELSE 'error' END AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM (VALUES {', '.join(rows)}) t(id, ts, u)"
    duckdb.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same_rows(plans.QUERIES[name](spark, str(tmp_path)), con, plans.ORACLES[name])
