"""Streams with state per key and timers in event time: strategies that are forgotten, jobs that expire, crawls that report how far they are.

Rows of a key are folded in the order of their sequence within a micro-batch; rows behind the watermark are dropped by the engine. What a key leaves is one
small struct, and a timer in event time takes it away, so that state does not grow with what is finished."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webloom.operators.folds import ALPHA, MIN_SCORE, SLACK, TTL_DAYS
from webloom.operators.requests import JOB_TTL

DAY_MS = 86_400_000
#: Hours without an event after which a crawl that has not ended is given up.
IDLE_HOURS = 48


class Remembering(StatefulProcessor):
    """One value of state and one timer for a key. ``fold`` takes the value and the key's new rows and returns the value left, or None, and what to emit;
    ``expire`` says what to emit when a value is given up. A value of ``life`` milliseconds is as good as none, whether its timer or a later row comes first."""

    key: str
    state: str
    life: int
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.state}, ms long")

    def close(self) -> None:
        pass

    def fold(self, value: tuple | None, row) -> tuple[tuple | None, list[tuple]]:  # noqa: ANN001
        raise NotImplementedError

    def expire(self, value: tuple) -> list[tuple]:
        return []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.value.get() if self.value.exists() else None
        value, ms = (tuple(held[:-1]), held[-1]) if held else (None, None)
        out = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if value is not None and row.ms - ms >= self.life:
                out += [(ms + self.life, *told) for told in self.expire(value)]
                value = None
            before = value
            value, told = self.fold(value, row)
            out += [(int(row.ms), *t) for t in told]
            ms = ms if value is before and value is not None else int(row.ms)
        self._keep(held, value, ms)
        yield self._emit(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.value.get() if self.value.exists() else None
        if held is not None and held[-1] + self.life <= expiredTimerInfo.getExpiryTimeInMs():
            self.value.clear()
            yield self._emit(key, [(held[-1] + self.life, *told) for told in self.expire(tuple(held[:-1]))])

    def _keep(self, held: tuple | None, value: tuple | None, ms: int | None) -> None:
        if held is not None:
            self.handle.deleteTimer(held[-1] + self.life)
        if value is None:
            self.value.clear()
        else:
            self.value.update((*value, ms))
            self.handle.registerTimer(ms + self.life)

    def _emit(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=[self.key, "ms", *self.columns], dtype=object)


def stateful(rows: DataFrame, key: str, processor: Remembering, schema: str, late: str = "10 minutes") -> DataFrame:
    """``rows`` (with key, seq and ts) through a processor for each key, whatever its type. ``schema`` is what comes beside the key and the
    time of it (``at``: the row's, or that at which a value was given up). Needs the state store that
    timers are kept in, which is set for the session."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = rows.schema[key].dataType.simpleString()
    # Whole milliseconds, rounded as in the SQL twins: rows, timers and the watermark, which would cut off what is below a millisecond, count alike.
    rounded = F.timestamp_micros(F.round(F.unix_micros(F.col("ts").cast("timestamp")), -3))
    timed = rows.withColumn("ts", rounded).withWatermark("ts", late)
    # Milliseconds as a number: exact in pandas, and what timers count in.
    processor.key = key
    out = timed.withColumn("ms", F.unix_millis("ts")).groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, ms long, {schema}", "Append", "EventTime")
    return out.select(key, F.timestamp_millis("ms").alias("at"), *processor.columns)


def _cost(engine: str | None, stealth: bool) -> int:
    return int(stealth) if engine in (None, "playwright") else 2


class Champion(Remembering):
    """``folds.champions`` as observations come, with a champion forgotten TTL_DAYS after it was last confirmed."""

    state = "engine string, stealth boolean, wait_for int, only_main boolean, ewma double, samples int"
    life = TTL_DAYS * DAY_MS
    columns = ["seq", "engine", "stealth", "wait_for", "only_main", "ewma", "samples", "known"]

    def fold(self, value: tuple | None, row) -> tuple[tuple | None, list[tuple]]:  # noqa: ANN001
        after = value
        engine = row.engine if isinstance(row.engine, str) else None
        if row.verdict in ("bot_challenge", "captcha"):
            after = None if value and value[:2] == (engine, row.stealth) else value
        elif row.verdict == "ok" and row.score >= MIN_SCORE:
            seen = (engine, bool(row.stealth), int(row.wait_for), bool(row.only_main), float(row.score), 1)
            if value is None:
                after = seen
            elif value[:2] == seen[:2]:
                after = (*value[:4], float(ALPHA * row.score + (1 - ALPHA) * value[4]), value[5] + 1)
            elif (_cost(*seen[:2]) < _cost(*value[:2]) and row.score >= value[4] - SLACK) or row.score > value[4] + SLACK:
                after = seen
        return after, [] if after is value else [(row.seq, *(after or (None,) * 6), after is not None)]

    def expire(self, value: tuple) -> list[tuple]:
        return [(None, *(None,) * 6, False)]


def champion_stream(observations: DataFrame) -> DataFrame:
    """Each change of a domain's champion (domain, seq, engine, ..., known): null fields and ``known`` false where it is evicted, with ``seq`` null where it is forgotten."""
    schema = "seq long, engine string, stealth boolean, wait_for int, only_main boolean, ewma double, samples int, known boolean"
    return stateful(observations, "domain", Champion(), schema)


class Job(Remembering):
    """A job's status and pages (kind in page, error, completed, failed, cancelled, others as signs of life). Its first end counts: what comes after changes nothing.
    A day after its last event a job is gone; the key's next event begins another."""

    state = "status string, pages long, errors long"
    life = JOB_TTL * 1000
    columns = ["seq", "status", "pages", "errors"]

    def fold(self, value: tuple | None, row) -> tuple[tuple | None, list[tuple]]:  # noqa: ANN001
        status, pages, errors = value or ("scraping", 0, 0)
        if status == "scraping":
            pages, errors = pages + (row.kind == "page"), errors + (row.kind == "error")
            status = row.kind if row.kind in ("completed", "failed", "cancelled") else status
        return (status, pages, errors), [(row.seq, status, pages, errors)]

    def expire(self, value: tuple) -> list[tuple]:
        return [(None, "expired", *value[1:])]


def job_stream(events: DataFrame) -> DataFrame:
    """A job's state after each of its events (job, seq, ts, kind), and a row with status expired and no seq when it is gone."""
    return stateful(events, "job", Job(), "seq long, status string, pages long, errors long")


class Crawl(Remembering):
    """What a crawl reports of its stored events (kind in found, page, error, done; change: new, same, changed, removed or null). An ended crawl leaves no state; its
    key's next event begins another run."""

    state = "found long, done long, changes string, begun boolean"
    life = IDLE_HOURS * 3_600_000
    columns = ["seq", "type", "completed", "total", "changes"]

    def fold(self, value: tuple | None, row) -> tuple[tuple | None, list[tuple]]:  # noqa: ANN001
        found, done, changes, begun = value or (0, 0, "", False)
        counts = Counter({k: int(n) for k, n in (part.split(":") for part in changes.split(",") if part)})
        out = []
        if row.kind == "found":
            found += 1
            out.append((row.seq, "mapping", found, 0, None))
        elif row.kind in ("page", "error"):
            if not begun:
                out.append((row.seq, "progress", 0, found, None))
            begun, done = True, done + 1
            if isinstance(row.change, str):
                counts[row.change] += 1
            out += [(row.seq, row.kind, done, found, None), (row.seq, "progress", done, found, None)]
        told = ",".join(f"{k}:{n}" for k, n in sorted(counts.items()))
        if row.kind == "done":
            return None, [*out, (row.seq, "complete", done, found, told)]
        return (found, done, told, begun), out

    def expire(self, value: tuple) -> list[tuple]:
        return [(None, "error", value[1], value[0], value[2])]


def crawl_stream(events: DataFrame) -> DataFrame:
    """What a crawl reports as its events come (crawl, seq, ts, kind, change): mapping with the urls found so far, progress with pages done of those, each page or error with
    the same, complete with the change summary; error without a seq where IDLE_HOURS pass without an end."""
    return stateful(events, "crawl", Crawl(), "seq long, type string, completed long, total long, changes string")
