"""Telemetry events: filters, summaries, bounded logs, sink payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.prefixes import ROWS_PER_SLICE, prefixes, sliced


def events(log: DataFrame, kind: str | None = None, since: str | None = None) -> DataFrame:
    """Events of a kind, from a moment on (inclusive). A ``ts`` that cannot be read counts as 1970."""
    if kind is not None:
        log = log.where(F.col("kind") == kind)
    if since is not None:
        log = log.where(F.col("ts").isNotNull() & (F.coalesce(F.col("ts").try_cast("timestamp"), F.lit(0).cast("timestamp")) >= F.lit(since).cast("timestamp")))
    return log


def summary(log: DataFrame) -> DataFrame:
    """One row: counts of both kinds, success and escalation rates of scrapes (null without any)."""
    scrape = F.col("kind") == "scrape"
    n = F.count_if(scrape)
    rate = lambda c: F.bround(F.try_divide(F.count_if(scrape & F.coalesce(c, F.lit(False))), n), 3)
    return log.agg(
        n.alias("scrapes"), F.count_if(F.col("kind") == "search").alias("searches"),
        rate(F.col("success")).alias("success_rate"), rate(F.col("escalated")).alias("escalation_rate"),
    )


def top(log: DataFrame, column: str, n: int | None = None, ordinal: str = "event_id") -> DataFrame:
    """Scrapes by a column (null or empty: unknown), most first, ties by first appearance; with ``n`` only so many."""
    key = F.when(F.coalesce(column, F.lit("")) == "", F.lit("unknown")).otherwise(F.col(column))
    counted = log.where("kind = 'scrape'").groupBy(key.alias(column)).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return (counted if n is None else counted.orderBy(F.desc("n"), "first").limit(n)).select(column, "n")


def newest(log: DataFrame, keep_last: int, ordinal: str = "event_id") -> DataFrame:
    """The last ``keep_last`` events of the log. A top-k plan: each task keeps so many, none sorts them all."""
    return log.orderBy(F.desc(ordinal)).limit(keep_last)


def prune(log: DataFrame, cutoff: str, keep_last: int, ordinal: str = "event_id") -> DataFrame:
    """What pruning leaves: events from ``cutoff`` on, of these the last ``keep_last``."""
    return newest(log.where(F.coalesce(F.col("ts").try_cast("timestamp"), F.lit(0).cast("timestamp")) >= F.lit(cutoff).cast("timestamp")), keep_last, ordinal)


def nanoseconds(ts: Column) -> Column:
    """A timestamp as a string of nanoseconds since 1970."""
    return F.concat(F.unix_micros(ts.cast("timestamp")).cast("string"), F.lit("000"))


def stream_batches(log: DataFrame, job: str, batch: int = 500, ordinal: str = "event_id", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Push payloads: per kind and run of ``batch`` events in time order one row with the sorted [time, line] values.

    Places within a kind come from slices of the log's time (``prefixes``), so that no kind is ranked in one task; a payload holds at most ``batch`` events."""
    line = F.to_json(F.struct(*[c for c in log.columns]))
    rows = log.select("kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), nanoseconds(F.col("ts")).alias("ns"), F.col(ordinal).alias("ordinal"), line.alias("line"))
    ordered = sliced(rows, "at", rows_per_slice).withColumn("order", F.struct("at", "ordinal"))
    placed = prefixes(ordered, "kind", "order", {"place": ("sum", F.lit(1))}).withColumn("batch", F.floor((F.col("place") - 1) / batch))
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", "ordinal", "ns", "line"))), lambda v: F.array(v["ns"], v["line"]))
    return placed.groupBy("kind", "batch").agg(F.count("*").alias("n"), values.alias("values")).select(
        F.create_map(F.lit("job"), F.lit(job), F.lit("kind"), F.col("kind")).alias("stream"), "kind", "batch", "n", "values"
    )


def private(log: DataFrame, url: str | None = None, query: str | None = None) -> DataFrame:
    """Urls become domains and queries short hashes; the originals go."""
    from webloom.functions import urls as U

    if url:
        log = log.withColumn("domain", U.registrable_domain(F.col(url))).drop(url)
    if query:
        log = log.withColumn("query_hash", F.substring(F.sha2(query, 256), 1, 12)).drop(query)
    return log


#: What the answer of a log store means. Texts of our own.
ANSWERS = {400: "the payload was refused", 401: "the credentials were not accepted", 403: "the credentials may not write", 404: "there is no such endpoint", 429: "too many requests"}


def answer_of(status: int | None, failure: str | None = None) -> dict:
    """A log store's answer as ok, status and detail."""
    if status is None:
        return {"ok": False, "status": None, "detail": (failure or "no answer")[:200]}
    if status < 300:
        return {"ok": True, "status": status, "detail": "ok"}
    return {"ok": False, "status": status, "detail": ANSWERS.get(status, "the server failed" if status >= 500 else f"unexpected status {status}")}


def send(payload: dict, post: Callable[[dict], int]) -> dict:
    """Hands a payload to ``post`` (which returns a status) and tells how it went; it never raises."""
    try:
        return answer_of(post(payload))
    except Exception as e:  # noqa: BLE001 - telemetry must not break what it reports on
        return answer_of(None, str(e))


def check(post: Callable[[dict], int], job: str, now_ns: int) -> dict:
    """Sends one diagnostic event, to see whether a log store takes any."""
    return send({"streams": [{"stream": {"job": job, "kind": "diagnostic"}, "values": [[str(now_ns), '{"kind":"diagnostic"}']]}]}, post)


def replay(log: DataFrame, post: Callable[[dict], int], job: str, batch: int = 500, ordinal: str = "event_id") -> dict:
    """Sends a whole log in payloads of at most ``batch`` events of a kind, one after another, and stops at the first that fails. The driver holds a partition of
    payloads at a time. Returns how many events went out, whether all did, and what the last answer was."""
    sent, last = 0, answer_of(200)
    for row in stream_batches(log, job, batch, ordinal).orderBy("kind", "batch").toLocalIterator():
        last = send({"streams": [{"stream": dict(row.stream), "values": [list(v) for v in row["values"]]}]}, post)
        if not last["ok"]:
            break
        sent += row.n
    return {"sent": sent, "complete": last["ok"], "last": last}
