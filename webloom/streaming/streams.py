"""Structured Streaming over event logs: roll-ups with watermarks, and per-key state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events (ts, kind, success) by hour and kind; those later than ``late`` behind the newest are dropped, which bounds the state."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "kind")
        .agg(F.count("*").alias("n"), F.count_if("success").alias("succeeded"))
        .select(F.col("w.start").alias("hour"), "kind", "n", "succeeded")
    )


def _type(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def change_stream(versions: DataFrame) -> DataFrame:
    """New, same, changed or removed per version (key, version, content_hash, success), against the last successful one, which is the key's only state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("version")
        last = state.get[0] if state.exists else None
        out = []
        for r in rows.itertuples():
            if not r.success:
                status = None if last is None else "removed"
            else:
                status = "new" if last is None else "same" if last == r.content_hash else "changed"
                last = r.content_hash
            out.append((key[0], r.version, status))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "version", "status"])

    return versions.groupBy("key").applyInPandasWithState(step, f"key {_type(versions, 'key')}, version long, status string", "content_hash string", "append", GroupStateTimeout.NoTimeout)


def recent_stream(searches: DataFrame, size: int = 5) -> DataFrame:
    """Per search (scope, seq, empty) whether the last ``size`` were all empty; the state is those answers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(batches).sort_values("seq").itertuples():
            last = [*last, bool(r.empty)][-size:]
            out.append((key[0], r.seq, len(last) == size and all(last)))
        state.update((last,))
        yield pd.DataFrame(out, columns=["scope", "seq", "all_recent_empty"])

    return searches.groupBy("scope").applyInPandasWithState(step, f"scope {_type(searches, 'scope')}, seq long, all_recent_empty boolean", "last array<boolean>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into parquet below ``path``, and returns what it wrote."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def flush(stream: DataFrame, push: Callable[[DataFrame], None], every: str = "5 seconds", checkpoint: str | None = None, most: int = 25, at_exit: bool = False):  # noqa: ANN201
    """Hands each micro-batch to ``push`` (a remote sink), in parts of at most ``most`` events, each a job of its own; for sinks that take a table. The checkpoint replays a
    batch that failed. ``at_exit``: what is there now, once, and an end, as a process does before it goes."""

    def parts(batch: DataFrame, _: int) -> None:
        # A row's place in its partition is in the low bits of its number.
        number = F.monotonically_increasing_id()
        kept = batch.withColumn("__part", F.struct(F.shiftright(number, 33).alias("task"), F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / most).alias("run"))).persist()
        for part in sorted(r["__part"] for r in kept.select("__part").distinct().collect()):
            push(kept.where((F.col("__part.task") == part.task) & (F.col("__part.run") == part.run)).drop("__part"))
        kept.unpersist()

    return _started(stream.writeStream.foreachBatch(parts), every, checkpoint, at_exit)


def send_rows(stream: DataFrame, send: Callable[[list[Row]], None], every: str = "5 seconds", checkpoint: str | None = None, most: int = 25, at_exit: bool = False, order: str | None = None):  # noqa: ANN201
    """Hands each micro-batch's rows to ``send`` on the executors, at most ``most`` a call, in one pass over the batch: a job a batch however many calls it takes. Within a
    task rows come by ``order``, where it is given. A call that fails fails the batch, which the checkpoint replays; so a sink has to bear what it had before."""

    def some(rows: Iterator[Row]) -> None:
        while part := list(islice(rows, most)):
            send(part)

    def deliver(batch: DataFrame, _: int) -> None:
        (batch.sortWithinPartitions(order) if order else batch).foreachPartition(some)

    return _started(stream.writeStream.foreachBatch(deliver), every, checkpoint, at_exit)


def _started(writer: DataStreamWriter, every: str, checkpoint: str | None, at_exit: bool):  # noqa: ANN202
    writer = writer.trigger(availableNow=True) if at_exit else writer.trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def health_stream(outcomes: DataFrame, unavailable: int = 3, degraded: int = 3) -> DataFrame:
    """The status of a provider after each outcome (provider, seq, outcome in success, empty, failure) as it comes; the state is two counts and the status."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, empties, status = state.get if state.exists else (0, 0, "healthy")
        out = []
        for r in pd.concat(batches).sort_values("seq").itertuples():
            if r.outcome == "success":
                failures, empties, status = 0, 0, "healthy"
            elif r.outcome == "failure":
                failures += 1
                status = "unavailable" if failures >= unavailable else "degraded"
            else:
                failures, empties = 0, empties + 1
                status = "degraded" if empties >= degraded or status == "unavailable" else status
            out.append((key[0], r.seq, failures, empties, status))
        state.update((failures, empties, status))
        yield pd.DataFrame(out, columns=["provider", "seq", "failures", "empties", "status"])

    schema = f"provider {_type(outcomes, 'provider')}, seq long, failures long, empties long, status string"
    return outcomes.groupBy("provider").applyInPandasWithState(step, schema, "failures long, empties long, status string", "append", GroupStateTimeout.NoTimeout)


def throttle_stream(arrivals: DataFrame) -> DataFrame:
    """When each request (host, ordinal, arrival, delay) may start, as they come; the state is the last start."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        out = []
        for r in pd.concat(batches).sort_values("ordinal").itertuples():
            last = max(r.arrival, last + r.delay)
            out.append((key[0], r.ordinal, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["host", "ordinal", "granted"])

    return arrivals.groupBy("host").applyInPandasWithState(step, f"host {_type(arrivals, 'host')}, ordinal long, granted double", "last double", "append", GroupStateTimeout.NoTimeout)
