"""Queries that run a stream over the tables, to be held against the same in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans import histories
from webloom.session import shared_dir, table
from webloom.streaming import stateful, streams


def _place(spark: SparkSession) -> str:
    """A folder for a stream's rows and state, which goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over the table's files: a table is a folder, or one file that the pattern picks."""
    shape = table(spark, sf_dir, name)
    return spark.readStream.schema(shape.schema).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").selectExpr("ts", "CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'scrape' END AS kind", "event_type <> 'error' AS success")
    out = streams.drain(streams.hourly(e), _place(spark))
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "kind", "n", "succeeded")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _stream(spark, sf_dir, "conversations").selectExpr("conv_id AS key", "turn AS version", "sha2('v' || CAST(floor(turn / 2) AS STRING) || conv_id, 256) AS content_hash", "length(text) % 6 <> 0 AS success")
    return streams.drain(streams.change_stream(v), _place(spark))


def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events").selectExpr("user_id AS scope", "event_id AS seq", "event_type IN ('view', 'click', 'error') AS empty")
    return streams.drain(streams.recent_stream(s), _place(spark))


def _outcomes(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("user_id AS provider", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'empty' ELSE 'success' END AS outcome")


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.health_stream(_outcomes(_stream(spark, sf_dir, "events"))), _place(spark)).select("provider", "seq", "failures", "status")


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _stream(spark, sf_dir, "events").selectExpr("user_id AS host", "event_id AS ordinal", "CAST(event_id % 50 AS DOUBLE) AS arrival", "CAST(0.5 AS DOUBLE) AS delay")
    return streams.drain(streams.throttle_stream(a), _place(spark)).select("host", "ordinal", F.round("granted", 6).alias("granted"))


def stream_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is remembered of each domain once the log is through, by the changes that the stream reported."""
    told = streams.drain(stateful.champion_stream(_stream(spark, sf_dir, "events").selectExpr(*histories.columns(histories.OBSERVED))), _place(spark))
    last = told.groupBy("domain").agg(F.max_by(F.struct("known", "engine", "stealth", "only_main", "ewma", "samples"), F.struct("at", "seq")).alias("c")).where("c.known")
    return last.select("domain", "c.engine", "c.stealth", "c.only_main", F.round("c.ewma", 6).alias("ewma"), F.col("c.samples").cast("long").alias("samples"))


_JOB = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'started' ELSE 'page' END"
_CRAWL = "CASE WHEN event_type IN ('view', 'signup') THEN 'found' WHEN event_type = 'error' THEN 'error' WHEN event_id % 5 = 0 THEN 'done' ELSE 'page' END"
_CHANGE = "CASE WHEN event_type IN ('click', 'purchase') THEN CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'same' WHEN 2 THEN 'changed' END END"


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events play a job's: status and counts after each, and when the job is gone."""
    e = _stream(spark, sf_dir, "events").selectExpr("user_id AS job", "event_id AS seq", "ts", f"{_JOB} AS kind")
    return streams.drain(stateful.job_stream(e), _place(spark)).select("job", "seq", "status", "pages", "errors")


def stream_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events play those of crawls, one after the other; some are given up."""
    e = _stream(spark, sf_dir, "events").selectExpr("'c' || user_id AS crawl", "event_id AS seq", "ts", f"{_CRAWL} AS kind", f"{_CHANGE} AS change")
    return streams.drain(stateful.crawl_stream(e), _place(spark)).select("crawl", "seq", "type", "completed", "total", "changes")


QUERIES = {f.__name__: f for f in (stream_hourly, stream_changes, stream_recent, stream_health, stream_throttle, stream_champions, stream_jobs, stream_crawl)}

#: The watermark that the stream ends with.
_END = "(SELECT epoch_ms(max(ts)) - 600000 FROM events)"

ORACLES = {
    "stream_champions": histories.FOLD.replace("f.has", "(f.has AND epoch_ms(o.ts) - epoch_ms(f.ts) < 1209600000)").replace("SELECT * FROM f WHERE has", f"SELECT * FROM f WHERE has AND epoch_ms(ts) + 1209600000 > {_END}")
    + " SELECT domain, engine, stealth, only_main, round(ewma, 6) AS ewma, samples FROM c",
    "stream_jobs": f"""WITH e AS (SELECT user_id AS job, event_id AS seq, epoch_ms(ts) AS ms, {_JOB} AS kind FROM events),
 s AS (SELECT *, coalesce(ms - lag(ms) OVER w >= 86400000, false)::INT AS brk FROM e WINDOW w AS (PARTITION BY job ORDER BY seq)),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY job ORDER BY seq) AS run FROM s),
 t AS (SELECT *, count(*) FILTER (kind = 'completed') OVER w AS ends, count(*) FILTER (kind = 'completed') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM r WINDOW w AS (PARTITION BY job, run ORDER BY seq)),
 c AS (SELECT *, count(*) FILTER (kind = 'page' AND ended = 0) OVER w AS pages, count(*) FILTER (kind = 'error' AND ended = 0) OVER w AS errors, row_number() OVER (PARTITION BY job, run ORDER BY seq DESC) AS back,
 max(run) OVER (PARTITION BY job) AS last FROM t WINDOW w AS (PARTITION BY job, run ORDER BY seq))
 SELECT job, seq, CASE WHEN ends > 0 THEN 'completed' ELSE 'scraping' END AS status, pages, errors FROM c
 UNION ALL SELECT job, NULL, 'expired', pages, errors FROM c WHERE back = 1 AND (run < last OR ms + 86400000 <= {_END})""",
    "stream_crawl": f"""WITH e AS (SELECT 'c' || user_id AS crawl, event_id AS seq, epoch_ms(ts) AS ms, {_CRAWL} AS kind, {_CHANGE} AS change FROM events),
 s AS (SELECT *, (coalesce(lag(kind) OVER w = 'done', false) OR coalesce(ms - lag(ms) OVER w >= 172800000, false))::INT AS brk FROM e WINDOW w AS (PARTITION BY crawl ORDER BY seq)),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY crawl ORDER BY seq) AS run FROM s),
 c AS (SELECT *, count(*) FILTER (kind = 'found') OVER w AS found, count(*) FILTER (kind IN ('page', 'error')) OVER w AS done, row_number() OVER (PARTITION BY crawl, run ORDER BY seq DESC) AS back, max(run) OVER (PARTITION BY crawl) AS last,
 concat_ws(',', CASE WHEN count(*) FILTER (kind = 'page' AND change = 'changed') OVER w > 0 THEN 'changed:' || count(*) FILTER (kind = 'page' AND change = 'changed') OVER w END,
 CASE WHEN count(*) FILTER (kind = 'page' AND change = 'new') OVER w > 0 THEN 'new:' || count(*) FILTER (kind = 'page' AND change = 'new') OVER w END,
 CASE WHEN count(*) FILTER (kind = 'page' AND change = 'same') OVER w > 0 THEN 'same:' || count(*) FILTER (kind = 'page' AND change = 'same') OVER w END) AS told FROM r WINDOW w AS (PARTITION BY crawl, run ORDER BY seq))
 SELECT crawl, seq, 'mapping' AS type, found AS completed, 0 AS total, NULL AS changes FROM c WHERE kind = 'found'
 UNION ALL SELECT crawl, seq, 'progress', 0, found, NULL FROM c WHERE kind IN ('page', 'error') AND done = 1
 UNION ALL SELECT crawl, seq, kind, done, found, NULL FROM c WHERE kind IN ('page', 'error')
 UNION ALL SELECT crawl, seq, 'progress', done, found, NULL FROM c WHERE kind IN ('page', 'error')
 UNION ALL SELECT crawl, seq, 'complete', done, found, told FROM c WHERE kind = 'done'
 UNION ALL SELECT crawl, NULL, 'error', done, found, told FROM c WHERE back = 1 AND kind <> 'done' AND (run < last OR ms + 172800000 <= {_END})""",
    "stream_health": """WITH e AS (SELECT user_id AS provider, event_id AS seq, CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'empty' ELSE 'success' END AS o FROM events),
 g AS (SELECT *, count(*) FILTER (o <> 'failure') OVER w AS fg, count(*) FILTER (o = 'success') OVER w AS sg FROM e WINDOW w AS (PARTITION BY provider ORDER BY seq)),
 r AS (SELECT *, count(*) FILTER (o = 'failure') OVER (PARTITION BY provider, fg ORDER BY seq) AS failures, count(*) FILTER (o = 'empty') OVER (PARTITION BY provider, sg ORDER BY seq) AS empties FROM g),
 s AS (SELECT *, CASE WHEN o = 'success' THEN 'healthy' WHEN o = 'failure' AND failures >= 3 THEN 'unavailable' WHEN o = 'failure' THEN 'degraded' WHEN empties >= 3 THEN 'degraded' END AS own FROM r),
 p AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY provider ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
 SELECT provider, seq, CASE WHEN o = 'failure' THEN failures ELSE 0 END::BIGINT AS failures, coalesce(own, CASE before WHEN 'unavailable' THEN 'degraded' ELSE before END, 'healthy') AS status FROM p""",
    "stream_throttle": """WITH a AS (SELECT user_id AS host, event_id AS ordinal, (event_id % 50)::DOUBLE AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
 SELECT host, ordinal, round(max(arrival - i * 0.5) OVER (PARTITION BY host ORDER BY ordinal) + i * 0.5, 6) AS granted FROM a""",
    # In append mode an hour is written once the watermark has passed it.
    "stream_hourly": """WITH h AS (SELECT date_trunc('hour', ts) AS hour, CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'scrape' END AS kind, count(*) AS n, count(*) FILTER (event_type <> 'error') AS succeeded FROM events GROUP BY 1, 2)
 SELECT strftime(hour, '%Y-%m-%d %H') AS hour, kind, n, succeeded FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_changes": """WITH v AS (SELECT conv_id AS key, turn AS version, 'v' || (turn // 2) || conv_id AS h, length(text) % 6 <> 0 AS success FROM conversations),
 p AS (SELECT *, (SELECT max(b.version) FROM v b WHERE b.key = v.key AND b.version < v.version AND b.success) AS previous FROM v)
 SELECT p.key, p.version, CASE WHEN NOT p.success THEN CASE WHEN previous IS NOT NULL THEN 'removed' END WHEN previous IS NULL THEN 'new' WHEN b.h = p.h THEN 'same' ELSE 'changed' END AS status
 FROM p LEFT JOIN v b ON b.key = p.key AND b.version = p.previous""",
    "stream_recent": """SELECT user_id AS scope, event_id AS seq, count(*) OVER w = 5 AND count(*) FILTER (event_type IN ('view', 'click', 'error')) OVER w = 5 AS all_recent_empty FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)""",
}
