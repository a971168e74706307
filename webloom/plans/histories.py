"""Queries over event logs and version histories; events play telemetry, conversations play page versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import edits
from webloom.operators import folds, telemetry, versions
from webloom.session import table

_LOG = """event_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'scrape' END AS kind,
 CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'site' || user_id % 40 || '.example' END AS domain, event_type <> 'error' AS success,
 CASE event_type WHEN 'error' THEN 'bot_challenge' WHEN 'signup' THEN NULL ELSE 'ok' END AS verdict, value > 60 AS escalated, value AS latency_ms"""
OBSERVED = """'d' || user_id % 60 AS domain, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'camoufox' WHEN 1 THEN 'playwright' END AS engine, event_id % 2 = 0 AS stealth,
 1000 AS wait_for, event_id % 5 <> 0 AS only_main, CASE event_type WHEN 'error' THEN 'captcha' WHEN 'view' THEN 'thin' ELSE 'ok' END AS verdict,
 CAST(event_id % 67 + 34 AS INT) AS score, ts"""
_OUTCOMES = "'p' || user_id % 30 AS provider, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'failure' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'empty' ELSE 'success' END AS outcome"
SINCE = "2024-01-15 00:00:00"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*columns(_LOG))


def columns(text: str) -> list[str]:
    """Splits a select list at its outer commas."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def telemetry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.events(log(spark, sf_dir), "scrape", SINCE).groupBy("domain").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.summary(telemetry.events(log(spark, sf_dir), since=SINCE))


def telemetry_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.top(log(spark, sf_dir), "domain", 10)


def telemetry_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.top(log(spark, sf_dir), "verdict")


def telemetry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def telemetry_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.newest(log(spark, sf_dir), 20).select("event_id", "kind", "domain")


def telemetry_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.prune(log(spark, sf_dir), SINCE, 2500).agg(F.count("*").alias("kept"), F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"))


def telemetry_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.stream_batches(log(spark, sf_dir), "engine")
    first = F.element_at("values", 1)[0]
    return out.select(
        "kind", F.col("batch").cast("long").alias("batch"), "n", first.alias("first_ns"), F.element_at("values", -1)[0].alias("last_ns"),
        F.md5(F.array_join(F.transform("values", lambda v: F.concat(v[0], F.lit(" "), F.get_json_object(v[1], "$.event_id"), F.lit(" "), F.get_json_object(v[1], "$.kind"))), ",")).alias("lines"),
    )


def telemetry_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("query"))
    return telemetry.private(pages, url="url", query="query").select("page_id", "domain", "query_hash")


def fold_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = folds.champions(table(spark, sf_dir, "events").selectExpr(*columns(OBSERVED)))
    return c.select("domain", "engine", "stealth", "only_main", F.round("ewma", 6).alias("ewma"), F.col("samples").cast("long").alias("samples"))


def fold_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = folds.champions(table(spark, sf_dir, "events").selectExpr(*columns(OBSERVED)))
    return folds.seeds(c, F.lit("2024-02-12 00:00:00").cast("timestamp")).select("domain", "engine", "stealth", "only_main")


def fold_provider_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.provider_health(table(spark, sf_dir, "events").selectExpr(*columns(_OUTCOMES))).select("provider", "seq", "failures", "empties", "status")


def fold_recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), F.col("event_type").isin("view", "click", "error").alias("empty"))
    return folds.recent_window(searches)


def fold_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = table(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), F.col("user_id") % 20).alias("host"), F.col("event_id").alias("ordinal"), (F.col("event_id") * 0.5).cast("double").alias("arrival"),
        (F.col("user_id") % 20 + 2.0).cast("double").alias("delay"),
    )
    return folds.throttle(arrivals).select("host", "ordinal", F.round("granted", 6).alias("granted"))


def fold_best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request"), F.col("l_linenumber").cast("int").alias("attempt"), (F.col("l_returnflag") != "R").alias("success"), F.col("l_quantity").cast("int").alias("score")
    )
    return folds.best_attempts(attempts)


def fold_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").cast("int").alias("attempt"), (F.col("l_returnflag") == "A").alias("success"))
    return folds.retries(attempts, 3)


def fold_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("search"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("position"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("provider"),
        F.when(F.col("l_quantity") % 5 == 0, "results").when(F.col("l_quantity") % 5 < 3, "empty").when(F.col("l_quantity") % 2 == 0, "hard_error").otherwise("fallback_error").alias("outcome"),
        # Lines of one number and part are calls at one position; they were made in the table's order.
        F.struct("_metadata.file_path", "_metadata.row_index").alias("row"),
    )
    return folds.fallback_chain(calls)


def fold_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % 5).cast("int").alias("level"), F.when(F.col("event_type") == "error", "bot_challenge").when(F.col("event_type") == "view", "js_shell").otherwise("ok").alias("verdict"),
        (F.col("user_id") % 4 != 0).alias("expect_met"), (F.col("user_id") % 11 == 0).alias("http2_error"), (F.col("event_id") % 7 != 0).alias("has_response"),
    )
    return folds.escalations(attempts).select("event_id", "escalate")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's user turns as versions of a page; a third of them repeat the turn before."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("key"), F.col("turn").alias("version"), F.sha2(F.concat(F.lit("v"), F.floor(F.col("turn") / 2).cast("string"), F.col("conv_id").cast("string")), 256).alias("content_hash"),
        (F.length("text") % 6 != 0).alias("success"), "text",
    )


def change_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.change_status(_versions(spark, sf_dir).drop("text")).select("key", "version", "previous", "status")


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.change_summary(versions.change_status(_versions(spark, sf_dir).drop("text")))


def change_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    pairs = v.alias("a").join(v.alias("b"), F.expr("a.key = b.key AND a.version + 1 = b.version"))
    return pairs.select(F.col("b.key"), F.col("b.version"), edits.unified_diff(F.col("a.text"), F.col("b.text")).alias("diff"))


#: A document's lines by their first two letters, so that many are equal, and an edited copy of them: lines gone, doubled and moved.
_LINES = "transform(split(text, '\n'), l -> left(l, 2))"
_EDITED = """flatten(transform(sequence(1, size(a)), k -> CASE (doc_id + k * k) % 6 WHEN 0 THEN array() WHEN 1 THEN array(a[k - 1], a[k - 1]) WHEN 2 THEN array('+' || a[k - 1]) WHEN 3 THEN array(a[size(a) - k]) ELSE array(a[k - 1]) END))"""


def change_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a shortest edit script between a document's lines and an edited copy of them removes and adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_LINES).alias("a"))
    texts = docs.select("doc_id", *[F.concat(F.array_join(c, "\n"), F.lit("\n")).alias(n) for c, n in ((F.col("a"), "old"), (F.expr(_EDITED), "new"))])
    return texts.select("doc_id", edits.edit_sizes(F.col("old"), F.col("new")).alias("e")).select("doc_id", "e.removed", "e.added")


def change_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-level changes between an order and the one before it of the customer."""
    fields = F.create_map(F.lit("status"), F.col("o_orderstatus").cast("string"), F.lit("priority"), F.col("o_orderpriority").cast("string"))
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", fields.alias("f")).withColumn("p", F.lag("f").over(w))
    return o.where("p IS NOT NULL").select("o_orderkey", F.explode(versions.field_changes(F.col("p"), F.col("f"))).alias("field", "v")).select("o_orderkey", "field", "v.previous", "v.current")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("k"), F.col("o_custkey") % 700).alias("cache_key"), F.col("o_orderdate").cast("timestamp").alias("cached_at"), F.col("o_orderkey").alias("entry"),
        (F.col("o_orderdate").cast("timestamp") + F.make_interval(days=(F.col("o_orderkey") % 300 + 1).cast("int"))).alias("expires_at"), F.col("o_totalprice").cast("long").alias("size"),
    )


_NOW = "1997-06-01 00:00:00"


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.cache_stats(_cache(spark, sf_dir), F.lit(_NOW).cast("timestamp"))


def cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey")).alias("cache_key"), (F.col("c_custkey") % 3).alias("max_age"))
    newest = _cache(spark, sf_dir).withColumn("cached_at", F.struct("cached_at", "entry"))
    return versions.fresh(requests, newest, F.lit(_NOW).cast("timestamp")).select("cache_key", "entry")


def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.unexpired(_cache(spark, sf_dir), F.lit(_NOW).cast("timestamp")).groupBy("cache_key").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    telemetry_events, telemetry_summary, telemetry_top_domains, telemetry_by_verdict, telemetry_kinds, telemetry_tail, telemetry_prune, telemetry_payload, telemetry_private,
    fold_champions, fold_seeds, fold_provider_health, fold_recent_window, fold_throttle, fold_best_attempts, fold_retries, fold_fallback_chain, fold_escalations,
    change_tracking, change_summary, change_diff, change_edits, change_fields, cache_stats, cache_fresh, cache_prune,
)}

_L = f"WITH l AS (SELECT {_LOG} FROM events)"
# The champion fold as a recursion over each domain's numbered observations.
FOLD = f"""WITH RECURSIVE o0 AS (SELECT {OBSERVED} FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS i,
 CASE WHEN engine IS NULL OR engine = 'playwright' THEN stealth::INT ELSE 2 END AS cost FROM o0),
 f(domain, i, has, engine, stealth, only_main, ewma, samples, ts, cost) AS (
  SELECT domain, 0::BIGINT, false, NULL::VARCHAR, false, false, 0.0::DOUBLE, 0::BIGINT, NULL::TIMESTAMP, 0 FROM (SELECT DISTINCT domain FROM o)
  UNION ALL
  SELECT f.domain, o.i, x.c NOT IN ('drop', 'none'), CASE x.c WHEN 'new' THEN o.engine ELSE f.engine END, CASE x.c WHEN 'new' THEN o.stealth ELSE f.stealth END,
   CASE x.c WHEN 'new' THEN o.only_main ELSE f.only_main END, CASE x.c WHEN 'new' THEN o.score::DOUBLE WHEN 'same' THEN 0.5 * o.score + 0.5 * f.ewma ELSE f.ewma END,
   CASE x.c WHEN 'new' THEN 1 WHEN 'same' THEN f.samples + 1 ELSE f.samples END, CASE WHEN x.c IN ('new', 'same') THEN o.ts ELSE f.ts END, CASE x.c WHEN 'new' THEN o.cost ELSE f.cost END
  FROM f JOIN o ON o.domain = f.domain AND o.i = f.i + 1,
  LATERAL (SELECT CASE WHEN o.verdict = 'captcha' THEN CASE WHEN f.has AND f.engine IS NOT DISTINCT FROM o.engine AND f.stealth = o.stealth THEN 'drop' WHEN f.has THEN 'keep' ELSE 'none' END
   WHEN o.verdict <> 'ok' OR o.score < 40 THEN CASE WHEN f.has THEN 'keep' ELSE 'none' END WHEN NOT f.has THEN 'new'
   WHEN f.engine IS NOT DISTINCT FROM o.engine AND f.stealth = o.stealth THEN 'same'
   WHEN (o.cost < f.cost AND o.score >= f.ewma - 5) OR o.score > f.ewma + 5 THEN 'new' ELSE 'keep' END AS c) x),
 c AS (SELECT * FROM f WHERE has QUALIFY row_number() OVER (PARTITION BY domain ORDER BY i DESC) = 1 AND i = (SELECT max(i) FROM o WHERE o.domain = f.domain))"""
_HEALTH = f"""WITH RECURSIVE o0 AS (SELECT {_OUTCOMES} FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY seq) AS i FROM o0),
 h(provider, i, seq, failures, empties, status) AS (SELECT DISTINCT provider, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 'healthy' FROM o
 UNION ALL SELECT o.provider, o.i, o.seq, CASE o.outcome WHEN 'failure' THEN failures + 1 ELSE 0 END, CASE o.outcome WHEN 'success' THEN 0 WHEN 'empty' THEN empties + 1 ELSE empties END,
 CASE o.outcome WHEN 'success' THEN 'healthy' WHEN 'failure' THEN CASE WHEN failures + 1 >= 3 THEN 'unavailable' ELSE 'degraded' END
  ELSE CASE WHEN empties + 1 >= 3 OR status = 'unavailable' THEN 'degraded' ELSE status END END FROM h JOIN o ON o.provider = h.provider AND o.i = h.i + 1)"""
_V = "WITH v AS (SELECT conv_id AS key, turn AS version, 'v' || (turn // 2) || conv_id AS h, length(text) % 6 <> 0 AS success FROM conversations)"
_T = f"""{_V}, p AS (SELECT *, (SELECT max(b.version) FROM v b WHERE b.key = v.key AND b.version < v.version AND b.success) AS previous FROM v),
 s AS (SELECT p.*, CASE WHEN NOT p.success THEN CASE WHEN previous IS NOT NULL THEN 'removed' END WHEN previous IS NULL THEN 'new' WHEN b.h = p.h THEN 'same' ELSE 'changed' END AS status
 FROM p LEFT JOIN v b ON b.key = p.key AND b.version = p.previous)"""
_C = """WITH c AS (SELECT 'k' || o_custkey % 700 AS cache_key, o_orderdate::TIMESTAMP AS cached_at, o_orderkey AS entry, o_orderdate::TIMESTAMP + to_days((o_orderkey % 300 + 1)::INT) AS expires_at,
 trunc(o_totalprice)::BIGINT AS size FROM orders)"""

ORACLES = {
    "telemetry_events": f"{_L} SELECT domain, count(*) AS n, min(event_id) AS first FROM l WHERE kind = 'scrape' AND ts >= '{SINCE}' GROUP BY 1",
    "telemetry_summary": f"""{_L} SELECT count(*) FILTER (kind = 'scrape') AS scrapes, count(*) FILTER (kind = 'search') AS searches,
 round((count(*) FILTER (kind = 'scrape' AND success)) / (count(*) FILTER (kind = 'scrape')), 3) AS success_rate,
 round((count(*) FILTER (kind = 'scrape' AND escalated)) / (count(*) FILTER (kind = 'scrape')), 3) AS escalation_rate FROM l WHERE ts >= '{SINCE}'""",
    "telemetry_top_domains": f"{_L} SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n FROM l WHERE kind = 'scrape' GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 10",
    "telemetry_by_verdict": f"{_L} SELECT coalesce(verdict, 'unknown') AS verdict, count(*) AS n FROM l WHERE kind = 'scrape' GROUP BY 1",
    "telemetry_kinds": f"{_L} SELECT kind, count(*) AS n FROM l GROUP BY 1",
    "telemetry_tail": f"{_L} SELECT event_id, kind, domain FROM l ORDER BY event_id DESC LIMIT 20",
    "telemetry_prune": f"{_L}, k AS (SELECT * FROM l WHERE ts >= '{SINCE}' ORDER BY event_id DESC LIMIT 2500) SELECT count(*) AS kept, min(event_id) AS oldest, max(event_id) AS newest FROM k",
    "telemetry_payload": f"""{_L}, r AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) - 1) // 500 AS batch FROM l)
 SELECT kind, batch, count(*) AS n, min(epoch_us(ts))::VARCHAR || '000' AS first_ns, max(epoch_us(ts))::VARCHAR || '000' AS last_ns,
 md5(string_agg(epoch_us(ts)::VARCHAR || '000 ' || event_id || ' ' || kind, ',' ORDER BY ts, event_id)) AS lines FROM r GROUP BY 1, 2""",
    "telemetry_private": r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS domain,
 substr(sha256(regexp_extract(html, '<title>(.*?)</title>', 1)), 1, 12) AS query_hash FROM pages""",
    "fold_champions": f"{FOLD} SELECT domain, engine, stealth, only_main, round(ewma, 6) AS ewma, samples FROM c",
    "fold_seeds": f"{FOLD} SELECT domain, engine, stealth, only_main FROM c WHERE ts >= TIMESTAMP '2024-02-12 00:00:00' - INTERVAL 14 DAY",
    "fold_provider_health": f"{_HEALTH} SELECT provider, seq, failures, empties, status FROM h WHERE i > 0",
    "fold_recent_window": """WITH s AS (SELECT user_id AS scope, event_id AS seq, count(*) OVER w AS recent, count(*) FILTER (event_type IN ('view', 'click', 'error')) OVER w AS recent_empty FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)) SELECT scope, seq, recent, recent_empty, recent = 5 AND recent_empty = 5 AS all_recent_empty FROM s""",
    "fold_throttle": """WITH RECURSIVE a AS (SELECT 'h' || user_id % 20 AS host, event_id AS ordinal, event_id * 0.5::DOUBLE AS arrival, (user_id % 20 + 2.0)::DOUBLE AS delay,
 row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i FROM events), g(host, i, ordinal, granted) AS (SELECT host, i, ordinal, arrival FROM a WHERE i = 1
 UNION ALL SELECT a.host, a.i, a.ordinal, greatest(a.arrival, g.granted + a.delay) FROM g JOIN a ON a.host = g.host AND a.i = g.i + 1) SELECT host, ordinal, round(granted, 6) AS granted FROM g""",
    "fold_best_attempts": """SELECT l_orderkey AS request, l_linenumber::INT AS attempt, l_returnflag <> 'R' AS success, l_quantity::INT AS score, (max(l_linenumber) OVER w1)::INT AS attempts, max(l_linenumber) OVER w1 > 1 AS escalated FROM lineitem
 WINDOW w1 AS (PARTITION BY l_orderkey) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R' DESC, l_quantity DESC, l_linenumber DESC) = 1""",
    "fold_retries": """WITH a AS (SELECT l_orderkey AS request, min(l_linenumber) FILTER (l_returnflag = 'A') AS f, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
 SELECT request, least(coalesce(f, 3), 3, n)::INT AS made, coalesce(f <= 3, false) AS success FROM a""",
    "fold_fallback_chain": """WITH c AS (SELECT l_orderkey AS search, l_linenumber::BIGINT * 1000000 + l_partkey AS position, 's' || l_suppkey AS provider, CASE WHEN l_quantity % 5 = 0 THEN 'results' WHEN l_quantity % 5 < 3 THEN 'empty'
 WHEN l_quantity % 2 = 0 THEN 'hard_error' ELSE 'fallback_error' END AS outcome FROM lineitem), m AS (SELECT *, min(position) FILTER (outcome IN ('results', 'hard_error')) OVER (PARTITION BY search) AS stop FROM c),
 t AS (SELECT * FROM m WHERE stop IS NULL OR position <= stop), b AS (SELECT search, max(position) AS tried, max(provider) FILTER (outcome = 'results') AS got, arg_min(provider, position) FILTER (outcome = 'empty') AS banked FROM t GROUP BY 1)
 SELECT search, CASE WHEN got IS NOT NULL THEN 'results' WHEN banked IS NOT NULL THEN 'empty' ELSE 'error' END AS answer, coalesce(got, banked) AS provider, tried FROM b""",
    "fold_escalations": """SELECT event_id, (user_id % 11 = 0 OR (event_id % 7 <> 0 AND (event_type IN ('error', 'view') OR user_id % 4 = 0))) AND event_id % 5 < 3 AS escalate FROM events""",
    "change_tracking": f"{_T} SELECT key, version, previous, status FROM s",
    # The length of a longest common subsequence, a row of its table at a time.
    "change_edits": """WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: left(l, 2)) AS a FROM documents),
 e AS (SELECT doc_id, a, flatten(list_transform(range(1, len(a) + 1), lambda k: CASE (doc_id + k * k) % 6 WHEN 0 THEN [] WHEN 1 THEN [a[k], a[k]] WHEN 2 THEN ['+' || a[k]] WHEN 3 THEN [a[len(a) - k + 1]] ELSE [a[k]] END)) AS b FROM d),
 -- An empty copy still has its last line's end.
 f AS (SELECT doc_id, a, CASE WHEN len(b) = 0 THEN [''] ELSE b END AS b FROM e),
 r AS (SELECT doc_id, a, b, 0 AS i, list_transform(b, lambda x: 0) AS t FROM f
 UNION ALL SELECT doc_id, a, b, i + 1, list_transform(range(1, len(u) + 1), lambda j: list_max(u[1:j])) FROM
 (SELECT *, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN a[i + 1] = b[j] THEN greatest(t[j], 1 + CASE WHEN j > 1 THEN t[j - 1] ELSE 0 END) ELSE t[j] END) AS u FROM r WHERE i < len(a)))
 SELECT doc_id, (len(a) - t[len(b)])::BIGINT AS removed, (len(b) - t[len(b)])::BIGINT AS added FROM r WHERE i = len(a)""",
    "change_summary": f"{_T} SELECT status, count(*) AS n FROM s WHERE status IS NOT NULL GROUP BY 1",
    "change_fields": """WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0, lag(o_orderkey) OVER w AS k0 FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_orderkey, 'status' AS field, s0 AS previous, s AS current FROM o WHERE k0 IS NOT NULL AND s0 <> s
 UNION ALL SELECT o_orderkey, 'priority', p0, p FROM o WHERE k0 IS NOT NULL AND p0 <> p""",
    "cache_stats": f"""{_C}, a AS (SELECT count(*) AS entries, count(*) FILTER (expires_at < '{_NOW}') AS expired, sum(size)::BIGINT AS size_bytes FROM c)
 SELECT entries, expired, entries - expired AS valid, size_bytes, CASE WHEN size_bytes < 1073741824 THEN format('{{:.1f}} MB', size_bytes / 1048576.0) WHEN size_bytes < 1099511627776 THEN format('{{:.1f}} GB', size_bytes / 1073741824.0) ELSE format('{{:.1f}} TB', size_bytes / 1099511627776.0) END AS size_human FROM a""",
    "cache_fresh": f"""{_C}, n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, entry DESC) = 1)
 SELECT cache_key, entry FROM n JOIN (SELECT 'k' || c_custkey AS cache_key FROM customer WHERE c_custkey % 3 > 0) r USING (cache_key) WHERE expires_at >= '{_NOW}'""",
    "cache_prune": f"{_C} SELECT cache_key, count(*) AS n FROM c WHERE expires_at >= '{_NOW}' GROUP BY 1",
}
