"""Files the engine reads: event logs, url lists, map files, corpora, PDFs; always with a schema, bad lines set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scrape and search events share one log.
EVENTS = (
    "schema INT, kind STRING, ts STRING, domain STRING, success BOOLEAN, verdict STRING, score INT, attempts INT, escalated BOOLEAN, word_count INT, "
    "status_code INT, cache_hit BOOLEAN, latency_ms BIGINT, url STRING, provider STRING, result_count INT, query_hash STRING, query STRING, _corrupt_record STRING"
)
MAP_ENTRIES = ("url STRING, title STRING, description STRING, allowed BOOLEAN, included BOOLEAN, _corrupt_record STRING")
CASES = (
    "id STRING, url STRING, category STRING, title STRING, why STRING, js_heavy BOOLEAN, spa BOOLEAN, antibot BOOLEAN, content_type STRING, difficulty INT, "
    "probes ARRAY<STRING>, stable BOOLEAN, scored BOOLEAN, expect ARRAY<STRING>, expect_absent ARRAY<STRING>"
)


def read_events(spark: SparkSession, path: str, kind: str | None = None, since: str | None = None) -> DataFrame:
    """An event log of JSON lines; blank and broken ones are left out."""
    from webloom.operators.telemetry import events

    rows = spark.read.schema(EVENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # Spark refuses a plan that reads only the corrupt column; kind is read along.
    return events(rows.where(F.col("_corrupt_record").isNull() & F.col("kind").isNotNull()).drop("_corrupt_record"), kind, since)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file, one a line; blank lines and those that begin with # are left out."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_map(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Map entries of a JSON array or of JSON lines; without ``multi_line`` the first character that is not blank decides."""
    if multi_line is None:
        head = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
        multi_line = bool(head and head.c == "[")
    rows = spark.read.schema(MAP_ENTRIES).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col("url").isNotNull()).drop("_corrupt_record")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases of a YAML file, which Spark reads and the driver parses: a corpus is small by nature. A case is scored if so marked, else if stable."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    cases = (yaml.safe_load(text.value) or {}).get("cases", []) if text else []
    schema = T.StructType.fromDDL(CASES)
    frame = spark.createDataFrame([tuple(c.get(f.name) for f in schema) for c in cases], schema)
    return frame.withColumn("is_scored", F.coalesce("scored", "stable", F.lit(True)))


def read_pdfs(spark: SparkSession, path: str, limit: int = 50 * 2**20) -> DataFrame:
    """(path, length, content, is_pdf) of binary files up to ``limit`` bytes; a PDF names itself in its first 1024 bytes."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    return files.select("path", "length", "content", F.contains(head, F.lit("%PDF-")).alias("is_pdf"))


def is_pdf_url(url: str) -> F.Column:
    from webloom.functions.urls import part

    return F.lower(part(F.col(url), 3)).endswith(".pdf")
