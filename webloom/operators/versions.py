"""The page cache and what changed between versions of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.prefixes import ROWS_PER_SLICE, prefixes, sliced


def newest_entries(cache: DataFrame) -> DataFrame:
    """The last version of each key: an upsert-by-append cache as its readers see it."""
    return cache.groupBy("cache_key").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "cache_key"]), "cached_at").alias("r")).select("cache_key", "r.*")


def fresh(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (cache_key, max_age) with the entry that answers them: the newest, unless ``max_age`` is 0 or less or it has expired (age is as stored)."""
    hit = requests.where("max_age > 0").join(newest_entries(cache), "cache_key").where(F.col("expires_at") >= now)
    return hit


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    """entries, expired, valid, size_bytes and the size for people."""
    got = cache.agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") < now).alias("expired"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))
    return got.select("entries", "expired", (F.col("entries") - F.col("expired")).alias("valid"), "size_bytes", human_size(F.col("size_bytes")).alias("size_human"))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB to one decimal."""
    out = F.when(size < 1024, F.concat(F.format_string("%.1f", size.cast("double")), F.lit(" B")))
    for k, unit in enumerate(["KB", "MB", "GB"], 1):
        out = out.when(size < 1024 ** (k + 1), F.concat(F.format_string("%.1f", size / 1024**k), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", size / 1024**4), F.lit(" TB")))


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    """What pruning leaves."""
    return cache.where(F.col("expires_at") >= now)


def change_status(versions: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Per version (key, version, content_hash, success) against the last successful one before it: new, same, changed; removed for a failure after a success.
    A key's versions are read in slices."""
    seen = F.when(F.col("success"), F.struct("content_hash", "version"))
    rows = prefixes(sliced(versions, "version", rows_per_slice), "key", "version", {"p": ("last", seen)}, itself=False)
    status = (
        F.when(~F.col("success"), F.when(F.col("p").isNotNull(), "removed"))
        .when(F.col("p").isNull(), "new")
        .when(F.col("p.content_hash") == F.col("content_hash"), "same")
        .otherwise("changed")
    )
    return rows.select(*versions.columns, F.col("p.version").alias("previous"), status.alias("status"))


def change_summary(statuses: DataFrame) -> DataFrame:
    """How many versions of each status."""
    return statuses.where("status IS NOT NULL").groupBy("status").agg(F.count("*").alias("n"))


def field_changes(previous: Column, current: Column) -> Column:
    """Keys of two string maps whose values differ, with both values; a key that one lacks differs."""
    empty = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce(previous, empty), F.coalesce(current, empty), lambda _, a, b: F.struct(a.alias("previous"), b.alias("current")))
    return F.map_filter(both, lambda _, v: ~v["previous"].eqNullSafe(v["current"]))
