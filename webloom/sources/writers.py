"""Files the engine writes; every task writes its own rows, through Spark's writers only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to a log of JSON lines; absent fields are left out."""
    events.write.mode("append").json(path)


def write_map(urls: DataFrame, path: str, as_json: bool = True) -> None:
    """Map results as JSON lines, or as one url a line."""
    if as_json:
        urls.write.mode("overwrite").json(path)
    else:
        urls.select("url").write.mode("overwrite").text(path)


def write_run(cases: DataFrame, run_id: str, path: str) -> None:
    """A benchmark run: a row a case under metrics, a row for the run under index, both by run; and runs/<id>.json, the run's roll-up and that of each category."""
    from webloom.operators.benchmark import aggregate_run
    from webloom.operators.outputs import write_files

    cases.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(f"{path}/metrics")
    rolled = aggregate_run(cases)
    rolled.where("category IS NULL").drop("category").withColumn("run_id", F.lit(run_id)).write.mode("append").json(f"{path}/index")
    figures = F.struct(*[c for c in rolled.columns if c != "category"])
    overall = F.max(F.when(F.col("category").isNull(), figures)).alias("overall")
    categories = F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", *[c for c in rolled.columns if c != "category"])))).alias("categories")
    whole = rolled.agg(overall, categories).select(F.to_json(F.struct(F.lit(run_id).alias("run_id"), "overall", "categories")).alias("content"))
    write_files(whole.select(F.lit(f"{run_id}.json").alias("file"), "content"), f"{path}/runs")


def list_runs(index: DataFrame, n: int | None = None) -> DataFrame:
    """Run ids, latest first."""
    ids = index.select("run_id").distinct().orderBy(F.desc("run_id"))
    return ids if n is None else ids.limit(n)


def upsert_cache(entries: DataFrame, path: str) -> None:
    """Adds cache entries by the first two digits of their key; readers take the newest of a key."""
    entries.withColumn("prefix", F.substring("cache_key", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
