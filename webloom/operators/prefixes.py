"""Running sums, maxima and last values per key, in slices: no task orders more than a slice of one key's rows, however many it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import written

#: Rows of the table to a slice, and the most slices there are. They decide speed, not results.
ROWS_PER_SLICE, MOST = 1_000_000, 4096


def sliced(rows: DataFrame, order: str, rows_per_slice: int = ROWS_PER_SLICE, folders: bool = False) -> DataFrame:
    """``rows`` with ``slice``, which grows with the numeric column ``order``: cut at its quantiles, so that a slice holds about so many rows of all keys.
    A table of one slice is left as it is; a larger one is written, as each prefix reads it twice, with ``folders`` each slice by itself."""
    n = min(MOST, rows.count() // rows_per_slice + 1)
    if n == 1:
        return rows.withColumn("slice", F.lit(0).alias("slice", metadata={"whole": True}))
    cuts = sorted(set(rows.approxQuantile(order, [k / n for k in range(1, n)], 0.1 / n)))
    return written(rows.withColumn("slice", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order)))), ("slice",) if folders else ())


def prefixes(rows: DataFrame, key: str, order: str, values: dict[str, tuple[str, Column]], itself: bool = True) -> DataFrame:
    """``rows`` of ``sliced`` with, per name, what its value is up to the row within the key: its "sum", its "max", or its "last" that is not null. With ``itself`` the
    row counts too. Within a slice that is a window; what earlier slices leave is one row a key and slice."""
    upto = Window.partitionBy(key, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    own = {"sum": lambda c: F.sum(c).over(upto), "max": lambda c: F.max(c).over(upto), "last": lambda c: F.last(c, ignorenulls=True).over(upto)}
    out = rows.select("*", *[own[kind](c).alias(name) for name, (kind, c) in values.items()])
    if rows.schema["slice"].metadata.get("whole"):
        return out.withColumns({name: F.coalesce(name, F.lit(0)) for name, (kind, _) in values.items() if kind == "sum"})
    whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))}
    left = rows.groupBy(key, "slice").agg(*[whole[kind](c).alias(name) for name, (kind, c) in values.items()])
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = {"sum": lambda c: F.sum(c).over(earlier), "max": lambda c: F.max(c).over(earlier), "last": lambda c: F.last(c, ignorenulls=True).over(earlier)}
    carried = left.select(key, "slice", *[before[kind](F.col(name)).alias(f"__{name}") for name, (kind, _) in values.items()])
    both = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "last": F.coalesce,
    }
    joined = out.join(carried, [key, "slice"])
    return joined.withColumns({name: both[kind](F.col(name), F.col(f"__{name}")) for name, (kind, _) in values.items()}).drop(*[f"__{name}" for name in values])

