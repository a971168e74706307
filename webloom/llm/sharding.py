"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are
range-partitioned by them, and the ranges that hold a shard boundary are subdivided exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import materialise, table

#: The ranges' key: documents of one text lie together; equal texts are divided by id, equal ids by a draw.
KEY = ("k_text", "k_id", "k_draw")


def _struct_literal(row) -> str:
    text = "CAST(NULL AS STRING)" if row[0] is None else f"'{row[0]}'"
    number = "CAST(NULL AS BIGINT)" if row[1] is None else f"CAST({row[1]} AS BIGINT)"
    return f"named_struct('k_text', {text}, 'k_id', {number}, 'k_draw', CAST({row[2]} AS INT))"


def _below_or_at(splitters: list) -> str:
    """SQL for how many of the sorted ``splitters`` are at or below the row's key, found in two steps of about
    the square root of their number."""
    if not splitters:
        return "0"
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    heads = ", ".join(_struct_literal(b[0]) for b in blocks)
    fine = ", ".join(f"array({', '.join(map(_struct_literal, b))})" for b in blocks)
    coarse = f"size(filter(array({heads}), s -> s <= k))"
    return (
        f"CASE WHEN {coarse} = 0 THEN 0 ELSE ({coarse} - 1) * {step} + "
        f"size(filter(element_at(array({fine}), {coarse}), s -> s <= k)) END"
    )


def _subdivided(ranged: DataFrame, overfull: list[int], rows_per_range: int, samples_per_range: int, seed: int) -> DataFrame:
    """``ranged`` with the number ``sub`` of the part that a row has in its range: 0 but for ``overfull`` ranges, which splitters of their own, taken
    from a further sample within them, cut into parts of about ``rows_per_range``. One splitter for that many rows is broadcast."""
    if not overfull:
        return ranged.withColumn("sub", F.lit(0))
    drawn = ranged.where(F.col("range").isin(overfull) & (F.rand(seed) < samples_per_range / rows_per_range))
    every = F.filter(F.sort_array(F.collect_set("k")), lambda _, i: i % samples_per_range == samples_per_range - 1)
    cuts = materialise(drawn.groupBy("range").agg(every.alias("cuts")))
    return ranged.join(F.broadcast(cuts), "range", "left").withColumn("sub", F.coalesce(F.size(F.filter("cuts", lambda s: s <= F.col("k"))), F.lit(0))).drop("cuts")


def _starts(ranged: DataFrame, shards: int, total: int) -> DataFrame:
    """One row a (range, sub): the bytes and rows before it, and whether a shard may begin in it. The totals are added up before the shuffle; the one task that
    orders them sees a row for each range."""
    totals = ranged.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    in_order = Window.orderBy("range", "sub")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    known = totals.select(
        "range", "sub", "b", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before")
    )
    first = F.ceil(F.col("bytes_before").cast("decimal(38,0)") * shards / F.lit(total))
    cut = first * total < (F.col("bytes_before") + F.col("b")) * shards
    # The row that reaches over a boundary may be a range's last; the shard's first row is then in the next.
    holding = F.coalesce(cut, F.lit(False)) | F.coalesce(F.lag("cut").over(in_order), F.lit(False))
    return materialise(known.withColumn("cut", cut).withColumn("holding", holding).drop("b", "cut"))


def shard_by_size(
    docs: DataFrame, shards: int = 16, ranges_per_shard: int = 32, samples_per_range: int = 8, seed: int = 7, rows_per_range: int = 1_000_000
) -> DataFrame:
    """Deals documents to ``shards`` shards of near equal bytes and numbers them gaplessly within each.

    Rows are ordered by (md5 of the text, doc_id, a seeded draw); shard ``s`` holds the rows whose bytes before them
    in that order lie in ``[s, s + 1) * total / shards``, so shards differ by one record's size at most.
    ``shards * ranges_per_shard`` ranges are cut at quantiles of a size-weighted sample (about
    ``samples_per_range`` keys a range reach the driver, whatever the input's size). Ranges with more than
    ``rows_per_range`` rows are subdivided by a sample of their own, so that no task orders more than about that many rows; only the ranges in which a shard
    begins are ordered to find its first row.

    Null text: size 1 and a null key, ordered first. Empty text: size 1. Very long text: whole. Null doc_id: ordered before others
    of its text. Repeated rows are told apart by the draw; which of two wholly equal rows comes first is open.
    A text larger than a shard's share lies whole in one shard. Empty table: no rows. Extra columns are ignored.
    Returns doc_id, size, text_crc32, shard, slot.
    """
    base = materialise(
        docs.select("doc_id", "text")
        .withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
        .withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
        .select(
            "doc_id", "size", "text_crc32",
            F.md5("text").alias("k_text"),
            F.col("doc_id").cast("long").alias("k_id"),
            F.floor(F.rand(seed) * 2**20).cast("int").alias("k_draw"),
        )
    )
    total = base.agg(F.sum("size")).first()[0]
    if not total:
        return base.select(
            "doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")
        )
    ranges = shards * ranges_per_shard
    rate = ranges * samples_per_range / total
    drawn = sorted(
        base.where(F.rand(seed + 1) < F.col("size") * rate)
        .select(*KEY, F.greatest(F.col("size") * rate, F.lit(1.0)).alias("weight"))
        .collect(),
        key=lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0), r[2]),
    )
    splitters, filled, per = [], 0.0, sum(r.weight for r in drawn) / ranges
    for r in drawn:
        filled += r.weight
        if filled >= per:
            filled -= per * int(filled / per)
            if not splitters or tuple(splitters[-1]) != tuple(r)[:3]:
                splitters.append(tuple(r)[:3])
    keyed = base.withColumn("k", F.struct(*KEY))
    ranged = keyed.withColumn("range", F.expr(_below_or_at(splitters)))
    overfull = [r["range"] for r in ranged.groupBy("range").count().where(F.col("count") > rows_per_range).collect()]
    ranged = _subdivided(ranged, overfull, rows_per_range, samples_per_range, seed + 2)
    starts = _starts(ranged, shards, total)
    in_order = Window.partitionBy("range", "sub").orderBy("k")
    sized = (
        ranged.join(F.broadcast(starts.where("holding")), ["range", "sub"])
        .withColumn("at", F.col("bytes_before") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rank", F.col("rows_before") + F.row_number().over(in_order) - 1)
        .withColumn("part", F.expr(f"CAST(CAST(at AS DECIMAL(38,0)) * {shards} DIV {total} AS INT)"))
    )
    firsts = {r.part: r for r in sized.groupBy("part").agg(F.min_by(F.struct("k", "rank"), "rank").alias("f")).collect()}
    begun, cuts, offsets = [], [], []
    for part in sorted(firsts):
        begun.append(part)
        cuts.append(tuple(firsts[part].f.k))
        offsets.append(firsts[part].f.rank)
    # A shard that no row falls into (fewer rows than shards, or one text larger than a share) begins nowhere.
    known = F.expr(_below_or_at(cuts)) if len(cuts) > 1 else F.lit(1)
    at = F.greatest(known, F.lit(1)) - 1
    return (
        ranged.join(F.broadcast(starts.drop("holding")), ["range", "sub"])
        .withColumn("at", at)
        .withColumn("rank", F.col("rows_before") + F.row_number().over(in_order) - 1)
        .select(
            "doc_id", "size", "text_crc32",
            F.element_at(F.array(*map(F.lit, begun)), (F.col("at") + 1).cast("int")).cast("int").alias("shard"),
            (F.col("rank") - F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in offsets]), (F.col("at") + 1).cast("int"))).cast("long").alias("slot"),
        )
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = shard_by_size(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP8_SQL = """
WITH RECURSIVE tab AS (
  SELECT i, 0 AS step, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM tab WHERE step < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE step = 8),
d AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), o AS (
  SELECT *, sum(size) OVER (ORDER BY md5(text) NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING) - size AS bytes_before,
    row_number() OVER (ORDER BY md5(text) NULLS FIRST, doc_id) - 1 AS place,
    sum(size) OVER () AS total
  FROM d
), s AS (SELECT *, (bytes_before * 16 // total)::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM s, crc
"""
