"""Line dedup by a deletion-neighbourhood join: lines within one edit share a string with one character
deleted; equal variants are joined on hashed keys, the edit distance is verified, the earliest line stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import hot_keys, materialise, own_columns, salted_join, table

#: Lines under so many characters go as equal copies only: among short ones a single edit tells apart list numbers, dates and words.
MIN_EDIT_CHARS = 20
#: Size of the fixed bucket set that thins out rows before a join; it is the bound of what is broadcast.
BUCKETS = 2**18


def _document_key() -> list[Column]:
    """Equal for wholly equal rows only: the id (null: the least) and a hash of id and text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("d_id"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).alias("d_hash"),
    ]


def _lines(docs: DataFrame) -> DataFrame:
    return (
        docs.select(*_document_key(), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .select("d_id", "d_hash", "pos", F.trim("raw").alias("line"))
        .withColumn("n", F.length("line"))
        .where("n > 0")
        .withColumn("h1", F.xxhash64("line"))
        .withColumn("h2", F.xxhash64(F.lit(1), "line"))
    )


def _half_keys() -> Column:
    """One edit leaves the first half or the second half of a line as it was. ``short`` is the length of the shorter line of a
    pair, so a line has keys for its own length and for one less."""
    entries = []
    for less in (0, 1):
        short = F.col("n") - less
        head = (short / 2).cast("int")
        head_text = F.substring("line", F.lit(1), head)
        tail_text = F.substring("line", F.col("n") - (short - head) + 1, short - head)
        for side, text in (("P", head_text), ("S", tail_text)):
            entries.append(
                F.struct(
                    F.xxhash64(F.lit(side), short, text).alias("key"),
                    F.lit(less).alias("less"),
                    F.lit(side).alias("side"),
                    head.alias("head"),
                )
            )
    return F.array(*entries)


def near_lines(lines: DataFrame) -> DataFrame:
    """Per distinct line of ``lines`` with an earlier line within one edit: (h1, h2). Linear: no group is paired with itself.

    Only lines that share an unedited half with another line emit variants, and only variants of the other half. A variant's
    group, those that are one string but for one given character or those that are one string plus one character, is bounded by the
    alphabet and the line's length, not by the table."""
    keys = lines.select("h1", F.explode(_half_keys()).alias("e")).select("h1", F.col("e.key").alias("key"))
    shared = materialise(
        keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    )
    marks = shared.select(F.pmod("key", F.lit(BUCKETS)).alias("mark")).distinct()
    entries = (
        lines.withColumn("e", F.explode(_half_keys()))
        .withColumn("key", F.col("e.key"))
        .withColumn("mark", F.pmod("key", F.lit(BUCKETS)))
        .join(F.broadcast(marks), "mark", "left_semi")
    )
    # Copies of a line are one before they meet the shared halves.
    first = materialise(
        entries.groupBy("key", "h1", "h2")
        .agg(F.min(F.struct("d_id", "d_hash", "pos")).alias("at"), F.first("line").alias("line"), F.first("n").alias("n"), F.first("e").alias("e"))
        .join(shared, "key", "left_semi")
        .withColumn(
            "rest",
            F.when(F.col("e.side") == "P", F.expr("substring(line, e.head + 1)")).otherwise(
                F.expr("left(line, e.head + e.less)")
            ),
        )
    )
    variants = first.select(
        "h1", "h2", "at",
        F.explode(
            F.expr(
                """CASE WHEN e.less = 1
                   THEN transform(sequence(1, length(rest)), i -> named_struct('role', 'b', 'v',
                     xxhash64(key, 'i', concat(left(rest, i - 1), substring(rest, i + 1)))))
                   ELSE concat(
                     array(named_struct('role', 'a', 'v', xxhash64(key, 'i', rest))),
                     transform(sequence(1, length(rest)), i -> named_struct('role', 'c', 'v',
                       xxhash64(key, 's', i, concat(left(rest, i - 1), substring(rest, i + 1))))))
                   END"""
            )
        ).alias("x"),
    ).select("h1", "h2", "at", "x.role", "x.v")
    group = Window.partitionBy("v")
    who = F.struct("at", F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    least = {r: F.min(F.when(F.col("role") == r, who)).over(group) for r in "abc"}
    found = (
        variants.withColumn("a", least["a"]).withColumn("b", least["b"]).withColumn("c", least["c"])
        .withColumn("earlier", F.when(F.col("role") == "a", F.col("b")).when(F.col("role") == "b", F.col("a")).otherwise(F.col("c")))
        .where("earlier.at < at")
        .select("h1", "h2", F.col("earlier.p1").alias("p1"), F.col("earlier.p2").alias("p2"))
        .distinct()
    )
    text = first.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    return (
        found.join(text, ["h1", "h2"])
        .join(text.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("other")), ["p1", "p2"])
        .where("levenshtein(line, other, 1) >= 0")
        .select("h1", "h2")
        .distinct()
    )


def dedup_lines(docs: DataFrame, min_edit_chars: int = MIN_EDIT_CHARS) -> DataFrame:
    """Removes every line that has an equal line, or one within a single edit, earlier in the corpus.

    Earlier is by (doc_id, nulls first; hash of the text; place of the line); lines are compared without their outer blanks;
    blank lines stay; lines under ``min_edit_chars`` characters go for equal lines only. A line within one edit of an earlier one goes even if that one
    goes too. Null or empty text: no lines, nothing removed. Wholly equal rows count as one document and end alike.
    Very long lines are compared whole. Empty table: no rows.
    Returns all columns of ``docs`` with ``text`` cut, and n_lines and n_removed (those names are overwritten).
    """
    columns = own_columns(docs, ("n_lines", "n_removed"))
    lines = _lines(docs)
    spots = lines.select("h1", "h2", "d_id", "d_hash", "pos")
    near = materialise(near_lines(lines.where(F.col("n") >= min_edit_chars)))
    copies = (
        spots.groupBy("h1", "h2")
        .agg(F.min(F.struct("d_id", "d_hash", "pos")).alias("keep"), F.max(F.struct("d_id", "d_hash", "pos")).alias("last"), F.count("*").alias("n"))
        .where("keep < last")
        .select("h1", "h2", "keep", "n")
    )
    judged = materialise(copies.join(near.withColumn("gone", F.lit(True)), ["h1", "h2"], "full_outer"))
    removed = (
        salted_join(spots, judged.drop("n"), ["h1", "h2"], hot=hot_keys(judged, ["h1", "h2"], "n"))
        .where("gone OR keep <> struct(d_id, d_hash, pos)")
        .groupBy(F.col("d_id").alias("__id"), F.col("d_hash").alias("__hash"))
        .agg(F.sort_array(F.collect_set("pos")).alias("__removed"))
    )
    all_lines = F.split("text", "\n")
    keyed = docs.select(*columns, *[k.alias(name) for k, name in zip(_document_key(), ("__id", "__hash"), strict=True)])
    return (
        keyed.join(removed, ["__id", "__hash"], "left")
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long"))
        .withColumn("n_removed", F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).cast("long"))
        .withColumn(
            "text",
            F.when(F.col("__removed").isNull(), F.col("text")).otherwise(
                F.array_join(F.filter(all_lines, lambda line, i: ~F.array_contains("__removed", i)), "\n")
            ),
        )
        .select(*columns, "n_lines", "n_removed")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = """
WITH x AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), l AS (SELECT doc_id, pos, trim(raw) AS line, length(trim(raw)) AS n FROM x WHERE length(trim(raw)) > 0),
d AS (SELECT line, n, min((doc_id, pos)) AS spot FROM l GROUP BY line, n),
k AS (
  SELECT line, n, spot, n - less AS s,
    unnest(['P' || left(line, (n - less) // 2), 'S' || right(line, (n - less) - (n - less) // 2)]) AS part
  FROM d, (VALUES (0), (1)) v(less) WHERE n >= 20
), pairs AS (
  SELECT DISTINCT a.line AS line, a.n AS n, b.line AS other, b.n AS m
  FROM k a JOIN k b ON a.s = b.s AND a.part = b.part AND b.spot < a.spot AND a.line <> b.line AND abs(a.n - b.n) <= 1
), p AS (
  SELECT *, coalesce((SELECT min(i) FROM range(1, least(n, m) + 1) r(i) WHERE line[i] <> other[i]), least(n, m) + 1) AS i
  FROM pairs
), near AS (
  SELECT DISTINCT line FROM p WHERE CASE WHEN n = m THEN substr(line, i + 1) = substr(other, i + 1)
    WHEN n = m + 1 THEN substr(line, i + 1) = substr(other, i) ELSE substr(line, i) = substr(other, i + 1) END
), gone AS (
  SELECT l.doc_id, l.pos FROM l JOIN d USING (line) LEFT JOIN near ON near.line = l.line
  WHERE near.line IS NOT NULL OR (l.doc_id, l.pos) <> d.spot
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(g.n, 0)::BIGINT AS n_removed,
  CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(t.kept, '') END AS text
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS kept FROM x ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
) t ON t.doc_id = d.doc_id
"""
