"""Quality rules by cross-document line frequency: lines that too many documents of a host share are boilerplate;
a document that consists mostly of them is rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import hot_keys, materialise, salted_join, small_batches, table

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\r\x0b\x0c"
_FACTORS = (np.random.default_rng(5).integers(1, 2**63, 5).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def repeated_words(words: list[bytes], span: int = 5) -> int:
    """How many words lie in a ``span``-word window that is found twice or more in the text."""
    n = len(words)
    if n <= span:
        return 0
    word = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    window = word[: n - span + 1] * _FACTORS[0]
    for k in range(1, span):
        window += word[k : n - span + 1 + k] * _FACTORS[k]
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(window, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + span, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def text_figures(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and per distinct normalised line its hash and how
    many words it has in the text."""
    text = text or ""
    words = text.encode().split()
    seen, dup, lines = set(), 0, {}
    for line in text.split("\n"):
        own = line.encode().lower().split()
        if own:
            dup += line in seen
            seen.add(line)
            h = xxhash.xxh64_intdigest(b" ".join(own)) - 2**63
            lines[h] = lines.get(h, 0) + len(own)
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        list(lines),
        list(lines.values()),
    )


def document_figures(docs: DataFrame) -> DataFrame:
    """``text_figures`` of every document beside its id, host and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(map(text_figures, batch.column(3).to_pylist()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.list_(pa.int64())) for c in columns[5:]]],
                names=names,
            )

    names = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"]
    rows = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        "text",
    )
    schema = "doc_id long, host string, text_hash long, " + ", ".join(f"{n} long" for n in names[3:8])
    return rows.mapInArrow(run, schema + ", line_hashes array<long>, line_words array<long>")


def line_frequency_rules(
    docs: DataFrame, max_documents: int = 20, max_removed: float = 0.5, min_words: int = 10, max_repeated: float = 0.2, max_share: float = 0.001
) -> DataFrame:
    """Base rules, then cross-document line frequency.

    A line (blanks squeezed, A-Z lower-cased) found in more than ``max_documents`` distinct documents of one host, and in more than a share of
    ``max_share`` of the host's documents, is removed; a document that loses more than ``max_removed`` of its words this way is rejected. Documents
    are distinct by id and text. All lines of all documents are counted. Base rules: fewer than
    ``min_words`` words, or more than ``max_repeated`` of the words in repeated 5-word windows.
    Null or empty text: no words, base_failed. Null source: a host of its own (the empty name). Null doc_id: one value like others.
    Repeated rows are one document and judged alike. Very long text: whole. Empty table: no rows. Extra columns are ignored.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words.
    """
    figures = materialise(document_figures(docs))
    text = ["host", "text_hash"]
    # A text's copies are one row from here on, with their number; the counts are added up on both sides of the shuffle.
    copies = figures.select(*text, "doc_id").distinct().groupBy(*text).agg(F.count("*").alias("copies"))
    lists = figures.where(F.size("line_hashes") > 0).groupBy(*text).agg(F.first("line_hashes").alias("hashes"), F.first("line_words").alias("words"))
    texts = materialise(lists.join(copies, text))
    per_text = texts.select(*text, "copies", F.explode(F.arrays_zip("hashes", "words")).alias("x")).select(*text, "copies", F.col("x.hashes").alias("line"), F.col("x.words").alias("words"))
    counted = per_text.groupBy("host", "line").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).where(F.col("n") > max_documents)
    hosts = materialise(copies.groupBy("host").agg(F.sum("copies").alias("documents")))
    common = materialise(counted.join(hosts, "host").where(F.col("n") > max_share * F.col("documents")).select("host", "line", "rows"))
    found = salted_join(per_text, common.select("host", "line"), ["host", "line"], hot=hot_keys(common, ["host", "line"], "rows"))
    removed = found.groupBy(*text).agg(F.sum("words").alias("removed_words"))
    out = salted_join(figures, removed, text, "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(100 * max_repeated) * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("removed_words") <= max_removed * F.col("n_words"))).alias("kept"),
        "removed_words",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its figures and verdict."""
    return line_frequency_rules(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, host, text, raw, list_transform(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM d)
), lw AS (SELECT * FROM l WHERE len(words) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lw GROUP BY doc_id),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p
    FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, gram)
  ) GROUP BY doc_id
), common AS (
  SELECT host, line FROM (SELECT host, array_to_string(words, ' ') AS line, count(DISTINCT doc_id) AS n FROM lw GROUP BY ALL)
  JOIN (SELECT host, count(*) AS documents FROM d GROUP BY host) USING (host) WHERE n > 20 AND n > 0.001 * documents
), removed AS (
  SELECT doc_id, sum(len(words)) AS n FROM lw JOIN common ON lw.host = common.host AND array_to_string(words, ' ') = line
  GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(removed.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND removed_words <= 0.5 * n_words AS kept, removed_words
FROM f
"""
