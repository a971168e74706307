"""Queries over documents as extracted markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import quality as Q
from webloom.functions import text as T
from webloom.operators import outputs
from webloom.session import table

#: The tables hold plain prose; this dresses it as markdown and as badly read PDFs, alike in both engines, so that every branch occurs.
MARKDOWN = """CASE WHEN doc_id % 7 = 0 THEN replace(text, ' ', '') WHEN doc_id % 5 = 0 THEN '# ' || text
 WHEN doc_id % 5 = 1 THEN '[link](http://x.y/a) ' || text || chr(10) || '![pic](http://x.y/i.png)'
 WHEN doc_id % 5 = 2 THEN '```py' || chr(10) || text || chr(10) || '```'
 WHEN doc_id % 5 = 3 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || text ELSE text END"""
_VIEW = f"WITH md AS (SELECT doc_id, lang, source, {MARKDOWN} AS md FROM documents)"
_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'),
 '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '```[^\n]*', ' ', 'g'), '(?m)^\s{0,3}#{1,6}\s+', '', 'g')"""
_MEASURES = rf"""{_VIEW}, s AS (SELECT *, {_STRIP} AS plain FROM md), m AS (
 SELECT *, len(regexp_extract_all(md, '[^\pZ\s\x0B\x1C-\x1F\x85]+')) AS words,
  len(regexp_extract_all(plain, '[\p{{L}}\p{{N}}_]+')) AS tokens,
  len(list_filter(regexp_extract_all(plain, '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[A-Za-z]{{31,}}'))) AS fused,
  len(regexp_extract_all(md, '\[[^\]]*\]\([^)]*\)')) - len(regexp_extract_all(md, '!\[[^\]]*\]\([^)]*\)')) AS links
 FROM s), g AS (SELECT *, CASE WHEN tokens >= 50 THEN greatest(0.0, 1.0 - (fused::DOUBLE / tokens) / 0.05) END AS spacing,
  CASE WHEN words > 0 THEN links * 1000.0 / words ELSE 0.0 END AS density FROM m)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(MARKDOWN).alias("md"))


def text_strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc_id", F.md5(T.strip_markdown(F.col("md"))).alias("plain_md5"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.tokenize(F.col("md"), markdown=True)
    return markdown(spark, sf_dir).select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def text_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc_id", *[c.cast("long").alias(k) for k, c in T.structure(F.col("md")).items()])


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.col("md")
    # Stripped once; what is counted in it is a column of its own before anything is made of it.
    stripped = markdown(spark, sf_dir).withColumn("plain", T.strip_markdown(md))
    return stripped.select(
        "doc_id", "lang", "source",
        T.word_count(md).cast("long").alias("words"),
        T.structure(md)["links"].alias("links"),
        T.word_spacing(md, plain=F.col("plain")).alias("spacing"),
    )


def text_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select(
        "doc_id", "words", F.round("spacing", 6).alias("spacing"),
        F.round(T.link_density(F.col("links"), F.col("words")), 6).alias("link_density"),
    )


def quality_assess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate and grade of every document as a PDF's text."""
    m = _measured(spark, sf_dir).withColumn("verdict", Q.pdf_verdict(F.col("words"), F.col("spacing")))
    score = Q.capped(Q.reference_free_score(F.col("words"), F.col("links"), F.col("spacing")), F.col("verdict"))
    return m.select("doc_id", "verdict", score.alias("score"), Q.usable(F.col("verdict")).alias("usable"))


def quality_verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir).withColumn("verdict", Q.pdf_verdict(F.col("words"), F.col("spacing")))
    score = Q.capped(Q.reference_free_score(F.col("words"), F.col("links"), F.col("spacing")), F.col("verdict"))
    return m.select("lang", "verdict", score.alias("score")).groupBy("lang", "verdict").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score")
    )


def text_anchor_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and absences of curated anchors in every document."""
    needles = F.array(*[F.lit(x) for x in ("the and", "worthless", "Licensed under", "der die")])
    return markdown(spark, sf_dir).select(
        "doc_id", F.round(T.hit_rate(F.col("md"), needles), 6).alias("hit"), F.round(T.absent_rate(F.col("md"), needles), 6).alias("absent")
    )


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash with its url, and the markdown hash used for change tracking."""
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string"))
    return markdown(spark, sf_dir).select(
        "doc_id",
        F.sha2(F.concat(url, F.lit("||"), F.col("md")), 256).alias("content_hash"),
        F.sha2(F.coalesce("md", F.lit("")), 256).alias("markdown_hash"),
    )


def text_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML frontmatter: absent fields leave no line, quotes and backslashes are escaped."""
    title = F.concat(F.lit('A "'), F.col("source"), F.lit('" \\ '), F.col("doc_id").cast("string"))
    fields = {
        "url": F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")), "title": title, "provider": F.when(F.col("doc_id") % 3 == 0, F.col("source")),
        "language": F.when(F.col("lang") != "en", F.col("lang")), "word_count": T.word_count(F.col("md")),
    }
    text = outputs.frontmatter(fields)
    return markdown(spark, sf_dir).select("doc_id", text.alias("frontmatter"))


def text_summary_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of at most 500 characters, cut at the last full stop or else with dots."""
    summary = T.trimmed_summary(F.col("s"))
    return table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("s")).select("doc_id", F.md5(summary).alias("summary_md5"), F.length(summary).cast("long").alias("chars"))


QUERIES = {
    "quality_assess_documents": quality_assess_documents,
    "quality_verdict_summary": quality_verdict_summary,
    "text_strip_markdown": text_strip_markdown,
    "text_tokens": text_tokens,
    "text_structure": text_structure,
    "text_spacing": text_spacing,
    "text_anchor_rates": text_anchor_rates,
    "text_hashes": text_hashes,
    "text_frontmatter": text_frontmatter,
    "text_summary_trim": text_summary_trim,
}

_VERDICT = """v AS (SELECT *, CASE WHEN words = 0 THEN 'empty' WHEN spacing < 0.5 THEN 'garbled_pdf' WHEN words < 50 THEN 'thin' ELSE 'ok' END AS verdict,
 round_even(100 * (0.55 * least(1.0, words / 300.0) + 0.30 * coalesce(spacing, 1.0) + 0.15 * greatest(0.0, 1.0 - density / 50.0)), 0)::INT AS raw FROM g),
 c AS (SELECT *, least(raw, CASE verdict WHEN 'empty' THEN 0 WHEN 'garbled_pdf' THEN 25 WHEN 'thin' THEN 45 ELSE 100 END)::INT AS score FROM v)"""

ORACLES = {
    "quality_assess_documents": f"{_MEASURES}, {_VERDICT} SELECT doc_id, verdict, score, verdict NOT IN ('empty', 'garbled_pdf') AS usable FROM c",
    "quality_verdict_summary": f"{_MEASURES}, {_VERDICT} SELECT lang, verdict, count(*) AS n, round(avg(score), 4) AS mean_score FROM c GROUP BY 1, 2",
    "text_strip_markdown": f"{_VIEW} SELECT doc_id, md5({_STRIP}) AS plain_md5 FROM md",
    "text_tokens": rf"""{_VIEW}, t AS (SELECT unnest(regexp_extract_all({_STRIP}, '[\p{{L}}\p{{N}}_]+')) AS token FROM md)
 SELECT lower(token) AS token, count(*) AS n FROM t GROUP BY 1""",
    "text_structure": rf"""{_VIEW} SELECT doc_id, len(regexp_extract_all(md, '(?m)^\s{{0,3}}#{{1,6}}\s+\S'))::BIGINT AS headings,
 (len(regexp_extract_all(md, '(?m)^\s{{0,3}}```')) // 2)::BIGINT AS code_blocks,
 greatest(0, len(regexp_extract_all(md, '(?m)^\s{{0,3}}\|.*\|\s*$')) - 2)::BIGINT AS tables,
 len(regexp_extract_all(md, '!\[[^\]]*\]\([^)]*\)'))::BIGINT AS images,
 (len(regexp_extract_all(md, '\[[^\]]*\]\([^)]*\)')) - len(regexp_extract_all(md, '!\[[^\]]*\]\([^)]*\)')))::BIGINT AS links FROM md""",
    "text_spacing": f"{_MEASURES} SELECT doc_id, words::BIGINT AS words, round(spacing, 6) AS spacing, round(density, 6) AS link_density FROM g",
    "text_anchor_rates": f"""{_VIEW}, h AS (SELECT doc_id, (contains(lower(md), 'the and')::INT + contains(lower(md), 'worthless')::INT
 + contains(lower(md), 'licensed under')::INT + contains(lower(md), 'der die')::INT) / 4.0 AS hit FROM md)
 SELECT doc_id, round(hit::DOUBLE, 6) AS hit, round((1.0 - hit)::DOUBLE, 6) AS absent FROM h""",
    "text_hashes": f"""{_VIEW} SELECT doc_id, sha256('https://' || source || '.example/' || doc_id || '||' || md) AS content_hash,
 sha256(coalesce(md, '')) AS markdown_hash FROM md""",
    "text_frontmatter": rf"""{_VIEW}, w AS (SELECT *, len(regexp_extract_all(md, '[^\pZ\s\x0B\x1C-\x1F\x85]+')) AS words FROM md)
 SELECT doc_id, concat_ws(chr(10), '---', 'url: "https://x.example/' || doc_id || '"',
 'title: "A \"' || source || '\" \\ ' || doc_id || '"', CASE WHEN doc_id % 3 = 0 THEN 'provider: ' || source END,
 CASE WHEN lang <> 'en' THEN 'language: ' || lang END, CASE WHEN words > 0 THEN 'word_count: ' || words END, '---') AS frontmatter FROM w""",
    "text_summary_trim": r"""WITH s AS (SELECT doc_id, trim(text) AS s FROM documents), c AS (SELECT doc_id, CASE WHEN length(s) <= 500 THEN s
 WHEN contains(substr(s, 1, 500), '.') THEN regexp_replace(substr(s, 1, 500), '(?s)\.[^.]*$', '') || '.' ELSE substr(s, 1, 497) || '...' END AS t FROM s)
 SELECT doc_id, md5(t) AS summary_md5, length(t)::BIGINT AS chars FROM c""",
}
