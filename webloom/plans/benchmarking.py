"""Queries that score, roll up and compare extraction runs; documents play the extractions, dressed as markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import benchmark as B
from webloom.operators import services as S
from webloom.plans.documents import _STRIP, MARKDOWN
from webloom.session import table

_CASES = f"""SELECT d.doc_id AS case_id, d.lang AS category, coalesce(l.quality, 0) = 1 AS scored, d.doc_id % 9 <> 0 AS success,
 CASE WHEN d.doc_id % 6 = 1 THEN 'pdf' ELSE 'html' END AS content_type, {MARKDOWN.replace('doc_id', 'd.doc_id')} AS md,
 CASE WHEN d.doc_id % 10 = 3 THEN split_part(text, chr(10), 1) ELSE replace(text, ' the ', ' of ') END AS reference, d.doc_id % 17 = 0 AS reference_error, n_chars / 10.0 AS latency_ms
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    has = lambda *needles: F.array(*map(F.lit, needles))
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("category"), (F.coalesce("quality", F.lit(0)) == 1).alias("scored"),
        (F.col("doc_id") % 9 != 0).alias("success"), F.when(F.col("doc_id") % 6 == 1, "pdf").otherwise("html").alias("content_type"),
        F.expr(MARKDOWN).alias("markdown"),
        F.expr("CASE WHEN doc_id % 10 = 3 THEN split_part(text, chr(10), 1) ELSE replace(text, ' the ', ' of ') END").alias("reference"),
        (F.col("doc_id") % 17 == 0).alias("reference_error"), (F.col("n_chars") / 10.0).alias("latency_ms"),
        has("the and", "und der").alias("expect"), has("!!", "worthless").alias("expect_absent"),
    )


def _round(column: str, places: int) -> Column:
    """Rounded by the double itself, as the twins do; ``F.round`` goes by its shortest decimal, which takes 1 - 131 / 320 for 0.590625."""
    return F.round(F.col(column) * 10.0**places) / 10.0**places


def bench_token_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    out = B.token_prf(c, "case_id", T.tokenize(F.col("markdown"), markdown=True), T.tokenize(F.col("reference")))
    return out.select("case_id", "n_extracted", "n_gold", *[_round(k, 6).alias(k) for k in ("precision", "recall", "f1")])


def bench_score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = B.score_cases(cases(spark, sf_dir))
    return m.select(
        "case_id", "success", "reference_degenerate", F.col("markdown_words").cast("long").alias("markdown_words"), F.col("reference_words").cast("long").alias("reference_words"),
        *[_round(k, 5).alias(k) for k in ("char_coverage", "token_f1", "noise", "link_density", "expect_hit", "expect_absent_ok", "word_spacing", "quality")],
    )


def bench_aggregate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.aggregate_run(B.score_cases(cases(spark, sf_dir)))


def service_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark service: cases, what a provider gave and the references as three tables; the roll-up."""
    c = cases(spark, sf_dir)
    outputs, references = c.select("case_id", "success", "markdown", "latency_ms"), c.select("case_id", "reference", "reference_error")
    return S.run_benchmark(c.select("case_id", "category", "scored", "content_type", "expect", "expect_absent"), outputs, references)[1]


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Run A scores documents by length; run B shifts the scores and fails a few."""
    d = table(spark, sf_dir, "documents")
    # Run A lacks the cases of one language, so that every document is compared and some have nothing to be compared with.
    a = d.where("lang <> 'es'").select(F.col("doc_id").alias("case_id"), F.expr("CAST(n_chars % 101 AS DOUBLE)").alias("quality"), (F.col("doc_id") % 5 != 0).alias("success"), (F.col("doc_id") % 3 != 0).alias("scored"))
    b = d.select(
        F.col("doc_id").alias("case_id"),
        F.when(F.col("doc_id") % 23 != 0, F.expr("CAST(n_chars % 101 + (doc_id % 21) - 10 AS DOUBLE)")).alias("quality"),
        ((F.col("doc_id") % 5 != 0) & (F.col("doc_id") % 7 != 0)).alias("success"), (F.col("doc_id") % 3 != 0).alias("scored"),
    )
    return a, b


def bench_compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_runs(spark, sf_dir)
    return B.compare_runs(a, b).drop("scored")


def bench_compare_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_runs(spark, sf_dir)
    return B.compare_runs(a, b).agg(
        F.count_if("regression").alias("regressions"), F.count_if("improvement").alias("improvements"), F.count_if("newly_failing").alias("newly_failing"),
        F.round(F.avg("delta"), 6).alias("mean_delta"),
    )


def bench_worst_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.worst_cases(_two_runs(spark, sf_dir)[1])


def bench_select_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.select_cases(cases(spark, sf_dir), ["DE", "17", "Es"]).groupBy("category").agg(F.count("*").alias("n"))


def bench_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    return c.select("case_id", F.round(B.rouge_l(T.tokenize(F.col("markdown"), markdown=True), T.tokenize(F.col("reference"))), 6).alias("rouge_l"))


QUERIES = {
    "bench_token_prf": bench_token_prf,
    "bench_score_cases": bench_score_cases,
    "bench_aggregate_run": bench_aggregate_run,
    "bench_compare_runs": bench_compare_runs,
    "bench_compare_rollup": bench_compare_rollup,
    "bench_worst_cases": bench_worst_cases,
    "bench_select_cases": bench_select_cases,
    "bench_rouge_l": bench_rouge_l,
    "service_bench": service_bench,
}

_PRF = rf"""c AS ({_CASES}), s AS (SELECT *, {_STRIP} AS plain FROM c),
 e AS (SELECT case_id, lower(t) AS t, count(*) AS n FROM (SELECT case_id, unnest(regexp_extract_all(plain, '[\p{{L}}\p{{N}}_]+')) AS t FROM s) GROUP BY 1, 2),
 o AS (SELECT case_id, lower(t) AS t, count(*) AS n FROM (SELECT case_id, unnest(regexp_extract_all(reference, '[\p{{L}}\p{{N}}_]+')) AS t FROM s) GROUP BY 1, 2),
 et AS (SELECT case_id, sum(n) AS n FROM e GROUP BY 1), gt AS (SELECT case_id, sum(n) AS n FROM o GROUP BY 1),
 b AS (SELECT case_id, sum(least(e.n, o.n)) AS n FROM e JOIN o USING (case_id, t) GROUP BY 1),
 f AS (SELECT c.case_id, coalesce(et.n, 0)::BIGINT AS n_extracted, coalesce(gt.n, 0)::BIGINT AS n_gold, coalesce(b.n / et.n, 0.0) AS precision, coalesce(b.n / gt.n, 0.0) AS recall,
  coalesce(2.0 * b.n / (et.n + gt.n), 0.0) AS f1 FROM c LEFT JOIN et USING (case_id) LEFT JOIN gt USING (case_id) LEFT JOIN b USING (case_id))"""
_SCORE = rf"""WITH {_PRF}, m AS (SELECT s.*, f.*, success AND NOT reference_error AND content_type <> 'pdf' AS compared,
  len(regexp_extract_all(plain, '[\p{{L}}\p{{N}}_]+')) AS words, len(list_filter(regexp_extract_all(plain, '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[A-Za-z]{{31,}}'))) AS fused,
  len(regexp_extract_all(md, '\[[^\]]*\]\([^)]*\)')) - len(regexp_extract_all(md, '!\[[^\]]*\]\([^)]*\)')) AS links FROM s JOIN f USING (case_id)),
 r AS (SELECT *, CASE WHEN compared THEN n_gold END AS reference_words, coalesce(compared AND n_gold < 50 AND words > 3 * n_gold, false) AS deg FROM m),
 k AS (SELECT case_id, category, scored, success, latency_ms, deg AS reference_degenerate, words AS markdown_words, reference_words,
  CASE WHEN compared THEN CASE WHEN length(reference) > 0 THEN least(1.0, length(plain) / length(reference)) ELSE 0.0 END END AS char_coverage,
  CASE WHEN compared AND NOT deg THEN f1 END AS token_f1, CASE WHEN compared AND NOT deg AND n_extracted > 0 THEN 1.0 - precision END AS noise,
  CASE WHEN success THEN CASE WHEN words > 0 THEN links * 1000.0 / words ELSE 0.0 END END AS link_density,
  (contains(lower(md), 'the and')::INT + contains(lower(md), 'und der')::INT) / 2.0 AS expect_hit,
  1.0 - (contains(lower(md), '!!')::INT + contains(lower(md), 'worthless')::INT) / 2.0 AS expect_absent_ok,
  CASE WHEN words >= 50 THEN greatest(0.0, 1.0 - (fused::DOUBLE / words) / 0.05) END AS word_spacing FROM r),
 q AS (SELECT *, list_filter([[0.30, char_coverage], [0.25, token_f1], [0.15, expect_hit], [0.15, 1.0 - noise], [0.10, expect_absent_ok],
  [0.05, CASE WHEN link_density IS NOT NULL THEN greatest(0.0, 1.0 - link_density / 50.0) END], [0.10, word_spacing]], lambda p: p[2] IS NOT NULL) AS parts FROM k),
 z AS (SELECT *, CASE WHEN NOT success THEN 0.0 ELSE round_even(100.0 * list_sum(list_transform(parts, lambda p: p[1] * p[2])) / list_sum(list_transform(parts, lambda p: p[1])), 1) END AS quality FROM q)"""
_RUNS = """WITH a AS (SELECT doc_id AS case_id, (n_chars % 101)::DOUBLE AS quality, doc_id % 5 <> 0 AS success FROM documents WHERE lang <> 'es'),
 b AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 23 <> 0 THEN (n_chars % 101 + (doc_id % 21) - 10)::DOUBLE END AS quality, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS success, doc_id % 3 <> 0 AS scored
  FROM documents),
 c AS (SELECT b.case_id, b.scored, b.quality, a.quality AS old_quality, round_even(b.quality - a.quality, 1) AS delta, coalesce(a.success, false) AND NOT b.success AS newly_failing FROM b LEFT JOIN a USING (case_id))"""

ORACLES = {
    "bench_token_prf": f"WITH {_PRF} SELECT case_id, n_extracted, n_gold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "bench_score_cases": f"""{_SCORE} SELECT case_id, success, reference_degenerate, markdown_words::BIGINT AS markdown_words, reference_words::BIGINT AS reference_words,
 round(char_coverage, 5) AS char_coverage, round(token_f1, 5) AS token_f1, round(noise, 5) AS noise, round(link_density, 5) AS link_density, round(expect_hit::DOUBLE, 5) AS expect_hit,
 round(expect_absent_ok::DOUBLE, 5) AS expect_absent_ok, round(word_spacing, 5) AS word_spacing, round(quality, 5) AS quality FROM z""",
    "bench_aggregate_run": f"""{_SCORE} SELECT category, count(*) AS total_cases, count(*) FILTER (scored) AS scored_cases, round_even(avg(quality) FILTER (scored), 1) AS quality,
 round(avg(success::INT), 6) AS success_rate, round(avg(latency_ms)::DOUBLE, 4) AS mean_latency_ms FROM z GROUP BY GROUPING SETS ((), (category))""",
    "service_bench": f"""{_SCORE} SELECT category, count(*) AS total_cases, count(*) FILTER (scored) AS scored_cases, round_even(avg(quality) FILTER (scored), 1) AS quality,
 round(avg(success::INT), 6) AS success_rate, round(avg(latency_ms)::DOUBLE, 4) AS mean_latency_ms FROM z GROUP BY GROUPING SETS ((), (category))""",
    "bench_compare_runs": f"""{_RUNS} SELECT case_id, quality, old_quality, delta, coalesce(delta <= -5, false) AS regression, coalesce(delta >= 5, false) AS improvement, newly_failing FROM c""",
    "bench_compare_rollup": f"""{_RUNS} SELECT count(*) FILTER (delta <= -5) AS regressions, count(*) FILTER (delta >= 5) AS improvements, count(*) FILTER (newly_failing) AS newly_failing,
 round(avg(delta), 6) AS mean_delta FROM c""",
    "bench_worst_cases": f"{_RUNS} SELECT case_id, quality FROM b WHERE scored AND quality IS NOT NULL ORDER BY quality, case_id LIMIT 5",
    "bench_select_cases": f"WITH c AS ({_CASES}) SELECT category, count(*) AS n FROM c WHERE case_id = 17 OR category IN ('de', 'es') GROUP BY 1",
}
