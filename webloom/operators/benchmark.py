"""Scoring extractions against references, rolling runs up and comparing them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as T

ROUGE_TOKENS = 4000
# Weights of the composite score. Fixed values.
WEIGHTS = {"char_coverage": 0.30, "token_f1": 0.25, "expect_hit": 0.15, "clean": 0.15, "expect_absent_ok": 0.10, "density": 0.05, "word_spacing": 0.10}


_WORD = re.compile(r"\w+")


def _bag(text: str | None) -> tuple[int, Counter]:
    """How many tokens a text has, and its bag of them in small letters: ``T.tokenize`` on one text."""
    words = _WORD.findall(text or "")
    return len(words), Counter(map(str.lower, words))


def _in_common(a: Counter, b: Counter) -> int:
    """How many elements two bags have in common, an element as often as both have it."""
    if len(b) < len(a):
        a, b = b, a
    return sum(min(n, b[t]) for t, n in a.items() if t in b)


def text_prf(extracted: Column, gold: Column) -> Column:
    """What ``prf`` gives, of two texts: tokens are taken and counted in one Arrow pass, and only three numbers come back. Null: no tokens."""

    @F.pandas_udf("struct<n_extracted:long,n_gold:long,overlap:long>")
    def count(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(xs, ys, strict=True):
            (n, a), (m, b) = _bag(x), _bag(y)
            out.append((n, m, _in_common(a, b)))
        return pd.DataFrame(out, columns=["n_extracted", "n_gold", "overlap"], dtype="int64")

    return count(extracted, gold)


def _overlap(left: Column, right: Column) -> Column:
    @F.pandas_udf("long")
    def count(xs: pd.Series, ys: pd.Series) -> pd.Series:
        some = lambda x: Counter([] if x is None else x.tolist())
        return pd.Series([_in_common(some(x), some(y)) for x, y in zip(xs, ys, strict=True)], dtype="int64")

    return count(left, right)


def _ids(tokens: Column) -> Column:
    """Tokens as 64-bit hashes, which cost less to hand on than strings."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def prf(extracted: Column, gold: Column) -> Column:
    """A struct of the sizes, precision, recall and F1 of two token bags: a token counts as often as both sides have it. Both sides of a case are in one
    row, so nothing is shuffled. No tokens on a side, or null: all 0."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return F.struct(size(extracted).alias("n_extracted"), size(gold).alias("n_gold"), _overlap(_ids(extracted), _ids(gold)).alias("overlap"))


def token_prf(pairs: DataFrame, key: str, extracted: Column, gold: Column) -> DataFrame:
    """Per row its ``key`` and the measures of ``prf``."""
    return _rates(pairs.select(key, prf(extracted, gold).alias("bags"))).select(key, "n_extracted", "n_gold", "precision", "recall", "f1")


def _rates(rows: DataFrame) -> DataFrame:
    """``rows`` with the struct ``bags`` of ``prf`` taken apart, and the rates."""
    rows = rows.select("*", "bags.*").drop("bags")
    share = lambda n: F.when(F.col("overlap") > 0, F.col("overlap") / n).otherwise(0.0)
    rows = rows.withColumn("precision", share(F.col("n_extracted"))).withColumn("recall", share(F.col("n_gold")))
    # The harmonic mean of both rates, from the counts: it is rounded once, so that 0.75 is 0.75 and a half falls to the right side.
    return rows.withColumn("f1", share((F.col("n_extracted") + F.col("n_gold")) / 2))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit a token of the shorter side: each step is a few big-integer operations."""
    if len(b) > len(a):
        a, b = b, a
    masks: dict = {}
    for k, token in enumerate(b):
        masks[token] = masks.get(token, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        both = row & masks.get(token, 0)
        row = (row + both | row - both) & full
    return len(b) - row.bit_count()


def rouge_l(extracted: Column, gold: Column) -> Column:
    """ROUGE-L F-measure over the first ``ROUGE_TOKENS`` tokens of each side, Arrow-batched."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in parts:
            out = np.zeros(len(xs))
            for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
                if x is not None and y is not None and len(x) and len(y):
                    n = lcs_length(x.tolist(), y.tolist())
                    out[k] = 2 * n / (len(x) + len(y))
            yield pd.Series(out)

    return score(_ids(F.slice(extracted, 1, ROUGE_TOKENS)), _ids(F.slice(gold, 1, ROUGE_TOKENS)))


def composite(success: Column, parts: dict[str, Column]) -> Column:
    """Weighted mean of the parts that are there, 0-100 to one decimal; failures 0, nothing to score 50."""
    weight = sum((F.when(v.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, v in parts.items()), F.lit(0.0))
    total = sum((F.coalesce(F.lit(WEIGHTS[k]) * v, F.lit(0.0)) for k, v in parts.items()), F.lit(0.0))
    return F.when(~success, 0.0).when(weight == 0, 50.0).otherwise(F.bround(100.0 * total / weight, 1))


def degenerate(words: Column, reference_words: Column) -> Column:
    """The reference holds under 50 words and the output over three times as many."""
    return F.coalesce((reference_words < 50) & (words > 3 * reference_words), F.lit(False))


def score_cases(cases: DataFrame) -> DataFrame:
    """All metrics of cases (case_id, category, scored, success, content_type, markdown, reference, reference_error, expect, expect_absent, latency_ms).

    Reference metrics are null for PDFs, failures and failed references; F1 and noise also for degenerate references."""
    plain = F.col("plain")
    compared = F.col("success") & F.col("reference").isNotNull() & ~F.col("reference_error") & (F.col("content_type") != "pdf")
    base = cases.withColumn("plain", T.strip_markdown(F.coalesce("markdown", F.lit("")))).withColumn("compared", compared)
    # Only compared cases have a reference to hand on.
    base = base.withColumn("bags", text_prf(plain, F.when(F.col("compared"), F.col("reference"))))
    links = T.structure(F.col("markdown"))["links"]
    m = (
        _rates(base)
        .withColumn("markdown_words", F.col("n_extracted").cast("int"))
        .withColumn("markdown_chars", F.length(plain))
        .withColumn("reference_words", F.when(F.col("compared"), F.col("n_gold")))
        .withColumn("char_coverage", F.when(F.col("compared"), F.when(F.length("reference") > 0, F.least(F.lit(1.0), F.length(plain) / F.length("reference"))).otherwise(0.0)))
        .withColumn("reference_degenerate", degenerate(F.col("markdown_words"), F.col("reference_words")))
        .withColumn("token_f1", F.when(F.col("compared") & ~F.col("reference_degenerate"), F.col("f1")))
        .withColumn("noise", F.when(F.col("compared") & ~F.col("reference_degenerate") & (F.col("n_extracted") > 0), 1.0 - F.col("precision")))
        .withColumn("expect_hit", T.hit_rate(F.col("markdown"), F.col("expect")))
        .withColumn("expect_absent_ok", T.absent_rate(F.col("markdown"), F.col("expect_absent")))
        .withColumn("word_spacing", F.when(F.col("markdown").isNotNull(), T.word_spacing(F.col("markdown"), plain=plain, tokens=F.col("n_extracted"))))
        .withColumn("link_density", F.when(F.col("success"), T.link_density(links, F.col("markdown_words"))))
    )
    parts = {
        "char_coverage": F.col("char_coverage"), "token_f1": F.col("token_f1"), "expect_hit": F.col("expect_hit"), "clean": 1.0 - F.col("noise"),
        "expect_absent_ok": F.col("expect_absent_ok"), "density": F.greatest(F.lit(0.0), 1.0 - F.col("link_density") / 50.0), "word_spacing": F.col("word_spacing"),
    }
    # greatest() skips nulls, but no density is no part.
    parts["density"] = F.when(F.col("link_density").isNotNull(), parts["density"])
    return m.withColumn("quality", composite(F.col("success"), parts)).select(
        "case_id", "category", "scored", "success", "latency_ms", "markdown_words", "markdown_chars", "reference_words", "char_coverage", "token_f1", "noise",
        "reference_degenerate", "link_density", "expect_hit", "expect_absent_ok", "word_spacing", "quality",
    )


def aggregate_run(metrics: DataFrame) -> DataFrame:
    """Overall (category null) and by-category roll-up in one pass of grouping sets."""
    scored = F.col("scored") & F.col("quality").isNotNull()
    return metrics.groupingSets([[], ["category"]], "category").agg(
        F.count("*").alias("total_cases"),
        F.count_if(scored).alias("scored_cases"),
        F.bround(F.avg(F.when(scored, F.col("quality"))), 1).alias("quality"),
        F.bround(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.bround(F.avg("latency_ms"), 4).alias("mean_latency_ms"),
    )


def compare_runs(old: DataFrame, new: DataFrame, step: float = 5.0) -> DataFrame:
    """Per case of the new run: the change of quality, whether it got worse or better by ``step`` or more, whether it newly fails."""
    before = old.select("case_id", F.col("quality").alias("old_quality"), F.col("success").alias("old_success"))
    delta = F.bround(F.col("quality") - F.col("old_quality"), 1)
    return new.join(before, "case_id", "left").select(
        "case_id", "scored", "quality", "old_quality", delta.alias("delta"),
        F.coalesce(delta <= -step, F.lit(False)).alias("regression"),
        F.coalesce(delta >= step, F.lit(False)).alias("improvement"),
        (F.coalesce("old_success", F.lit(False)) & ~F.col("success")).alias("newly_failing"),
    )


def worst_cases(metrics: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` scored cases of least quality, by quality and id."""
    return metrics.where("scored AND quality IS NOT NULL").orderBy("quality", "case_id").limit(n).select("case_id", "quality")


def select_cases(cases: DataFrame, only: list[str]) -> DataFrame:
    """Cases whose id or category is in ``only``, whatever the case; none named: all."""
    wanted = [x.lower() for x in only]
    return cases.where(F.lower(F.col("case_id").cast("string")).isin(wanted) | F.lower("category").isin(wanted)) if wanted else cases


def judge_score(raw: Column) -> Column:
    """A judge's score, held within 0 to 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))
