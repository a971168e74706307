"""From raw documents to packed sequences, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.common import materialise, table
from webloom.llm.decontamination import drop_leaking
from webloom.llm.line_dedup import dedup_lines
from webloom.llm.packing import default_tokenizer, pack
from webloom.llm.quality_model import drop_low_quality
from webloom.llm.simhash import BITS, drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts share one score and stay or go together; a null doc_id is judged by its text; repeated rows are judged alike; very long texts are read
    whole; an empty table gives no rows; columns of any names stay as they are."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found earlier in the corpus go; a document stays, if with less text.

    Null texts stay null and empty ones empty; a null doc_id comes before all others; wholly equal rows are one document and end alike; very long texts and lines
    are compared whole; an empty table gives no rows; columns of any names stay, without the operator's own counts."""
    return dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, however far apart their fingerprints are.

    Null, empty and blank texts are one group; of equal texts the least doc_id stays, nulls last, and of repeated rows one; very long texts are compared whole;
    an empty table gives no rows; columns of any names stay as they are."""
    return drop_near_duplicates(docs, radius=BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go.

    Null and empty texts stay; a null doc_id is judged by its text; repeated rows are judged alike; very long texts are read whole; an empty table gives no
    rows; columns of any names stay as they are."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 4096 tokens.

    Null and empty texts are the end id alone; a null doc_id is packed like any other; repeated rows are packed each; very long texts fill several sequences; an
    empty table gives no rows; other columns are left out."""
    return pack(docs, default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: A trained network and the tokenizer's ids cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written out before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
