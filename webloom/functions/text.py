"""Text measures over markdown columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of markdown elements. Fixed values.
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[[^\]]*\]\([^)]*\)"
FENCE = r"(?md)^\s{0,3}```"
HEADING = r"(?md)^\s{0,3}#{1,6}\s+\S"
TABLE_ROW = r"(?md)^\s{0,3}\|.*\|\s*$"
TOKEN = r"[\p{L}\p{N}_]+"
FUSED = r"(?<![\p{L}\p{N}_])[A-Za-z]{31,}(?![\p{L}\p{N}_])"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip_markdown(text: Column) -> Column:
    """Visible prose: no images, links as their anchor, no fence marks and heading hashes."""
    text = F.regexp_replace(text, IMAGE, " ")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"```[^\n]*", " ")
    return F.regexp_replace(text, r"(?md)^\s{0,3}#{1,6}\s+", "")


def tokenize(text: Column, markdown: bool = False) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    text = strip_markdown(text) if markdown else text
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def word_count(text: Column) -> Column:
    """White-space separated words, by the Unicode notion of white space."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"(?U)[^\s\x1C-\x1F]+")))


def structure(markdown: Column) -> dict[str, Column]:
    """Counts of markdown elements: fences pair up, a table's header and rule lines are netted out."""
    rows = count_of(markdown, TABLE_ROW)
    return {
        "headings": count_of(markdown, HEADING),
        "code_blocks": F.floor(count_of(markdown, FENCE) / 2).cast("int"),
        "tables": F.greatest(F.lit(0), rows - 2),
        "images": count_of(markdown, IMAGE),
        "links": count_of(markdown, r"(?<!!)" + LINK),
    }


def link_density(links: Column, words: Column) -> Column:
    """Links per 1000 words; 0 without words."""
    return F.when(words > 0, links * 1000.0 / words).otherwise(F.lit(0.0))


def word_spacing(markdown: Column, minimum: int = 50, full_penalty: float = 0.05, plain: Column | None = None, tokens: Column | None = None) -> Column:
    """1 where words are well apart, down to 0 as the share of fused runs (over 30 ASCII letters) reaches ``full_penalty``; null
    below ``minimum`` tokens. ``plain`` and ``tokens``: the stripped markdown and how many tokens it has, where columns have them
    already."""
    text = strip_markdown(markdown) if plain is None else plain
    # The lambda binds the two counts, which would else be taken again for each mention.
    counts = F.array(F.struct((F.regexp_count(text, F.lit(TOKEN)) if tokens is None else tokens).alias("t"), F.regexp_count(text, F.lit(FUSED)).alias("f")))
    spacing = F.transform(counts, lambda c: F.when(c["t"] >= minimum, F.greatest(F.lit(0.0), 1.0 - (c["f"] / c["t"]) / full_penalty)))
    return F.get(spacing, 0)


def trimmed_summary(text: Column, most: int = 500) -> Column:
    """A summary of at most ``most`` characters: up to the last full stop within, else cut with dots."""
    head = F.substring(text, 1, most)
    whole = F.concat(F.regexp_replace(head, r"(?s)\.[^.]*$", ""), F.lit("."))
    return F.when(F.length(text) > most, F.when(F.contains(head, F.lit(".")), whole).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))).otherwise(text)


def hit_rate(text: Column, needles: Column) -> Column:
    """Share of ``needles`` in the text, whatever the case; null for none."""
    hay = F.lower(text)
    hits = F.size(F.filter(needles, lambda n: F.contains(hay, F.lower(n))))
    return F.when(F.size(needles) > 0, hits / F.size(needles))


def absent_rate(text: Column, needles: Column) -> Column:
    """Share of ``needles`` that the text lacks; null for none."""
    return 1.0 - hit_rate(text, needles)


def non_printable_ratio(text: Column, sample: int = 8192) -> Column:
    """Control characters but tab, line feed and carriage return among the first ``sample`` characters."""
    head = F.substring(text, 1, sample)
    return F.when(F.length(head) > 0, F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")) / F.length(head)).otherwise(0.0)
