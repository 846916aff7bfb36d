"""Word trigrams, Jaccard similarity, and raw q-grams of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A padded word carries two blanks on its left and one on its right, and at least three stand between two
# words, so a three-character window lies inside one word unless it ends in two blanks.
_GRAM = "(?s)(?=(..[^ ]|.[^ ].))"


def trigram_sql(text: str) -> str:
    """SQL for the distinct padded trigrams of the lower-cased words of a text; null for null."""
    return (f"array_distinct(regexp_extract_all(concat('  ', regexp_replace(lower({text}), "
            f"r'[^\\p{{L}}\\p{{N}}]+', '  '), ' '), r'{_GRAM}', 1))")


def jaccard_sql(a: str, b: str) -> str:
    """SQL for |a∩b| / |a∪b| of two distinct-element array columns; null if either is null, 0 if
    both are empty."""
    return jaccard_of_sql(a, b, f"size(array_intersect({a}, {b}))")


def jaccard_of_sql(a: str, b: str, common: str) -> str:
    """The same, given the size of what both hold."""
    return (f"(case when {a} is null or {b} is null then null when size({a}) + size({b}) = 0 then 0D "
            f"else {common} / double(size({a}) + size({b}) - {common}) end)")


def windows_sql(text: str, q: int) -> str:
    """SQL for all q-character windows of the text as it stands, with repeats."""
    return f"regexp_extract_all({text}, r'(?s)(?=(.{{{q}}}))', 1)"


def qgrams_sql(text: str, q: int) -> str:
    """SQL for all distinct q-character windows of the text as it stands."""
    return f"array_distinct({windows_sql(text, q)})"


def trigram_set(text: str) -> Column:
    return F.expr(trigram_sql(text))


def similarity(a: str, b: str) -> Column:
    """Similarity of two text columns."""
    return F.expr(jaccard_sql(trigram_sql(a), trigram_sql(b)))
