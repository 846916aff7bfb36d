"""Query text, null-text and LIKE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters counted as white space by Unicode-aware strip / blank tests
# (no-break spaces are not among them).
SPACE_CLASS = "\\t-\\r\\x1c-\\x20\\u1680\\u2000-\\u2006\\u2008-\\u200a\\u2028\\u2029\\u205f\\u3000"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(as_col(c), f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def control_trim(c: Column | str) -> Column:
    """Strip characters up to U+0020 (space, tab, newline, controls) at both ends."""
    return F.regexp_replace(as_col(c), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return ~has_text(c)


def has_text(c: Column | str) -> Column:
    """True when the text holds a character that is not white space."""
    return F.coalesce(as_col(c).rlike(f"[^{SPACE_CLASS}]"), F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    """Null for blank text, otherwise the text unchanged."""
    c = as_col(c)
    return F.when(has_text(c), c)


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def normalize_query(q: Column | str) -> Column:
    """Null to empty, strip, and collapse white-space runs to one space."""
    return F.regexp_replace(strip(F.coalesce(as_col(q), F.lit(""))), "\\s+", " ")


def query_tokens(norm: Column | str) -> Column:
    """Space-separated non-blank tokens of a normalised query."""
    return F.filter(F.split(as_col(norm), " "), lambda t: ~is_blank(t))


def prefix_tsquery(tokens: Column | str) -> Column:
    """Text form ``a:* & b:*``; every token is a prefix."""
    return F.array_join(F.transform(as_col(tokens), lambda t: F.concat(t, F.lit(":*"))), " & ")


def like_pattern(pattern: Column | str) -> Column:
    """Drop escapes in front of ordinary characters, which Spark's LIKE rejects but which are
    harmless elsewhere; escapes of ``% _ \\`` stay."""
    return F.regexp_replace(as_col(pattern), "(?<!\\\\)((?:\\\\\\\\)*)\\\\([^%_\\\\])", "$1$2")


def escape_like(term: Column | str) -> Column:
    """Make user text literal inside a LIKE pattern."""
    return F.regexp_replace(as_col(term), "([%_\\\\])", "\\\\$1")


def with_like_columns(queries: DataFrame, term: str = "term") -> DataFrame:
    """Add ``pattern`` (``%term%``, wildcards in the term stay wildcards) and ``is_wild``."""
    return (queries.withColumn("pattern", like_pattern(F.concat(F.lit("%"), F.col(term), F.lit("%"))))
            .withColumn("is_wild", F.col(term).rlike("[%_\\\\]")))


def contains_like_sql(text: str) -> str:
    """SQL: ``text LIKE pattern``; plain terms take the cheaper substring test."""
    return f"coalesce(if(is_wild, {text} like pattern, contains({text}, term)), false)"


def staged(df: DataFrame, *keep: str, **exprs: str) -> DataFrame:
    """Compute SQL expressions once per row and hand them on as plain columns.

    The one-row generator keeps the optimizer from copying the expressions into every later filter
    and projection that mentions them.
    """
    fields = ", ".join(f"{e} as {n}" for n, e in exprs.items())
    return df.selectExpr(*keep, f"inline_outer(array(struct({fields})))")


def sql_literal_like(text: Column, term: str, prefix: bool = False, escape_wildcards: bool = False) -> Column:
    """LIKE against one literal term: ``term%`` or ``%term%``."""
    wild = any(ch in term for ch in "%_\\")
    if not wild:
        return text.startswith(term) if prefix else text.contains(term)
    if escape_wildcards:
        return text.startswith(term) if prefix else text.contains(term)
    return F.like(text, like_pattern(F.lit(term + "%" if prefix else "%" + term + "%")))


def entity_key(tenant: Column | str, entity_id: Column | str) -> Column:
    """Record key ``tenant:id``."""
    return F.concat(as_col(tenant), F.lit(":"), as_col(entity_id))


# Fixed value: longest accepted query text.
MAX_QUERY_LENGTH = 100


def mask_pii(c: Column | str) -> Column:
    """Mask e-mail addresses and phone-like digit runs and drop control characters."""
    clean = F.regexp_replace(as_col(c), "[\\x00-\\x1f\\x7f]", "")
    mail = F.regexp_replace(clean, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>")
    return F.regexp_replace(mail, "\\+?[0-9][0-9 -]{6,}[0-9]", "<phone>")


def query_reject_reason(c: Column | str) -> Column:
    """Why a query text should not be accepted: control characters or too long; null when fine."""
    c = as_col(c)
    return (F.when(c.rlike("[\\x00-\\x1f\\x7f]"), "control_chars")
            .when(F.length(c) > MAX_QUERY_LENGTH, "too_long"))
