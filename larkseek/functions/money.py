"""Money as ``struct<amount decimal(19,2), currency string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkseek.functions.text import as_col, is_blank

# The currency check and the default currency.
CURRENCY_PATTERN = r"\A[A-Z]{3}\z"
DEFAULT_CURRENCY = "USD"


def rounded(amount: Column | str) -> Column:
    """Two decimals, half up, rounded once from the decimal as it is given; amounts of other types
    become decimals of 18 places first."""
    c = as_col(amount)
    return F.when(F.typeof(c).startswith("decimal"), F.round(c, 2).cast("decimal(19,2)")).otherwise(
        F.round(c.cast("decimal(38,18)"), 2).cast("decimal(19,2)"))


def money_amount(amount: Column | str) -> Column:
    """Null to 0; more than two decimals round half up (see :func:`rounded`)."""
    return F.coalesce(rounded(amount), F.lit(0).cast("decimal(19,2)"))


def valid_currency(currency: Column | str) -> Column:
    """Blank counts as the default; lower case is not accepted."""
    return is_blank(currency) | as_col(currency).rlike(CURRENCY_PATTERN)


def money(amount: Column | str, currency: Column | str) -> Column:
    """Money value, or null when the currency is invalid (see :func:`valid_currency`)."""
    ccy = F.when(is_blank(currency), F.lit(DEFAULT_CURRENCY)).otherwise(F.upper(as_col(currency)))
    return F.when(valid_currency(currency),
                  F.struct(money_amount(amount).alias("amount"), ccy.alias("currency")))


def money_equal(a: Column, b: Column) -> Column:
    return (a["amount"] == b["amount"]) & a["currency"].eqNullSafe(b["currency"])


def money_hash(m: Column) -> Column:
    """Equal money values have equal hashes (the scale is fixed, so trailing zeros do not matter)."""
    return F.xxhash64(m["amount"], m["currency"])


def money_text(m: Column) -> Column:
    return F.concat_ws(" ", m["amount"].cast("string"), m["currency"])


def normalize_currency(currency: Column | str) -> Column:
    """Backfill rule: trim spaces, upper-case, blank or null to the default."""
    return F.upper(F.coalesce(F.nullif(F.trim(as_col(currency)), F.lit("")), F.lit(DEFAULT_CURRENCY)))
