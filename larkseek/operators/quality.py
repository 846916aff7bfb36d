"""Data checks and backfills for the entity tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larkseek.functions.money import CURRENCY_PATTERN, money, money_amount, normalize_currency, valid_currency


def null_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: null count of each column, and the row count."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def duplicate_keys(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def assert_no_rows(df: DataFrame, message: str) -> None:
    """Stop a job when a check finds rows; the message carries the count."""
    n = df.count()
    if n:
        raise ValueError(f"{message}: {n} rows")


class GateError(ValueError):
    """A checked write was refused; ``counts`` holds the rows that failed each check."""

    def __init__(self, counts: Mapping[str, int]):
        super().__init__("write refused: " + ", ".join(f"{k}: {v} rows" for k, v in counts.items() if v and k != "n_rows"))
        self.counts = dict(counts)


def gated_write(df: DataFrame, path: str, bad: Mapping[str, Column], allowed: Mapping[str, int] | None = None) -> dict[str, int]:
    """Write ``df`` to the new folder ``path`` and count, in the same scan, the rows for which each
    condition of ``bad`` is true (null: not). Returns the counts and ``n_rows``.

    With more than ``allowed`` rows (default none) of a check, what was written is removed and
    :class:`GateError` is raised. An existing folder is never touched. The counts are taken while
    rows pass by, so nothing is read twice; a check across rows (a duplicate) needs a query of its own.
    """
    if "n_rows" in bad:
        raise ValueError("n_rows is the number of all rows")
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in bad.items()])
    counted.write.mode("errorifexists").parquet(path)
    counts = {k: int(v) for k, v in seen.get.items()}
    if any(counts[k] > (allowed or {}).get(k, 0) for k in bad):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        raise GateError(counts)
    return counts


def clean_email(df: DataFrame) -> DataFrame:
    """Trim spaces around e-mails."""
    return df.withColumn("email", F.trim("email"))


def backfill_mls(df: DataFrame) -> DataFrame:
    """Missing MLS ids become the row id."""
    return df.withColumn("mls_id", F.coalesce("mls_id", "id"))


def currency_normalize(df: DataFrame) -> DataFrame:
    return df.withColumn("currency", normalize_currency("currency"))


def currency_backfill(df: DataFrame) -> DataFrame:
    """Blank or null to the default; other values trimmed but left in their case."""
    return df.withColumn("currency", F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("USD")))


def currency_violations(df: DataFrame) -> DataFrame:
    """Rows whose currency is missing or not three capital letters."""
    return df.where(F.col("currency").isNull() | ~F.col("currency").rlike(CURRENCY_PATTERN))


def total_backfill(df: DataFrame) -> DataFrame:
    """Fold a legacy ``amount`` into ``total``, then null to 0 with two decimals; null status to NEW."""
    total = F.coalesce("total", "amount") if "amount" in df.columns else F.col("total")
    return (df.withColumn("total", money_amount(total))
            .withColumn("status", F.coalesce("status", F.lit("NEW"))).drop("amount"))


def money_normalize(df: DataFrame, amount: str) -> DataFrame:
    """Add ``money`` (null when quarantined) and ``money_reject`` (null or ``invalid_currency``)."""
    return (df.withColumn("money", money(amount, "currency"))
            .withColumn("money_reject", F.when(~valid_currency("currency"), F.lit("invalid_currency"))))
