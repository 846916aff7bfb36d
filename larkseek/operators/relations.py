"""Existence, link and foreign-key checks between entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkseek.operators.reads import live_rows


def _parent_keys(parent: DataFrame, ref: str) -> DataFrame:
    return live_rows(parent).select("tenant_id", F.col("id").alias(ref))


def with_existing(child: DataFrame, parent: DataFrame, ref: str) -> DataFrame:
    """Child rows whose reference names a live parent of the same tenant."""
    return child.join(_parent_keys(parent, ref), ["tenant_id", ref], "left_semi")


def without_existing(child: DataFrame, parent: DataFrame, ref: str) -> DataFrame:
    """Child rows whose reference is set but names no live parent of the same tenant."""
    return child.where(F.col(ref).isNotNull()).join(_parent_keys(parent, ref), ["tenant_id", ref], "left_anti")


def link_violations(transactions: DataFrame, listings: DataFrame) -> DataFrame:
    """Transactions whose live same-tenant listing belongs to another contact, or is missing."""
    link = live_rows(listings).select("tenant_id", F.col("id").alias("listing_id"), F.col("contact_id").alias("linked_contact"))
    given = transactions.where(F.col("contact_id").isNotNull() & F.col("listing_id").isNotNull())
    return (given.join(link, ["tenant_id", "listing_id"], "left")
            .where(~F.col("linked_contact").eqNullSafe(F.col("contact_id")) | F.col("linked_contact").isNull()))


def fk_orphans(child: DataFrame, parent: DataFrame, ref: str) -> DataFrame:
    """Child rows whose reference names no parent row at all."""
    return child.where(F.col(ref).isNotNull()).join(parent.select(F.col("id").alias(ref)), ref, "left_anti")


def fk_cross_tenant(child: DataFrame, parent: DataFrame, ref: str) -> DataFrame:
    """Child rows whose parent exists under another tenant (a plain id reference allows that)."""
    p = parent.select(F.col("id").alias(ref), F.col("tenant_id").alias("parent_tenant"))
    return child.join(p, ref).where(F.col("parent_tenant") != F.col("tenant_id"))
