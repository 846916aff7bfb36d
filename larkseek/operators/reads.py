"""Tenant-scoped reads of entity tables: filters, lookups, pages and the per-entity searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkseek.functions.money import money
from larkseek.functions.text import control_trim, like_pattern, sql_literal_like

# Argument guards.
SEARCH_DEFAULT, SEARCH_MAX = 20, 100
PAGE_DEFAULT, PAGE_MAX = 50, 200
GROUP_MIN, GROUP_MAX, GROUP_DEFAULT = 1, 50, 5
API_GROUP_MAX = 20


def search_limit(first: int | None) -> int:
    """Null, non-positive or too large means the default."""
    return SEARCH_DEFAULT if first is None or first <= 0 or first > SEARCH_MAX else first


def page_bounds(offset: int | None, limit: int | None) -> tuple[int, int]:
    limit = PAGE_DEFAULT if limit is None else max(1, min(PAGE_MAX, limit))
    return max(0, offset or 0), limit


def group_limit(limit: Column) -> Column:
    """Per-group hits: below 1 (or null) the default, above 50 the maximum."""
    return (F.when(limit.isNull() | (limit < GROUP_MIN), F.lit(GROUP_DEFAULT))
            .when(limit > GROUP_MAX, F.lit(GROUP_MAX)).otherwise(limit).cast("int"))


def api_group_limit(limit: int | None) -> int:
    """The bound the query API puts in front: 1..20, 5 when absent."""
    return GROUP_DEFAULT if limit is None else max(GROUP_MIN, min(API_GROUP_MAX, limit))


def require_tenant(tenant: str | None) -> str:
    if tenant is None or not tenant.strip():
        raise ValueError("a tenant is required")
    return tenant


def tenant_scope(df: DataFrame, tenant: str) -> DataFrame:
    return df.where(F.col("tenant_id") == require_tenant(tenant))


def live_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def entity_scan(df: DataFrame, amount: str | None = None) -> DataFrame:
    """Typed rows of an entity table; with ``amount`` the amount and currency columns become a
    ``money`` struct of that name."""
    if amount is None:
        return df
    cols = [c for c in df.columns if c not in (amount, "currency")]
    return df.select(*cols, money(amount, "currency").alias(amount))


def lookup_by_id(df: DataFrame, ids: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Rows whose (tenant_id, id) is in ``ids``; the planner broadcasts ``ids`` when it is small."""
    rows = df if include_deleted else live_rows(df)
    return rows.join(ids.select("tenant_id", "id"), ["tenant_id", "id"], "left_semi")


def entity_page(df: DataFrame, tenant: str, offset: int | None = 0, limit: int | None = PAGE_DEFAULT) -> DataFrame:
    """One offset page of live rows in id order."""
    offset, limit = page_bounds(offset, limit)
    return live_rows(tenant_scope(df, tenant)).orderBy("id").offset(offset).limit(limit)


def entity_page_after(df: DataFrame, tenant: str, last_id: str | None, limit: int | None = PAGE_DEFAULT) -> DataFrame:
    """Keyset page: the rows after ``last_id``. Unlike an offset it never reads skipped rows."""
    _, limit = page_bounds(0, limit)
    rows = live_rows(tenant_scope(df, tenant))
    if last_id is not None:
        rows = rows.where(F.col("id") > last_id)
    return rows.orderBy("id").limit(limit)


# The public columns of each entity.
PUBLIC_COLUMNS = {
    "CONTACT": ["id", "full_name", "email", "phone", "label", "version"],
    "LISTING": ["id", "mls_id", "price", "currency", "title", "subtitle", "contact_id", "version"],
    "TRANSACTION": ["id", "title", "subtitle", "total", "currency", "status", "version", "contact_id", "listing_id"],
}


def public_view(df: DataFrame, entity: str) -> DataFrame:
    return df.select(*PUBLIC_COLUMNS[entity])


def _entity_search(df: DataFrame, tenant: str, q: str | None, first: int | None, columns: Sequence[str],
                   order: str, prefix: bool, escape_wildcards: bool) -> DataFrame:
    term = (q or "").strip("".join(map(chr, range(33)))).lower()
    rows = live_rows(tenant_scope(df, tenant))
    if not term:
        return rows.where(F.lit(False))
    hit = None
    for c in columns:
        m = sql_literal_like(F.lower(F.coalesce(F.col(c), F.lit(""))), term, prefix, escape_wildcards)
        hit = m if hit is None else hit | m
    return rows.where(hit).orderBy(F.lower(order), "id").limit(search_limit(first))


def contact_prefix_search(df: DataFrame, tenant: str, q: str | None, first: int | None = None,
                          escape_wildcards: bool = False) -> DataFrame:
    """Contacts whose name, e-mail or phone starts with the term."""
    return _entity_search(df, tenant, q, first, ["full_name", "email", "phone"], "full_name", True, escape_wildcards)


def contact_prefix_batch(df: DataFrame, searches: DataFrame, escape_wildcards: bool = False) -> DataFrame:
    """Many contact searches at once: ``searches`` has search, tenant_id, q and first (see
    :func:`contact_prefix_search`, whose rows and order each search gets). Returns search, position
    (from 1), id, full_name and email.

    Contacts are scanned once. Each offers the beginnings of its fields in the lengths that its
    tenant's terms have, and an equi join on (tenant, beginning) finds the terms, so that no term
    meets a contact that does not begin like it, however long a beginning all contacts share. Equal
    searches are answered once. A wildcard term is joined by what stands before its first wildcard
    and then verified. The first rows are taken per task before the shuffle. Blank terms and
    searches without tenant find nothing.
    """
    # Spark's lower and Python's agree but for a few letters outside the usual alphabets
    term = F.lower(control_trim("q"))
    asked = (searches.where("tenant_id is not null and trim(tenant_id) <> ''")
             .select("search", F.col("tenant_id").alias("tenant"), term.alias("term"),
                     F.when((F.col("first") > 0) & (F.col("first") <= SEARCH_MAX), F.col("first")).otherwise(SEARCH_DEFAULT).cast("int").alias("upto"))
             .where("term <> ''"))
    wild = F.lit(False) if escape_wildcards else F.col("term").rlike("[%_\\\\]")
    terms = (asked.select("tenant", "term", "upto").distinct()
             .withColumn("pattern", F.when(wild, like_pattern(F.concat("term", F.lit("%")))))
             .withColumn("beginning", F.when(wild, F.regexp_extract("term", "^[^%_\\\\]*", 0)).otherwise(F.col("term"))))
    lengths = terms.groupBy("tenant").agg(F.collect_set(F.char_length("beginning")).alias("lengths"))
    offered = (live_rows(df).join(lengths, F.col("tenant_id") == F.col("tenant"))
               .select("tenant", "id", "full_name", "email",
                       F.expr("transform(array(full_name, email, phone), x -> lower(coalesce(x, '')))").alias("fields"), "lengths")
               .withColumn("beginning", F.explode(F.expr(
                   "array_distinct(flatten(transform(fields, x -> transform(filter(lengths, n -> n <= char_length(x)), n -> left(x, n)))))"))))
    hits = (offered.drop("lengths").join(terms, ["tenant", "beginning"])
            .where("pattern is null or exists(fields, x -> x like pattern)"))
    w = Window.partitionBy("tenant", "term", "upto").orderBy(F.lower("full_name"), "id")
    top = hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= SEARCH_MAX).where("position <= upto")
    return (asked.join(top.select("tenant", "term", "upto", "position", "id", "full_name", "email"), ["tenant", "term", "upto"])
            .select("search", "position", "id", "full_name", "email"))


def listing_search(df: DataFrame, tenant: str, q: str | None, first: int | None = None,
                   escape_wildcards: bool = False) -> DataFrame:
    """Listings whose title, subtitle or MLS id contains the term."""
    return _entity_search(df, tenant, q, first, ["title", "subtitle", "mls_id"], "title", False, escape_wildcards)


def transaction_search(df: DataFrame, tenant: str, q: str | None, first: int | None = None,
                       escape_wildcards: bool = False) -> DataFrame:
    """Transactions whose title or subtitle contains the term."""
    return _entity_search(df, tenant, q, first, ["title", "subtitle"], "title", False, escape_wildcards)
