"""The search-item table: full build, last-event selection, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkseek.functions.text import blank_to_null, has_text
from larkseek.operators.reads import live_rows
from larkseek.schemas import ITEM_KEY
from larkseek.session import materialized


def item_rows(df: DataFrame, entity: str, title: str, subtitle: Column | None = None, id_col: str = "id") -> DataFrame:
    """Project rows of one entity to the search-item columns."""
    sub = F.lit(None).cast("string") if subtitle is None else subtitle
    return df.where(has_text(title)).select(
        "tenant_id", F.lit(entity).alias("entity_type"), F.col(id_col).alias("entity_id"),
        F.col(title).alias("title"), sub.alias("subtitle"))


def build_items(contacts: DataFrame, listings: DataFrame, transactions: DataFrame, *others: DataFrame) -> DataFrame:
    """Search items of all live entity rows; ``others`` are already item-shaped frames.

    A plain union of narrow projections: no shuffle, one scan per table.
    """
    mls_tail = F.nullif(F.concat(*[F.when(has_text(c), F.col(c)).otherwise("") for c in ("subtitle", "mls_id")]), F.lit(""))
    out = (item_rows(live_rows(contacts), "CONTACT", "full_name", blank_to_null("label"))
           .unionByName(item_rows(live_rows(listings), "LISTING", "title", mls_tail))
           .unionByName(item_rows(live_rows(transactions), "TRANSACTION", "title", blank_to_null("subtitle"))))
    for o in others:
        out = out.unionByName(o)
    return out


def latest_actions(actions: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """Last effective action per key, in arrival order by default.

    Skips are dropped first. ``max_by`` keeps one value per key and combines before the shuffle, so
    a key with a huge share of the events costs no more than any other.
    """
    order = order or [c for c in ("batch_id", "partition", "offset") if c in actions.columns]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    value = F.struct("action", "title", "subtitle", rank.alias("position"))
    picked = (actions.where(F.col("action") != "SKIP").groupBy(*ITEM_KEY)
              .agg(F.max_by(value, rank).alias("_last")))
    return picked.select(*ITEM_KEY, "_last.action", "_last.title", "_last.subtitle", "_last.position")


def latest_by_version(actions: DataFrame) -> DataFrame:
    """Variant that trusts the version in the payload; arrival order breaks ties. Deletes stay in
    the result as tombstones, so that a late older event cannot bring a row back."""
    return latest_actions(actions, [F.coalesce("version", F.lit(-1)), "partition", "offset"])


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace rows on (tenant, type, id). ``changes`` has one row per key and is written once:
    the anti join is pushed into every table that ``current`` unites, and each would make them anew."""
    changes = materialized(changes, "changes")
    return (current.join(changes.select(*ITEM_KEY), ITEM_KEY, "left_anti")
            .unionByName(changes.select(*ITEM_KEY, "title", blank_to_null("subtitle").alias("subtitle"))))


def delete(current: DataFrame, keys: DataFrame) -> DataFrame:
    return current.join(materialized(keys.select(*ITEM_KEY), "keys"), ITEM_KEY, "left_anti")


def delete_count(current: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: how many rows the delete affects."""
    return current.join(materialized(keys.select(*ITEM_KEY), "keys"), ITEM_KEY, "left_semi").agg(F.count("*").alias("deleted"))


def apply_actions(current: DataFrame, actions: DataFrame) -> DataFrame:
    """Fold a batch of classified events into the item table: one aggregation, written once, one anti join."""
    last = materialized(latest_actions(actions), "latest")
    kept = current.select(*ITEM_KEY, "title", "subtitle").join(last.select(*ITEM_KEY), ITEM_KEY, "left_anti")
    fresh = last.where(F.col("action") == "UPSERT").select(*ITEM_KEY, "title", "subtitle")
    return kept.unionByName(fresh)


def merge_into_table(spark_changes: DataFrame, table: str) -> None:
    """The same fold as a MERGE into a table whose format supports it."""
    last = latest_actions(spark_changes).alias("s")
    on = None
    for k in ITEM_KEY:
        c = F.col(f"s.{k}") == F.col(f"{table}.{k}")
        on = c if on is None else on & c
    values = {c: F.col(f"s.{c}") for c in (*ITEM_KEY, "title", "subtitle")}
    (last.mergeInto(table, on)
     .whenMatched(F.col("s.action") == "DELETE").delete()
     .whenMatched(F.col("s.action") == "UPSERT").update({c: values[c] for c in ("title", "subtitle")})
     .whenNotMatched(F.col("s.action") == "UPSERT").insert(values)
     .merge())
