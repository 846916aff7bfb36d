"""Transactional outbox as a table: append, poll, route, mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkseek.functions.text import entity_key
from larkseek.schemas import TOPICS

# Fixed value: rows one poll takes.
POLL_ROWS = 500
# Polls a batch takes at most to drain a backlog: its rows are read by tasks, its ids (8 bytes each) by the driver.
DRAIN_POLLS = 4096


def unpublished(outbox: DataFrame, limit: int | None = POLL_ROWS) -> DataFrame:
    """Oldest unpublished rows first; ``limit=None`` takes all of them (a batch drain)."""
    rows = outbox.where(~F.col("published"))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def topic_of(aggregate_type: Column | str) -> Column:
    """Topic of an aggregate type, null when unsupported."""
    c = F.col(aggregate_type) if isinstance(aggregate_type, str) else aggregate_type
    out = None
    for entity, topic in TOPICS.items():
        out = F.when(c == entity, topic) if out is None else out.when(c == entity, topic)
    return out


def route(outbox: DataFrame, *more: str) -> DataFrame:
    """Add topic, record key ``tenant:id`` and value; unsupported types get a reject reason
    instead of stopping the batch. Columns named in ``more`` are kept."""
    topic = topic_of("aggregate_type")
    return outbox.select(
        "id", topic.alias("topic"),
        entity_key("tenant_id", F.coalesce("aggregate_id", F.lit("null"))).alias("key"),
        F.col("payload").alias("value"),
        F.when(topic.isNull(), F.concat(F.lit("unsupported_type:"), F.coalesce("aggregate_type", F.lit("null"))))
        .alias("reject_reason"), *more)


def routable(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reject_reason").isNull())


def rejected(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reject_reason").isNotNull())


def mark_published(outbox: DataFrame, batch: DataFrame, published_at: Column) -> DataFrame:
    """Outbox with the ids of ``batch`` marked; other rows unchanged. The batch ids are unique, so
    the left join cannot multiply rows."""
    done = batch.select("id").distinct().withColumn("_done", F.lit(True))
    hit = F.col("_done").isNotNull()
    return (outbox.join(done, "id", "left")
            .withColumn("published", F.col("published") | hit)
            .withColumn("published_at", F.when(hit, published_at).otherwise(F.col("published_at")))
            .drop("_done"))


def append(outbox: DataFrame, new_rows: DataFrame, start_id: int | Column) -> DataFrame:
    """Outbox with new rows after it. Ids are ``start_id`` plus a unique, not dense, number; they
    grow within a partition, which is all the per-key order needs once rows are key-partitioned."""
    start = F.lit(start_id) if isinstance(start_id, int) else start_id
    return outbox.unionByName(new_rows.withColumn("id", start + F.monotonically_increasing_id()))
