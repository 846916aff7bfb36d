"""Index maintenance that trusts the version in the payload, over any number of batches and restarts.

A streaming aggregate keeps the newest record (by version, then arrival) of every item key, of deleted
ones too, as a tombstone, and combines before its shuffle. A record that is older than that changes
nothing, however late it comes; so the table does not depend on how records are cut into batches. State is spread by key and lives in the
checkpoint; a run that ends and starts again from it goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkseek.operators import events as EV
from larkseek.schemas import ITEM_KEY
from larkseek.sources.event_log import spread_records
from larkseek.sources.item_store import ItemStore

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _settings(spark: SparkSession, **wanted: str | None) -> Iterator[None]:
    """Session settings that a query takes over when it starts."""
    names = {"spark.sql.shuffle.partitions": wanted["partitions"], _PROVIDER: wanted["provider"]}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        if v is not None:
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def newest_actions(records: DataFrame) -> DataFrame:
    """The records of a stream that change their key, at most one per key and batch. The state gives
    every key that a batch names; those whose newest record came with an earlier batch are left out."""
    actions = EV.effective(EV.event_actions(spread_records(records))).select(
        *ITEM_KEY, "action", "title", "subtitle", F.coalesce("version", F.lit(-1)).cast("long").alias("version"), F.col("partition").cast("int").alias("partition"), "offset",
        # the time of a batch, the same in all of its rows
        F.current_timestamp().alias("seen"))
    value = F.struct("action", "title", "subtitle", "version", "partition", "offset", "seen")
    newest = actions.groupBy(*ITEM_KEY).agg(F.max_by(value, F.struct("version", "partition", "offset")).alias("_last"))
    return newest.select(*ITEM_KEY, "_last.*").where(F.col("seen") == F.current_timestamp()).drop("seen")


def start_versioned_stream(records: DataFrame, store: ItemStore, checkpoint: str, available_now: bool = False, every: str = "1 second",
                           state_partitions: int | None = None) -> StreamingQuery:
    """Apply a record stream to the store in the order of payload versions. ``state_partitions`` is
    fixed by the first run of a checkpoint."""
    spark = records.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.append_batch(batch, batch_id, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))

    with _settings(spark, partitions=str(state_partitions) if state_partitions else None,
                   provider="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        writer = newest_actions(records).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
