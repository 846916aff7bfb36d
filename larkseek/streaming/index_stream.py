"""Continuous index maintenance: records to actions to the item store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkseek.operators import events as EV
from larkseek.operators.index import merge_into_table
from larkseek.sources.event_log import spread_records
from larkseek.sources.item_store import ItemStore


def _query_id(batch: DataFrame) -> str:
    """Id of the running stream, which its checkpoint keeps over restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def start_index_stream(records: DataFrame, store: ItemStore, checkpoint: str, available_now: bool = False,
                       every: str = "1 second", compact_every: int | None = 100) -> StreamingQuery:
    """Apply a record stream of any handled topics to the store, skipped records to ``dead/`` beside it.

    Bad records never stop the stream. Batches run one after another and each key comes from one
    source partition, so arrival order per key holds. Both outputs are named after the stream's id
    and the batch: replaying a batch after a failure changes nothing, and a stream with a new
    checkpoint has a new id. After ``compact_every`` batches the store is compacted. A batch's records,
    which may lie in few files or partitions, are spread over tasks before they are parsed.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        stream = _query_id(batch)
        actions = EV.event_actions(spread_records(batch)).persist()
        store.append_batch(actions, batch_id, stream)
        write_dead_letters(actions, f"{store.path}/dead", stream, batch_id)
        actions.unpersist()
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact()

    return _start(records, apply, checkpoint, available_now, every)


def start_table_merge(records: DataFrame, table: str, checkpoint: str, dead: str, available_now: bool = False,
                      every: str = "1 second") -> StreamingQuery:
    """The same into a table whose format supports MERGE; skipped records go to the folder ``dead``."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        actions = EV.event_actions(spread_records(batch)).persist()
        merge_into_table(actions, table)
        write_dead_letters(actions, dead, _query_id(batch), batch_id)
        actions.unpersist()

    return _start(records, apply, checkpoint, available_now, every)


def write_dead_letters(actions: DataFrame, folder: str, stream: str, batch_id: int) -> None:
    EV.dead_letters(actions).write.mode("overwrite").parquet(f"{folder}/stream={stream}/batch_id={batch_id}")


def _start(records: DataFrame, apply, checkpoint: str, available_now: bool, every: str) -> StreamingQuery:
    writer = records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
