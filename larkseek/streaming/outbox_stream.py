"""Outbox publisher: unpublished rows to topics, continuously."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkseek.operators import outbox as OB
from larkseek.sources.event_log import write_topic_files

# Fixed value: pause between polls.
POLL_EVERY = "200 milliseconds"


def start_outbox_stream(outbox: DataFrame, path: str, checkpoint: str, publish: Callable[[DataFrame], None] | None = None,
                        available_now: bool = False, poll_rows: int | None = None) -> StreamingQuery:
    """Publish appended outbox rows; the checkpoint is the published mark.

    Rows go to ``publish`` (for example a broker writer) or to files under ``path/topics``. The
    batch is marked done only after the write returned. Unsupported types land in ``path/rejected``
    and do not hold up the others. With ``poll_rows`` the written rows name, as ``poll``, the poll of
    that many rows in id order, counted from 0 in each batch, that they belong to: the source's own number if its
    rows have one, else they are counted in one task.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        numbered = "poll" in batch.columns
        routed = OB.route(OB.unpublished(batch, limit=None), *["poll"] if poll_rows is not None and numbered else [])
        if poll_rows is not None and not numbered:
            routed = routed.withColumn("poll", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / poll_rows))
        routed = routed.persist()
        good = OB.routable(routed)
        if publish is not None:
            publish(good)
        else:
            write_topic_files(good, f"{path}/topics/batch_id={batch_id}")
        OB.rejected(routed).write.mode("overwrite").parquet(f"{path}/rejected/batch_id={batch_id}")
        routed.unpersist()

    writer = outbox.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=POLL_EVERY)
    return writer.start()
