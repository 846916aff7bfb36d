"""Contiguous shards of nearly equal bytes from global prefix sums. DataFrame functions only.

One pass over the texts writes (id, size, checksum). Those slim rows are dealt into ranges of the id
order; sums per range give each range its start, and a running sum inside a range gives each row its
global byte offset. Cuts at equal targets make shards contiguous in id order, with sizes that differ
by less than the largest document. Texts are never shuffled.

Law ``bytes``: a row belongs to the shard in which the middle of its bytes falls, so a shard misses
its target by at most half a document at either end.

Defined cases: a null text has no bytes and checksum 0 (size is the overhead alone); null ids come
first; rows of one id are ordered by checksum and then as read, and may be cut apart, so an id or a
text that many rows share is spread like any others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkseek.llm.common import ranged, scratch, start_of_parts, stored

SHARDS = 24
OVERHEAD = 8


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = stored(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + F.lit(overhead)).cast("long").alias("size"),
                              F.crc32(whole.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("nth")), scratch(spark, "sizes"))
    rows = ranged(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("nth")], scratch(spark, "ranges"), "part")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    starts = start_of_parts(totals, [], "part", {"bytes": "bytes_before", "n": "rows_before"})
    whole_bytes = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    w = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "nth").rowsBetween(Window.unboundedPreceding, 0)
    # starts: one row per range
    placed = (rows.select("*", F.sum("size").over(w).alias("bytes_to"), F.count(F.lit(1)).over(w).alias("rows_to"))
              .join(F.broadcast(starts), "part")
              .select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("rows_to")).alias("nth_row"),
                      (2 * (F.col("bytes_before") + F.col("bytes_to")) - F.col("size")).cast("decimal(38,0)").alias("twice_middle")))
    placed = stored(placed.withColumn("shard", F.least(F.expr(f"twice_middle * {shards} div {max(2 * whole_bytes, 1)}").cast("int"), F.lit(shards - 1)))
                    .drop("twice_middle"), scratch(spark, "placed"))
    firsts = placed.groupBy("shard").agg(F.min("nth_row").alias("first_row"))
    # firsts: one row per shard
    return (placed.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth_row") - F.col("first_row")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
