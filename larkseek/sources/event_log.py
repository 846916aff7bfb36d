"""Event records: (topic, partition, offset, key, value) from a broker or from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkseek.operators.events import KINDS
from larkseek.schemas import EVENT_RECORD, TOPICS
from larkseek.session import spread

# Fixed value: the consumer's group.
GROUP = "search-indexer"


def kafka_records(spark: SparkSession, servers: str, starting: str = "latest",
                  max_per_trigger: int | None = None, **options: str) -> DataFrame:
    """Stream of the handled topics; reads committed records only. The user supplies the connector."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", ",".join(TOPICS[k.entity] for k in KINDS))
              .option("startingOffsets", starting).option("kafka.isolation.level", "read_committed")
              .option("groupIdPrefix", GROUP).options(**options))
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_per_trigger))
    return reader.load().select("topic", "partition", "offset", F.col("key").cast("string").alias("key"),
                                F.col("value").cast("string").alias("value"))


def file_records(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of record files with the same columns."""
    reader = spark.readStream.format(fmt).schema(EVENT_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.load(path)


def spread_records(records: DataFrame) -> DataFrame:
    """Records, which may lie in few files or partitions, over tasks before they are parsed; by their place,
    as rows without a key would be sorted first."""
    return spread(records, *[c for c in ("topic", "partition", "offset") if c in records.columns])


def write_kafka(routed: DataFrame, servers: str, **options: str) -> None:
    """Publish routed outbox rows (topic, key, value)."""
    (routed.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("kafka.acks", "all").option("kafka.enable.idempotence", "true").options(**options).save())


def write_topic_files(routed: DataFrame, path: str) -> None:
    """The same as files, one folder per topic, each key's rows in id order.

    Ranges over (topic, key, id) keep that order across files and still split a key that holds a
    large share of the rows.
    """
    (routed.repartitionByRange("topic", "key", "id").sortWithinPartitions("topic", "key", "id")
     .write.mode("overwrite").partitionBy("topic").parquet(path))
