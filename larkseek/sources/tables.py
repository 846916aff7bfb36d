"""Readers and writers of entity tables and of the search layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkseek import schemas
from larkseek.operators.ranking import with_search_columns

ENTITY_SCHEMAS = {"contacts": schemas.CONTACTS, "listings": schemas.LISTINGS, "transactions": schemas.TRANSACTIONS,
                  "outbox_events": schemas.OUTBOX, "search_items": schemas.SEARCH_ITEMS}


def read_entity(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Entity table with its explicit schema; a tenant filter on a table written by
    :func:`write_by_tenant` prunes whole folders."""
    return spark.read.format(fmt).schema(ENTITY_SCHEMAS[table]).load(path)


def write_by_tenant(df: DataFrame, path: str, *more: str, mode: str = "overwrite") -> None:
    """Write partitioned by tenant (and ``more`` columns).

    The rebalance hint lets adaptive execution split a tenant that holds a large share of the rows
    over many files and merge small tenants into few, instead of one file per task and tenant.
    """
    cols = ["tenant_id", *more]
    df.hint("rebalance", *cols).write.mode(mode).partitionBy(*cols).parquet(path)


def write_search_layout(items: DataFrame, path: str, mode: str = "simple") -> None:
    """Full index build: items with vectors, trigrams and probe windows, ready for queries. The texts are
    spread over the folders before those columns, many times their size, are made: in ranges of as many items each, so
    that tasks share that work evenly and a folder gets files by its size."""
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_search_columns(items.repartitionByRange(n, "tenant_id", "entity_type", "entity_id"), mode).write.mode("overwrite").partitionBy("tenant_id", "entity_type").parquet(f"{path}/items")


def write_gram_stats(spark: SparkSession, path: str) -> None:
    """Window counts of a written layout, used to pick selective probes."""
    from larkseek.plans.typeahead import gram_stats
    gram_stats(read_search_layout(spark, path)).write.mode("overwrite").parquet(f"{path}/gram_stats")


def read_search_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/items")


def read_gram_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/gram_stats")


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A relational table; with a numeric ``partition_column`` it is read in parallel ranges. The
    user supplies the driver jar."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", str(partitions)))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_rows: int = 5000, **options: str) -> None:
    (df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", str(batch_rows))
     .options(**options).mode(mode).save())
