"""Shared helpers of the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkseek.session import shared_dir

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; tables there are small against the input."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and every later reader
    sees the same rows, also after an executor is lost."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(value: str | None) -> bytes:
    return value.encode("utf-8", "surrogatepass") if value else b""


def blocks(data: bytes, separator: re.Pattern[bytes], size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Cut ``data`` at separators into blocks of about ``size`` bytes, so that word lists of very
    long texts stay small. No word is split."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            m = separator.search(data, end)
            end = m.start() if m else len(data)
        yield data[at:end]
        at = end


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{base}_{k}" for k in range(len(taken) + 1)) if n not in taken)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short row ranges of a batch; they bound the Python objects alive at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def output_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_if_present(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one if nothing was written there yet."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ranged(df: DataFrame, order: list[Column], path: str, part: str) -> DataFrame:
    """``df`` written in global order of ``order``: column ``part`` holds the number of the range.

    Ranges are sampled by Spark, so a hot leading key is split as long as the later keys of
    ``order`` tell its rows apart.
    """
    out = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn(part, F.spark_partition_id())
    return stored(out, path)


def start_of_parts(parts: DataFrame, keys: list[str], part: str, totals: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums over the ranges (within ``keys``): one row per range and key.

    ``totals`` maps an amount column to the name of its start. The window runs over one row per
    range (and key), not over data rows.
    """
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, part, *[F.coalesce(F.sum(a).over(w), F.lit(0).cast("long")).alias(s) for a, s in totals.items()])


def positions(df: DataFrame, key: str, order: list[str], name: str, label: str) -> DataFrame:
    """``df`` with the 0-based place of each row in its ``key`` group. Groups are cut into ranges,
    so a hot one is spread; only a group that began in an earlier range needs an offset, which is
    at most one row per range."""
    spark = df.sparkSession
    rows = ranged(df, [F.col(c) for c in (key, *order)], scratch(spark, label), "part")
    sizes = rows.groupBy("part", key).agg(F.count(F.lit(1)).alias("rows_here"))
    begun = start_of_parts(sizes, [key], "part", {"rows_here": "rows_before"}).where("rows_before > 0")
    w = Window.partitionBy("part", key).orderBy(*order)
    return (rows.withColumn("nth_here", F.row_number().over(w)).join(F.broadcast(begun), ["part", key], "left")
            .withColumn(name, F.col("nth_here") - 1 + F.coalesce("rows_before", F.lit(0)))
            .drop("part", "nth_here", "rows_before"))
