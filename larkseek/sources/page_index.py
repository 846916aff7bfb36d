"""Deep offset pages from an order-statistic index: rows in id order, and per run of rows its first and
last id and the number of rows before it. An offset names one or two runs, whose ids become a range
that is pushed into the scan; nothing before the page is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkseek.operators.reads import live_rows, page_bounds

RUN_ROWS = 4096


def write_paged(df: DataFrame, path: str, run_rows: int = RUN_ROWS) -> None:
    """Live rows of an entity table sorted by (tenant, id), and their index."""
    live_rows(df).repartitionByRange("tenant_id", "id").sortWithinPartitions("tenant_id", "id").withColumn(
        "nth", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    runs = (spark.read.parquet(f"{path}/rows").groupBy("tenant_id", F.expr("shiftright(nth, 33)").alias("part"), F.expr(f"(nth & ((1L << 33) - 1)) div {run_rows}").alias("run"))
            .agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")))
    here = Window.partitionBy("tenant_id", "part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # one row per tenant and range
    parts = runs.groupBy("tenant_id", "part").agg(F.sum("n").alias("in_part"))
    before = Window.partitionBy("tenant_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("tenant_id", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("earlier"))
    (runs.withColumn("inside", F.coalesce(F.sum("n").over(here), F.lit(0))).join(starts, ["tenant_id", "part"])
     .select("tenant_id", "first_id", "last_id", "n", (F.col("earlier") + F.col("inside")).alias("rows_before"))
     .sortWithinPartitions("tenant_id", "rows_before").write.mode("overwrite").parquet(f"{path}/runs"))


def page_at(spark: SparkSession, path: str, tenant: str, offset: int | None = 0, limit: int | None = None) -> DataFrame:
    """The page that :func:`larkseek.operators.reads.entity_page` returns, in id order, with
    ``position`` (0-based). The driver learns three numbers; a task sorts at most the page and two runs."""
    offset, limit = page_bounds(offset, limit)
    runs = spark.read.parquet(f"{path}/runs").where((F.col("tenant_id") == tenant) & (F.col("rows_before") < offset + limit) & (F.col("rows_before") + F.col("n") > offset))
    first, last, before = runs.agg(F.min("first_id"), F.max("last_id"), F.min("rows_before")).first()
    rows = spark.read.parquet(f"{path}/rows").where((F.col("tenant_id") == tenant) & F.col("id").between(first if first is not None else "", last if last is not None else ""))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("id")) - 1 + F.lit(before or 0)
    return rows.where(F.lit(first is not None)).drop("nth").withColumn("position", place.cast("long")).where((F.col("position") >= offset) & (F.col("position") < offset + limit))
