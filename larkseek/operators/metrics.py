"""Request counters, latency objectives and masking over the query log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkseek.functions.text import mask_pii, query_reject_reason

# Latency objectives in milliseconds.
SLO_MS = (100, 200, 400)


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("tenant_id", "result").agg(F.count("*").alias("requests"))


def latency_slo(log: DataFrame) -> DataFrame:
    """Count, cumulative objective buckets and sketch p95/p99 per tenant and result.

    All aggregates merge before the shuffle and have a bounded state whatever the size of a tenant.
    """
    return log.groupBy("tenant_id", "result").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("latency_ms") <= b).alias(f"le_{b}") for b in SLO_MS],
        F.max("latency_ms").alias("max_ms"),
        F.percentile_approx("latency_ms", F.lit(0.95)).alias("p95_ms"),
        F.percentile_approx("latency_ms", F.lit(0.99)).alias("p99_ms"))


def latency_percentiles(log: DataFrame, points: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """Exact nearest-rank percentiles per tenant and result.

    A histogram of whole milliseconds (one row per group and millisecond, small whatever the log)
    locates the millisecond of each rank; only rows of those milliseconds are then counted by value
    and ranked. No group is sorted as a whole.
    """
    group = ["tenant_id", "result"]
    ms = F.floor("latency_ms").alias("ms")
    hist = log.groupBy(*group, ms).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*group)
    run = hist.select(*group, "ms", "c", F.sum("c").over(w).alias("n"),
                      F.sum("c").over(w.orderBy("ms")).alias("upto"))
    wanted = run.select(*group, "ms", "c", "n", "upto", F.explode(F.array(*map(F.lit, points))).alias("p"))
    rank = F.greatest(F.ceil(F.round(F.col("p") * F.col("n"), 9)), F.lit(1))
    spots = (wanted.withColumn("rank", rank).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
             .select(*group, "ms", "p", "n", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("inner_rank")))
    values = log.withColumn("ms", F.floor("latency_ms")).groupBy(*group, "ms", "latency_ms").agg(F.count("*").alias("c"))
    inside = values.join(spots, [*group, "ms"])
    w2 = Window.partitionBy(*group, "p").orderBy("latency_ms")
    found = inside.withColumn("upto", F.sum("c").over(w2)).where(F.col("upto") >= F.col("inner_rank"))
    return found.groupBy(*group, "n").agg(
        *[F.min(F.when(F.col("p") == p, F.col("latency_ms"))).alias(f"p{round(p * 100)}_ms") for p in points])


# Size parameter of the quantile sketches: about 0.7 % normalised rank error (99 % confidence).
SKETCH_K = 400


def latency_sketches(log: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One quantile sketch per tenant, result and hour, small enough to be kept: sketches of any
    hours merge later without the log."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    return log.groupBy("tenant_id", "result", hour).agg(F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(k)).alias("sketch"))


def latency_quantiles(sketches: DataFrame, points: Sequence[float] = (0.95, 0.99), k: int = SKETCH_K) -> DataFrame:
    """Approximate percentiles per tenant and result from merged sketches: tenant_id, result, n, p,
    value, one row per point."""
    merged = sketches.groupBy("tenant_id", "result").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    found = [F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in points]
    return (merged.select("tenant_id", "result", F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(F.array(*found)).alias("q"))
            .select("tenant_id", "result", "n", "q.p", "q.value"))


def rank_errors(log: DataFrame, quantiles: DataFrame) -> DataFrame:
    """``quantiles`` with ``rank_error``, the distance of p from the exact ranks that the value has in
    the log (0 if it lies between them). Ranks are counts, which combine before the shuffle."""
    keys = ["tenant_id", "result", "p", "value"]
    ranks = (log.select("tenant_id", "result", "latency_ms").join(quantiles.select(*keys), ["tenant_id", "result"]).groupBy(*keys)
             .agg(F.count("*").alias("rows"), F.count_if(F.col("latency_ms") < F.col("value")).alias("below"), F.count_if(F.col("latency_ms") <= F.col("value")).alias("upto")))
    return quantiles.join(ranks, keys).withColumn("rank_error", F.greatest(
        F.lit(0.0), F.col("below") / F.col("rows") - F.col("p"), F.col("p") - F.col("upto") / F.col("rows"))).drop("below", "upto", "rows")


def masked_log(log: DataFrame) -> DataFrame:
    """Query log with personal data masked and the reason a text should have been refused."""
    return log.withColumn("reject_reason", query_reject_reason("q")).withColumn("q", mask_pii("q"))
