import datetime as dt
import random

from pyspark.sql import functions as F

from larkseek import fixtures as X
from larkseek.operators import metrics as ME
from larkseek.operators import reads as RD
from larkseek.sources.page_index import page_at, write_paged


def test_pages_equal_the_offset_scan(spark, sf, tmp_path):
    tx = X.transactions(spark, sf)
    write_paged(tx, str(tmp_path), run_rows=16)
    for tenant, offset, limit in (("t0", 0, 10), ("t1", 15, 2), ("t1", 100, 50), ("t2", 300, 100), ("t3", 10 ** 6, 5), ("nobody", 0, 5)):
        want = [r["id"] for r in RD.entity_page(tx, tenant, offset, limit).collect()]
        got = page_at(spark, str(tmp_path), tenant, offset, limit).orderBy("position").collect()
        assert [r["id"] for r in got] == want and [r["position"] for r in got] == list(range(offset, offset + len(want)))
    deep = page_at(spark, str(tmp_path), "t1", 200, 5)
    # at most the page and the runs at its ends are read
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id," in plan[plan.index("PushedFilters"):]
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert runs.agg(F.max("n")).first()[0] <= 16 and runs.agg(F.sum("n")).first()[0] == RD.live_rows(tx).count()
    write_paged(tx.where("false"), f"{tmp_path}/none")
    assert page_at(spark, f"{tmp_path}/none", "t1", 0, 5).collect() == []


def test_merged_sketches_keep_their_rank(spark):
    """Hourly sketches of a skewed log, one hot tenant, one group of a single row."""
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.7 else "t", "ok", dt.datetime(2024, 1, 1, k % 24), float(int(rng.expovariate(0.01)))) for k in range(20_000)] + [("one", "ok", dt.datetime(2024, 1, 1), 7.0)]
    log = spark.createDataFrame(rows, "tenant_id string, result string, ts timestamp, latency_ms double").repartition(4)
    sketches = ME.latency_sketches(log)
    assert sketches.count() == 49
    got = ME.rank_errors(log, ME.latency_quantiles(sketches, (0.5, 0.95, 0.99))).collect()
    assert len(got) == 9 and all(r["rank_error"] <= 0.02 for r in got)
    assert {r["value"] for r in got if r["tenant_id"] == "one"} == {7.0} and sum(r["n"] for r in got if r["p"] == 0.5) == 20_001
    exact = {r["tenant_id"]: r["p95_ms"] for r in ME.latency_percentiles(log).collect()}
    assert all(abs(r["value"] - exact[r["tenant_id"]]) < 60 for r in got if r["p"] == 0.95)
