import pytest
from pyspark.sql import functions as F

from larkseek import fixtures as X
from larkseek.operators import quality as QU
from larkseek.operators import reads as RD

CONTACT = "id string, tenant_id string, full_name string, email string, phone string, deleted_at timestamp"


def one_by_one(contacts, searches, escape):
    out = []
    for search, tenant, q, first in searches:
        if tenant and tenant.strip():
            hits = RD.contact_prefix_search(contacts, tenant, q, first, escape).select("id", "full_name", "email").collect()
            out += [(search, n + 1, *h) for n, h in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("escape", [False, True])
def test_batch_equals_single_searches(spark, escape):
    rows = [("1", "t", "Ann", "ann@x", None, None), ("2", "t", "ann b", "b@x", "+1 2", None), ("3", "t", None, "Ann@y", "+1 3", None), ("4", "u", "Ann", None, None, None),
            ("5", "t", "a%b", "a_b@x", "", None), ("6", "t", "Zed", "zed@x", "+1 2", None), ("7", "t", "ANN", "ann@z", None, None)]
    rows += [(f"c{k}", "t", "common name", "common@x", None, None) for k in range(150)]
    contacts = spark.createDataFrame(rows, CONTACT).repartition(3)
    searches = [(1, "t", "ann", 2), (2, "t", " ANN\t", 2), (3, "t", "", 5), (4, "t", None, 5), (5, "u", "a", None), (6, "t", "a%b", 9), (7, "t", "%x", 100), (8, "t", "_nn", 5),
                (9, None, "ann", 5), (10, "t", "common", 100), (11, "t", "common", 101), (12, "t", "c", -1), (13, "nobody", "a", 5), (14, "t", "+1 ", 3), (15, "t", "a" * 60, 3)]
    batch = RD.contact_prefix_batch(contacts, spark.createDataFrame(searches, "search long, tenant_id string, q string, first int"), escape)
    assert sorted(tuple(r) for r in batch.collect()) == one_by_one(contacts, searches, escape)
    none = spark.createDataFrame([], "search long, tenant_id string, q string, first int")
    assert RD.contact_prefix_batch(contacts, none).collect() == []
    assert RD.contact_prefix_batch(contacts.where("false"), none).collect() == []


def test_only_contacts_that_begin_alike_meet_a_term(spark, sf):
    """All names share a long beginning; the join is on whole terms and ranks are cut before the shuffle."""
    contacts = X.contacts(spark, sf)
    searches = X.customer_queries(spark, sf).select(F.col("query_id").alias("search"), "tenant_id", "q", F.lit(5).alias("first"))
    plan = RD.contact_prefix_batch(contacts, searches)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_gate_writes_counts_and_refuses(spark, sf, tmp_path):
    df = X.contacts_raw(spark, sf)
    bad = {"no_email": F.col("email").isNull(), "no_id": F.col("id").isNull()}
    missing = df.where("email is null").count()
    assert missing > 0
    with pytest.raises(QU.GateError) as e:
        QU.gated_write(df, f"{tmp_path}/a", bad)
    assert e.value.counts == {"n_rows": df.count(), "no_email": missing, "no_id": 0} and not (tmp_path / "a").exists()
    assert QU.gated_write(df, f"{tmp_path}/a", bad, {"no_email": missing})["no_email"] == missing
    assert spark.read.parquet(f"{tmp_path}/a").count() == df.count()
    with pytest.raises(Exception, match="(?i)exists"):
        QU.gated_write(df, f"{tmp_path}/a", {})
    assert spark.read.parquet(f"{tmp_path}/a").count() == df.count()
    assert QU.gated_write(df.where("false"), f"{tmp_path}/none", bad) == {"n_rows": 0, "no_email": 0, "no_id": 0}
    with pytest.raises(ValueError, match="n_rows"):
        QU.gated_write(df, f"{tmp_path}/b", {"n_rows": F.lit(True)})
