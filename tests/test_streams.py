"""Stores and streams: batch splits, replays, dead letters, outbox publishing."""

import pytest
from pyspark.sql import functions as F

from larkseek import fixtures as X
from larkseek.operators import events as EV
from larkseek.operators import index as IX
from larkseek.operators import quality as Q
from larkseek.plans import catalog as CA
from larkseek.plans import load_catalog
from larkseek.session import shared_dir
from larkseek.sources import event_log as EL
from larkseek.sources import tables as TB
from larkseek.sources.item_store import ItemStore
from larkseek.streaming.index_stream import start_index_stream


def rows(df):
    return sorted(map(tuple, df.select("tenant_id", "entity_type", "entity_id", "title", "subtitle").collect()), key=repr)


def test_file_stream_equals_batch(spark, sf, tmp_path):
    rec = X.contact_events(spark, sf)
    # one file per range of offsets, read one file per trigger: several micro-batches in order
    for k in range(3):
        rec.where(F.floor(F.col("offset") / 334) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = ItemStore(spark, str(tmp_path / "store")).create()
    stream = EL.file_records(spark, str(tmp_path / "in"), files_per_trigger=1)
    start_index_stream(stream, store, str(tmp_path / "cp"), available_now=True).awaitTermination()
    want = IX.latest_actions(EV.event_actions(rec), ["offset"]).where("action = 'UPSERT'")
    assert rows(store.current()) == rows(want)
    assert spark.read.parquet(str(tmp_path / "store/dead")).count() == EV.dead_letters(EV.event_actions(rec)).count()
    before = rows(store.current())
    assert store.compact() == 2
    assert store.generation() == 2 and rows(store.current()) == before
    assert store.compact() == 2


def test_quarters_read_their_own_range(spark, sf, capsys):
    """Every record is in its quarter, and a quarter asks the scan for its range and counts nothing anew."""
    span = X.contact_events(spark, sf).agg(F.max("offset")).first()[0]
    parts = CA._quarters(spark, sf)
    got = sorted((r.offset, k) for k, part in enumerate(parts) for r in part.select("offset").collect())
    assert got == [(r.offset, r.offset * 4 // (span + 1)) for r in X.contact_events(spark, sf).select("offset").orderBy("offset").collect()]
    for part in parts:
        part.explain()
        plan = capsys.readouterr().out
        assert "GreaterThanOrEqual(event_id" in plan and "LessThan(event_id" in plan and "ubquery" not in plan


def test_quarters_of_no_events(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").where("false").write.parquet(str(tmp_path / "events.parquet"))
    assert [part.count() for part in CA._quarters(spark, str(tmp_path))] == [0] * 4


def test_split_and_replay(spark, sf):
    cat = load_catalog()
    one = rows(cat["apply_actions"](spark, sf))
    assert rows(cat["stream_replay"](spark, sf)) == one
    assert rows(cat["replay_idempotent"](spark, sf)) == one


def test_tenant_partitions_prune(spark, sf, tmp_path):
    TB.write_by_tenant(X.contacts(spark, sf), str(tmp_path / "c"))
    df = TB.read_entity(spark, str(tmp_path / "c"), "contacts").where("tenant_id = 't1'")
    assert df.count() == X.contacts(spark, sf).where("tenant_id = 't1'").count()
    assert "PartitionFilters: [isnotnull(tenant_id" in df._jdf.queryExecution().executedPlan().toString()


def test_gate(spark):
    Q.assert_no_rows(spark.range(0), "fine")
    with pytest.raises(ValueError, match="bad: 3 rows"):
        Q.assert_no_rows(spark.range(3), "bad")


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)


def _actions(spark, *rows):
    return spark.createDataFrame([("t", "CONTACT", *r, 0, i) for i, r in enumerate(rows)],
                                 "tenant_id string, entity_type string, entity_id string, action string, title string, subtitle string, partition int, offset bigint")


def test_batches_of_a_restarted_stream_are_kept(spark, tmp_path):
    """Three batches, a compaction, then batch 0 of another stream, before and after its own compaction."""
    store = ItemStore(spark, str(tmp_path / "store")).create()
    for k in range(3):
        assert store.append_batch(_actions(spark, (f"c{k}", "UPSERT", "x", None)), k, "one")
    assert store.compact() == 2
    assert store.append_batch(_actions(spark, ("new", "UPSERT", "y", None), ("c1", "DELETE", None, None)), 0, "two")
    want = [("t", "CONTACT", "c0", "x", None), ("t", "CONTACT", "c2", "x", None), ("t", "CONTACT", "new", "y", None)]
    assert rows(store.current()) == want
    assert store.compact() == 3 and rows(store.current()) == want


def test_batches_are_applied_once_or_refused(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path / "store")).create()
    assert store.append_batch(_actions(spark, ("a", "UPSERT", "x", None)), 0)
    assert not store.append_batch(_actions(spark, ("a", "UPSERT", "x", None)), 0)
    with pytest.raises(ValueError, match="other changes"):
        store.append_batch(_actions(spark, ("a", "UPSERT", "other", None)), 0)
    with pytest.raises(ValueError, match="holds a store"):
        ItemStore(spark, str(tmp_path / "store")).create()


def test_half_written_batches_are_not_read(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path / "store")).create()
    store.append_batch(_actions(spark, ("a", "UPSERT", "x", None)), 0)
    # a folder whose writer died before the commit row
    _actions(spark, ("b", "UPSERT", "y", None)).select("tenant_id", "entity_type", "entity_id", "title", "subtitle", "action") \
        .write.parquet(f"{store.path}/delta/stream=main/batch_id=1")
    assert rows(store.current()) == [("t", "CONTACT", "a", "x", None)] and store.compact() == 0
    store.append_batch(_actions(spark, ("b", "UPSERT", "z", None)), 1)
    assert rows(store.current()) == [("t", "CONTACT", "a", "x", None), ("t", "CONTACT", "b", "z", None)]


def test_versions_order_records_over_runs(spark, tmp_path):
    """Late older records, a tombstone, equal versions and a restart from the checkpoint."""
    from larkseek.streaming.versioned_stream import start_versioned_stream

    def record(offset, key, version, kind="ContactUpdated"):
        number = "" if version is None else f',"version":{version}'
        body = f'{{"type":"{kind}","tenantId":"t","contactId":"{key}","title":"{key} {offset}","visible":true{number}}}'
        return ("contact.events.v1", 0, offset, f"t:{key}", body)

    runs = [[record(1, "a", 5), record(2, "a", 3), record(3, "b", 2, "ContactDeleted"), record(4, "c", None), record(5, "d", 7), record(6, "d", 7)],
            [record(7, "a", 4), record(8, "b", 1), record(9, "c", 0), record(10, "d", 9_007_199_254_740_993), record(11, "d", 9_007_199_254_740_992), record(12, "e", 1, "ContactDeleted")],
            [record(13, "b", 3), record(14, "e", 0), record(15, "a", 6, "ContactDeleted")]]
    store = ItemStore(spark, str(tmp_path / "store")).create()
    schema = "topic string, partition int, offset bigint, key string, value string"
    states = []
    for run in runs:
        spark.createDataFrame(run, schema).write.mode("append").parquet(str(tmp_path / "in"))
        before = spark.conf.get("spark.sql.shuffle.partitions")
        start_versioned_stream(EL.file_records(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), available_now=True, state_partitions=2).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        states.append({r["entity_id"]: r["title"] for r in store.current().collect()})
    assert states == [{"a": "a 1", "c": "c 4", "d": "d 6"}, {"a": "a 1", "c": "c 9", "d": "d 10"}, {"b": "b 13", "c": "c 9", "d": "d 10"}]


def test_versions_late_records_write_nothing(spark, tmp_path):
    """A key whose newest record came with an earlier batch is in no later delta; the state is native."""
    from larkseek.streaming.versioned_stream import newest_actions, start_versioned_stream

    store = ItemStore(spark, str(tmp_path / "store")).create()
    for offset, version, key in ((1, 5, "a"), (2, 3, "a"), (3, 6, "b")):
        body = f'{{"type":"ContactUpdated","tenantId":"t","contactId":"{key}","title":"{key} {offset}","visible":true,"version":{version}}}'
        spark.createDataFrame([("contact.events.v1", 0, offset, f"t:{key}", body)], "topic string, partition int, offset bigint, key string, value string") \
            .write.mode("append").parquet(str(tmp_path / "in"))
        stream = EL.file_records(spark, str(tmp_path / "in"))
        start_versioned_stream(stream, store, str(tmp_path / "cp"), available_now=True, state_partitions=2).awaitTermination()
    assert {r["place"]: r["n"] for r in store.commits().collect()} == {0: 1, 1: 0, 2: 1}
    assert sorted(r["title"] for r in store.current().collect()) == ["a 1", "b 3"]
    plan = newest_actions(stream)._jdf.queryExecution().analyzed().toString()
    assert "InPandas" not in plan and "InPySpark" not in plan


def test_records_of_one_file_are_spread(spark, tmp_path):
    """The dead letters of a batch come from more tasks than the batch has files."""
    records = [("contact.events.v1", 0, i, "k", "{broken") for i in range(200)]
    spark.createDataFrame(records, "topic string, partition int, offset bigint, key string, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    store = ItemStore(spark, str(tmp_path / "store")).create()
    start_index_stream(EL.file_records(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), available_now=True).awaitTermination()
    dead = spark.read.parquet(f"{store.path}/dead")
    assert dead.count() == 200 and len(dead.inputFiles()) > 1
