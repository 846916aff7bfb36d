"""Event classification, projection and last-event selection."""

import json

from pyspark.sql import functions as F

from larkseek.operators import events as EV
from larkseek.operators import index as IX
from larkseek.operators import outbox as OB
from larkseek.schemas import EVENT_RECORD, SEARCH_ITEMS, TOPICS


def ev(kind="ContactCreated", tenant="t1", cid="7", title="Sam", visible=True, **more):
    body = {"type": kind, "tenantId": tenant, "contactId": cid, "title": title, "visible": visible, **more}
    return json.dumps({k: v for k, v in body.items() if v is not None})


def classify(spark, values, topic="CONTACT", **kw):
    rows = [(TOPICS[topic], 0, i, "k", v) for i, v in enumerate(values)]
    out = EV.event_actions(spark.createDataFrame(rows, EVENT_RECORD), **kw).orderBy("offset").collect()
    return [(r.action, r.skip_reason, r.title, r.subtitle) for r in out]


def test_contact_rules(spark):
    got = classify(spark, [
        ev(), ev("CONTACTUPDATED", subtitle=" VIP "), ev("ContactDeleted"), ev(visible=False, title=""), ev(visible=None),
        ev(title="  "), ev(tenant=" "), ev(cid=None), ev("ListingCreated"), "{bad", None, "", "3", ev(visible="true"), ev(visible=1),
        ev(visible="1"), ev(cid=12), ev(title={"a": 1}), ev(kind=None)])
    assert got == [
        ("UPSERT", None, "Sam", None), ("UPSERT", None, "Sam", "VIP"), ("DELETE", None, None, None), ("DELETE", None, None, None),
        ("DELETE", None, None, None), ("SKIP", "missing_title", None, None), ("SKIP", "missing_ids", None, None),
        ("SKIP", "missing_ids", None, None), ("SKIP", "unknown_type", None, None), ("SKIP", "bad_json", None, None),
        ("SKIP", "tombstone", None, None), ("SKIP", "bad_json", None, None), ("SKIP", "missing_ids", None, None),
        ("UPSERT", None, "Sam", None), ("UPSERT", None, "Sam", None), ("DELETE", None, None, None), ("UPSERT", None, "Sam", None),
        ("SKIP", "missing_title", None, None), ("SKIP", "unknown_type", None, None)]
    assert classify(spark, [ev(visible=None)], visible_default=True)[0][0] == "UPSERT"


def test_listing_subtitle_and_mls(spark):
    def li(**kw):
        return json.dumps({"type": "ListingCreated", "tenantId": "t", "listingId": "1", "title": "2BR", "visible": True, **kw})
    got = classify(spark, [li(subtitle="City", mlsId="MLS-1"), li(mlsId="MLS-1"), li(subtitle=" "), li(mls_id="MLS-1")], "LISTING")
    assert [g[3] for g in got] == ["CityMLS-1", "MLS-1", None, None]
    assert classify(spark, [li(mls_id="MLS-1")], "LISTING", accept_mls_snake=True)[0][3] == "MLS-1"


def test_last_effective_event(spark):
    rows = [(TOPICS["CONTACT"], 0, i, "k", v) for i, v in enumerate([
        ev(title="one", version=3), ev(title="two", version=2), ev(title=" "), "{bad"])]
    acts = EV.event_actions(spark.createDataFrame(rows, EVENT_RECORD))
    assert IX.latest_actions(acts).first().title == "two"
    assert IX.latest_by_version(acts).first().title == "one"


def test_upsert_delete_count(spark):
    cur = spark.createDataFrame([("t", "CONTACT", "1", "a", None), ("t", "CONTACT", "2", "b", "x")], SEARCH_ITEMS)
    ch = spark.createDataFrame([("t", "CONTACT", "2", "B", " "), ("u", "CONTACT", "1", "c", "y")], SEARCH_ITEMS)
    up = IX.upsert(cur, ch)
    assert {tuple(r) for r in up.collect()} == {("t", "CONTACT", "1", "a", None), ("t", "CONTACT", "2", "B", None), ("u", "CONTACT", "1", "c", "y")}
    assert IX.delete_count(cur, ch).first().deleted == 1
    assert {r.entity_id for r in IX.delete(cur, ch).collect()} == {"1"}


def test_outbox(spark):
    rows = [(3, "t", "CONTACT", "1", "X", "{}", False), (1, "t", "LISTING", "2", "X", "{}", True), (2, "u", "NOPE", None, "X", "{}", False)]
    box = spark.createDataFrame(rows, "id bigint, tenant_id string, aggregate_type string, aggregate_id string, type string, payload string, published boolean") \
        .withColumn("published_at", F.lit(None).cast("timestamp"))
    assert [r.id for r in OB.unpublished(box).collect()] == [2, 3]
    routed = {r.id: r for r in OB.route(box).collect()}
    assert routed[3].topic == "contact.events.v1" and routed[3].key == "t:1" and routed[3].reject_reason is None
    assert routed[2].topic is None and "NOPE" in routed[2].reject_reason
    marked = OB.mark_published(box, OB.unpublished(box, 1), F.current_timestamp()).orderBy("id").collect()
    assert [(r.id, r.published, r.published_at is not None) for r in marked] == [(1, True, False), (2, True, True), (3, False, False)]
    grown = OB.append(box, box.drop("id"), 100)
    assert grown.count() == 6 and grown.select("id").distinct().count() == 6


def test_bulk_delete_round_trip(spark):
    ids = spark.createDataFrame([("t1", str(i)) for i in range(25)] + [("t2", "x")], "tenant_id string, id string")
    bulk = EV.bulk_delete_payload("LISTING", ids, F.lit("2024-01-01").cast("timestamp"), rows_per_event=10)
    assert bulk.count() >= 3
    acts = EV.bulk_delete_actions(bulk.select(OB.topic_of("aggregate_type").alias("topic"), F.col("payload").alias("value")))
    assert {(r.tenant_id, r.entity_id) for r in acts.collect()} == {(r.tenant_id, r.id) for r in ids.collect()}
    assert bulk.first().type == "ListingsDeleted"


def test_last_of_repeated_keys_counts_in_any_session(spark):
    twice = ev()[:-1] + ', "title": "Ann", "visible": true}'
    inner = ev(title=None)[:-1] + ', "other": {"a": 1, "a": 2}, "title": "Bo"}'
    for allowed in ("false", "true"):
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
        try:
            assert classify(spark, [twice, inner, "{bad", '{"a":1,"a":']) == [
                ("UPSERT", None, "Ann", None), ("UPSERT", None, "Bo", None), ("SKIP", "bad_json", None, None), ("SKIP", "bad_json", None, None)]
        finally:
            spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_bulk_deletes_are_actions(spark):
    rows = [(TOPICS["CONTACT"], 0, i, "k", v) for i, v in enumerate([
        '{"tenantId":"t1","contactIds":["1","2"," "],"visible":false}', '{"tenantId":"t1","contactIds":[]}', '{"tenantId":" ","contactIds":["3"]}',
        '{"tenantId":"t1","contactIds":"4"}', ev(contactIds=["5"])])]
    out = EV.event_actions(spark.createDataFrame(rows, EVENT_RECORD)).collect()
    got = sorted((r.offset, r.entity_id, r.event_type, r.action, r.skip_reason) for r in out if r.entity_id is not None)
    assert got == [(0, " ", "BULK_DELETE", "SKIP", "missing_ids"), (0, "1", "BULK_DELETE", "DELETE", None), (0, "2", "BULK_DELETE", "DELETE", None),
                   (2, "3", "BULK_DELETE", "SKIP", "missing_ids"), (3, "", "", "SKIP", "missing_ids"), (4, "7", "CONTACTCREATED", "UPSERT", None)]
    assert [(r.action, r.skip_reason) for r in out if r.entity_id is None] == [("SKIP", "missing_ids")]


def test_changes_are_made_once_for_a_united_table(spark, sf):
    """The anti join reaches every table that the items unite; none of them makes the changes anew."""
    from larkseek.plans import catalog as C
    for name in ("index_upsert", "index_delete", "index_delete_count", "apply_actions"):
        assert "max_by" not in C.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString(), name


def test_bulk_deletes_parse_only_records_that_may_be_bulk(spark):
    """Escaped keys are found, and other records are dropped by a plain test of the text."""
    body = ['{"tenantId":"t","contactIds":["a","b"]}', '{"tenantId":"t","contact\\u0049ds":["c"]}', '{"type":"ContactDeleted","tenantId":"t","contactId":"d"}',
            None, '{"type":"ContactDeleted","tenantId":"t","contactId":"e","contactIds":["f"]}']
    records = spark.createDataFrame([("contact.events.v1", 0, i, "k", v) for i, v in enumerate(body)], "topic string, partition int, offset bigint, key string, value string")
    found = EV.bulk_delete_actions(records)
    assert sorted((r["offset"], r["entity_id"]) for r in found.collect()) == [(0, "a"), (0, "b"), (1, "c")]
    assert "Contains(value" in found._jdf.queryExecution().optimizedPlan().toString()
