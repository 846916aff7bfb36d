"""Change sets: a random history against a plain sequential reading, and the single cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkseek.operators import changes as CH
from larkseek.schemas import CONTACTS, LISTINGS

T0 = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


CHANGES = "seq bigint, op string, tenant_id string, id string, expected_version bigint, full_name string, email string, phone string, label string"


def contact(i, version=0, deleted=False):
    return (str(i), "t", f"n{i}", f"e{i}", None, "l", version, T0, T0, T0 if deleted else None)


def sequential(current, changes):
    state = {r[0]: {"name": r[2], "v": r[6], "dead": r[9] is not None} for r in current}
    verdict = {}
    for seq, op, _, i, ver, name, *_ in sorted(changes):
        s = state.get(i)
        why = None
        if op == "insert":
            if s:
                why = "duplicate_key"
            else:
                state[i] = {"name": name, "v": 0, "dead": False}
        elif s is None:
            why = "not_found"
        elif op == "bulk_delete":
            if s["dead"]:
                why = "not_live"
            else:
                s.update(v=s["v"] + 1, dead=True)
        elif s["v"] != ver or (op == "delete" and s["dead"]):
            why = "stale_version"
        else:
            s["v"] += 1
            if op == "update":
                s["name"] = name
            else:
                s["dead"] = op == "delete"
        verdict[seq] = why
    return state, verdict


@pytest.mark.parametrize("seed", [1, 2])
def test_random_history(spark, seed):
    rnd = random.Random(seed)
    current = [contact(i, rnd.randint(0, 2), rnd.random() < .3) for i in range(40)]
    changes = []
    for seq in range(400):
        # one hot contact takes a third of all changes
        i = "0" if rnd.random() < .33 else str(rnd.randint(0, 80))
        op = rnd.choice(["insert", "update", "update", "delete", "undelete", "bulk_delete"])
        ver = rnd.randint(0, 12) if op not in ("insert", "bulk_delete") else None
        changes.append((seq, op, "t", i, ver, f"c{seq}", "e", None, "l"))
    r = CH.apply_changes(spark.createDataFrame(current, CONTACTS), spark.createDataFrame(changes, CHANGES).repartition(5), "CONTACT", now())
    state, verdict = sequential(current, changes)
    assert {o.seq: o.reject_reason for o in r.outcomes.collect()} == verdict
    got = {s.id: {"name": s.full_name, "v": s.version, "dead": s.deleted_at is not None} for s in r.snapshot.collect()}
    assert got == state


def test_lifecycle(spark):
    """Create, update, stale update, delete, and the events they emit."""
    ch = spark.createDataFrame([
        (1, "insert", "t", "a", None, "Sam Chen", "sam@example.com", "+48 600 000 000", "Buyer lead"),
        (2, "update", "t", "a", 0, "Sammy Chen", "sammy@example.com", None, "VIP buyer"),
        (3, "update", "t", "a", 0, "late", None, None, None), (4, "delete", "t", "a", 1, None, None, None, None),
        (5, "delete", "t", "a", 2, None, None, None, None)], CHANGES)
    r = CH.apply_changes(spark.createDataFrame([], CONTACTS), ch, "CONTACT", now())
    row = r.snapshot.first()
    assert (row.full_name, row.phone, row.version, row.deleted_at is not None) == ("Sammy Chen", None, 2, True)
    assert {x.seq: x.reject_reason for x in r.rejected.collect()} == {3: "stale_version", 5: "stale_version"}
    types = [e.type for e in CH.change_events(r.accepted, "CONTACT", now()).collect()]
    assert sorted(types) == ["ContactCreated", "ContactDeleted", "ContactUpdated"]


def test_single_and_several_agree_on_listings(spark):
    cur = spark.createDataFrame([(str(i), "t", "A", "s", "m", 10, "USD", "c", 0, T0, T0, None) for i in range(4)],
                                LISTINGS.replace("decimal(19,2)", "int"))
    cur = cur.withColumn("price", F.col("price").cast("decimal(19,2)"))
    cols = "seq bigint, op string, tenant_id string, id string, expected_version bigint, title string, subtitle string, mls_id string, price string, currency string, contact_id string"
    one = [(1, "update", "t", "0", 0, "B", None, None, "2.005", " eur ", None), (2, "insert", "t", "new", None, "N", None, "m9", None, None, "c")]
    twice = [(3, "update", "t", "1", 0, "B", None, None, "2.005", " eur ", None), (4, "delete", "t", "1", 9, *[None] * 6),
             (5, "insert", "t", "new2", None, "N", None, "m9", None, None, "c"), (6, "undelete", "t", "new2", 0, *[None] * 6)]
    r = CH.apply_changes(cur, spark.createDataFrame(one + twice, cols), "LISTING", now())
    got = {x.id: (x.title, x.subtitle, x.mls_id, str(x.price), x.currency, x.contact_id, x.version) for x in r.snapshot.collect()}
    assert got["0"] == got["1"] == ("B", "s", "m", "2.01", "EUR", "c", 1)
    assert got["new"] == got["new2"] == ("N", None, "m9", "0.00", "USD", "c", 0)
    assert {x.seq: x.reject_reason for x in r.rejected.collect()} == {4: "stale_version", 6: "unsupported_op"}


def test_materialized_outcomes(spark, tmp_path):
    cur = spark.createDataFrame([contact(1)], CONTACTS)
    ch = CH.assign_ids(spark.createDataFrame([(1, "insert", "t", None, None, "x", "e", None, None)], CHANGES))
    r = CH.apply_changes(cur, ch, "CONTACT", now(), materialize_to=str(tmp_path / "batch=1"))
    ids = {x.id for x in r.snapshot.collect()}
    assert ids == {"1"} | {x.id for x in r.accepted.collect()} and len(ids) == 2


def test_relation_checks(spark):
    con = spark.createDataFrame([contact(1), contact(2, deleted=True)], CONTACTS)
    li = spark.createDataFrame([("9", "t", "A", None, "m", None, "USD", "1", 0, T0, T0, None)], LISTINGS)
    cols = "seq bigint, op string, tenant_id string, id string, expected_version bigint, title string, contact_id string, listing_id string"
    ch = spark.createDataFrame([(1, "update", "t", "x", 0, "a", "1", "9"), (2, "update", "t", "x", 0, "a", "2", None),
                                (3, "update", "t", "x", 0, "a", None, "8"), (4, "insert", "t", "x", 0, "a", "2", "8"),
                                (5, "update", "u", "x", 0, "a", "1", None)], cols)
    got = {r.seq: r.bad_relation for r in CH.validate_relations(ch, "TRANSACTION", con, li).collect()}
    assert got == {1: None, 2: "contact_missing", 3: "listing_missing", 4: None, 5: "contact_missing"}


def test_rejected_changes_show_the_row_as_it_stands(spark):
    cur = spark.createDataFrame([("1", "t", "A", "e", None, "l", 5, T0, T0, None)], CONTACTS)
    ch = spark.createDataFrame([(1, "update", "t", "1", 5, "B", None, None, None), (2, "update", "t", "1", 4, "C", None, None, None),
                                (3, "update", "t", "1", 5, "D", None, None, None)], CHANGES)
    got = {r.seq: (r.reject_reason, r.full_name, r.version) for r in CH.apply_changes(cur, ch, "CONTACT", now()).outcomes.collect()}
    assert got == {1: (None, "B", 6), 2: ("stale_version", "B", 6), 3: ("stale_version", "B", 6)}


def test_changes_without_an_id_have_an_outcome(spark):
    """Several per tenant, a null tenant, and one key beside them."""
    cur = spark.createDataFrame([contact(1)], CONTACTS)
    ch = spark.createDataFrame([(1, "insert", "t", None, None, "a", None, None, None), (2, "insert", "t", None, None, "b", None, None, None), (3, "delete", None, "1", 0, *[None] * 4),
                                (4, "insert", None, None, None, "c", None, None, None), (5, "update", "t", "1", 0, "d", None, None, None)], CHANGES)
    r = CH.apply_changes(cur, ch, "CONTACT", now())
    assert {o.seq: (o.reject_reason, o.version) for o in r.outcomes.collect()} == {k: ("missing_id", None) for k in (1, 2, 3, 4)} | {5: (None, 1)}
    assert [(x.id, x.full_name) for x in r.snapshot.collect()] == [("1", "d")]
    named = CH.apply_changes(cur, CH.assign_ids(ch), "CONTACT", now())
    assert named.snapshot.count() == 3 and {x.seq for x in named.rejected.collect()} == {3, 4}


def test_keys_stay_whole_when_a_join_turns_into_a_broadcast_one(spark):
    """Planned as a shuffled join, run as a broadcast one: all changes of a key still meet in one task."""
    n, conf = 400, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "300KB",
               "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    # changes too wide for a broadcast, so that their shuffle is the one read in pieces
    current = spark.createDataFrame([contact(i) for i in range(n)], CONTACTS).repartition(4)
    rows = [(k * n + i, "update", "t", str(i), k, f"name {k}", "x" * 2000, None, None) for k in range(4) for i in range(n)]
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rules = CH.RULES["CONTACT"]
        met = CH._with_current(CH._prepared(spark.createDataFrame(rows, CHANGES).repartition(4), rules, now()), current, rules).withColumn("_n", F.lit(4))
        got = CH._several(met, rules, CH._single(met.drop("_n"), rules)).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(got) == 4 * n and [r.id for r in got if r.reject_reason is not None or r.version != r.expected_version + 1] == []
