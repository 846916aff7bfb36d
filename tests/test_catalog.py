"""Registered queries against their SQL twins on the smallest data."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

# the full set runs through tools/check.py; these cover each area quickly
FAST = ["entity_scan", "outbox_route", "event_actions", "latest_event_by_version", "index_upsert", "event_projection", "lookup_by_id",
        "contact_prefix_search", "listing_search", "entity_page", "listing_contact_link", "fk_cross_tenant", "null_checks",
        "duplicate_keys", "money_normalize", "money_equal", "latency_percentiles", "query_tokens", "tsv_build", "ts_rank", "short_query",
        "typeahead_batch", "apply_mixed", "stale_writes", "change_events", "index_stream"]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", FAST)
def test_query(spark, con, sf, name):
    ok, info = compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, info


def test_every_twin_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    corpus = {k for k in q if k.startswith("op") and k[2:3].isdigit()} | {"pipeline"}
    assert set(q) - set(o) - corpus == {"typeahead_english", "english_vocabulary"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1
