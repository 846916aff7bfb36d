"""Explicit schemas (as DDL text, which every reader accepts) of the entity tables, the outbox, the
search items and the event records, and the fixed names around them."""

from __future__ import annotations

# Entity types of the search table, their hit id prefixes and typed id fields, in
# the order the grouped answer lists them.
ENTITY_TYPES = ("CONTACT", "LISTING", "REFERRAL", "TRANSACTION", "PRODUCT", "MAILING")
HIT_PREFIX = {"CONTACT": "c_", "LISTING": "l_", "REFERRAL": "r_",
              "TRANSACTION": "t_", "PRODUCT": "p_", "MAILING": "m_"}
TOPICS = {
    "CONTACT": "contact.events.v1",
    "LISTING": "listing.events.v1",
    "REFERRAL": "referral.events.v1",
    "TRANSACTION": "transaction.events.v1",
    "PRODUCT": "product.events.v1",
    "MAILING": "mailing.events.v1",
}

ITEM_KEY = ["tenant_id", "entity_type", "entity_id"]


_AUDIT = "version bigint, created_at timestamp, updated_at timestamp, deleted_at timestamp"
CONTACTS = (f"id string, tenant_id string, full_name string, email string, phone string, label string, {_AUDIT}")
LISTINGS = ("id string, tenant_id string, title string, subtitle string, mls_id string, "
                   f"price decimal(19,2), currency string, contact_id string, {_AUDIT}")
TRANSACTIONS = ("id string, tenant_id string, title string, subtitle string, total decimal(19,2), "
                       f"currency string, status string, visible boolean, contact_id string, listing_id string, {_AUDIT}")
OUTBOX = ("id bigint, tenant_id string, aggregate_type string, aggregate_id string, type string, "
                 "payload string, occurred_at timestamp, published boolean, published_at timestamp")
SEARCH_ITEMS = ("tenant_id string, entity_type string, entity_id string, title string, subtitle string")
EVENT_RECORD = ("topic string, partition int, offset bigint, key string, value string")
