"""Domain events: building them from entity rows, and turning records into index actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkseek.functions import json_fields as J
from larkseek.functions.text import SPACE_CLASS, staged
from larkseek.schemas import TOPICS


@dataclass(frozen=True)
class EventKind:
    """How one topic names its types and its id field."""
    entity: str
    id_key: str
    bulk_key: str
    appends_mls: bool = False


# The topics the indexer handles.
KINDS = (
    EventKind("CONTACT", "contactId", "contactIds"),
    EventKind("LISTING", "listingId", "listingIds", appends_mls=True),
    EventKind("TRANSACTION", "transactionId", "transactionIds"),
)


def _by_topic(pick) -> str:
    """SQL for one value out of a per-topic choice."""
    return "(case topic " + " ".join(f"when '{TOPICS[k.entity]}' then {pick(k)}" for k in KINDS) + " end)"


_HANDLED = ", ".join(f"'{TOPICS[k.entity]}'" for k in KINDS)
_TEXT = f"rlike r'[^{SPACE_CLASS}]'"


# Top-level fields of an event that are read.
_FIELDS = ("type", "tenantId", "title", "subtitle", "mlsId", "mls_id", "visible", "version",
           *(k.id_key for k in KINDS), *(k.bulk_key for k in KINDS))
BULK_DELETE = "BULK_DELETE"


def event_actions(records: DataFrame, visible_default: bool = False, accept_mls_snake: bool = False) -> DataFrame:
    """Classify event records of the handled topics.

    Adds ``entity_type, tenant_id, entity_id, action (UPSERT | DELETE | SKIP), skip_reason, title,
    subtitle, version`` to the record coordinates. Checks run in the order tombstone, JSON, ids,
    type, visibility, title; an invisible create or update is a delete even with a blank title.

    A bulk-delete record (an array of ids, no type) yields one DELETE per id, with event type
    ``BULK_DELETE``; blank ids and empty arrays are skips. Of a repeated key the last one counts.
    """
    place = [c for c in ("topic", "partition", "offset") if c in records.columns]
    mls = J.value_text("v.mlsId")
    if accept_mls_snake:
        mls = f"coalesce(nullif({mls}, ''), {J.value_text('v.mls_id')})"
    parsed = staged(records.where(f"topic in ({_HANDLED})"), *place, is_null="value is null", is_bad=J.invalid_sql("value"),
                    v=J.fields_sql("value", _FIELDS))
    fields = staged(
        parsed, *place, "is_null", "is_bad",
        event_type=f"upper({J.value_text('v.type')})", entity_type=_by_topic(lambda k: f"'{k.entity}'"),
        tenant_id=J.value_text("v.tenantId"), one_id=_by_topic(lambda k: J.value_text(f"v.{k.id_key}")),
        many_ids=_by_topic(lambda k: f"try_variant_get(v.{k.bulk_key}, '$', 'array<string>')"),
        title=J.value_text("v.title"), sub=J.value_text("v.subtitle"),
        mls=_by_topic(lambda k: mls if k.appends_mls else "''"), shown=J.value_bool("v.visible", visible_default),
        version="try_variant_get(v.version, '$', 'bigint')")
    bulk = "(event_type = '' and many_ids is not null)"
    each = fields.selectExpr(*place, "is_null", "is_bad", f"if({bulk}, '{BULK_DELETE}', event_type) as event_type", "entity_type", "tenant_id",
                             "title", "sub", "mls", "shown", "version", f"explode_outer(if({bulk}, many_ids, array(one_id))) as entity_id")
    writes = "event_type in (concat(entity_type, 'CREATED'), concat(entity_type, 'UPDATED'))"
    judged = staged(
        each, *place, "entity_type", "tenant_id", "entity_id", "event_type", "title", "sub", "mls", "version",
        writes=f"{writes} and shown",
        skip_reason=f"""case when is_null then 'tombstone' when is_bad then 'bad_json'
            when not coalesce(tenant_id {_TEXT} and entity_id {_TEXT}, false) then 'missing_ids'
            when not ({writes} or event_type in (concat(entity_type, 'DELETED'), '{BULK_DELETE}')) then 'unknown_type'
            when {writes} and shown and not title {_TEXT} then 'missing_title' end""")
    upsert = "skip_reason is null and writes"
    return judged.selectExpr(
        *place, "entity_type", "tenant_id", "entity_id", "event_type",
        "case when skip_reason is not null then 'SKIP' when writes then 'UPSERT' else 'DELETE' end as action",
        "skip_reason", f"if({upsert}, title, null) as title",
        f"if({upsert}, nullif(concat(if(sub {_TEXT}, sub, ''), if(mls {_TEXT}, mls, '')), ''), null) as subtitle", "version")


def effective(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action") != "SKIP")


def dead_letters(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action") == "SKIP")


def bulk_delete_actions(records: DataFrame) -> DataFrame:
    """The DELETE actions of bulk-delete records alone. Only records that may name one of the bulk keys
    are parsed: those whose text holds one, or an escape that could spell it."""
    place = [c for c in ("topic", "partition", "offset") if c in records.columns]
    keys = " or ".join(f"contains(value, '{k.bulk_key}')" for k in KINDS)
    return (event_actions(records.where(f"{keys} or contains(value, r'\\')")).where(f"event_type = '{BULK_DELETE}' and action = 'DELETE'")
            .select(*place, "entity_type", "tenant_id", "entity_id", "action"))


# ---- producing side -------------------------------------------------------------------------

def contact_payload(verb: Column | str, occurred_at: Column) -> Column:
    """JSON of a contact event; ``verb`` is Created, Updated or Deleted."""
    return _payload("Contact", "contactId", verb, occurred_at,
                    title=F.col("full_name"), subtitle=F.coalesce("label", F.lit("")), extra=[])


def listing_payload(verb: Column | str, occurred_at: Column) -> Column:
    """JSON of a listing event. A created event names the MLS id ``mls_id``, an updated one ``mlsId``."""
    v = F.lit(verb) if isinstance(verb, str) else verb
    return _payload("Listing", "listingId", v, occurred_at, title=F.col("title"),
                    subtitle=F.coalesce("subtitle", F.lit("")),
                    extra=[F.when(v == "Created", F.col("mls_id")).alias("mls_id"),
                           F.when(v == "Updated", F.col("mls_id")).alias("mlsId"),
                           F.when(v != "Deleted", F.col("contact_id")).alias("contactId")])


def transaction_payload(verb: Column | str, occurred_at: Column) -> Column:
    """JSON of a transaction event; an updated one also carries its relations."""
    v = F.lit(verb) if isinstance(verb, str) else verb
    return _payload("Transaction", "transactionId", v, occurred_at, title=F.col("title"),
                    subtitle=F.coalesce("subtitle", F.lit("")),
                    extra=[F.when(v == "Updated", F.col("contact_id")).alias("contactId"),
                           F.when(v == "Updated", F.col("listing_id")).alias("listingId")])


def _payload(prefix: str, id_key: str, verb: Column | str, occurred_at: Column, title: Column,
             subtitle: Column, extra: list[Column]) -> Column:
    v = F.lit(verb) if isinstance(verb, str) else verb
    alive = v != "Deleted"
    return F.to_json(F.struct(
        F.concat(F.lit(prefix), v).alias("type"), F.col("tenant_id").alias("tenantId"), F.col("id").alias(id_key),
        *extra, F.when(alive, title).alias("title"), F.when(alive, subtitle).alias("subtitle"),
        alive.alias("visible"), F.col("version").alias("version"),
        F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurredAt")))


PAYLOADS = {"CONTACT": contact_payload, "LISTING": listing_payload, "TRANSACTION": transaction_payload}


def outbox_rows(df: DataFrame, entity: str, verb: Column | str, occurred_at: Column) -> DataFrame:
    """Outbox columns (without id) for one event per row of ``df``."""
    v = F.lit(verb) if isinstance(verb, str) else verb
    return df.select(
        "tenant_id", F.lit(entity).alias("aggregate_type"), F.col("id").alias("aggregate_id"),
        F.concat(F.lit(entity.capitalize()), v).alias("type"), PAYLOADS[entity](v, occurred_at).alias("payload"),
        occurred_at.alias("occurred_at"), F.lit(False).alias("published"),
        F.lit(None).cast("timestamp").alias("published_at"))


def bulk_delete_payload(entity: str, ids: DataFrame, occurred_at: Column, rows_per_event: int = 1000) -> DataFrame:
    """Bulk-delete events of (tenant_id, id) rows: one event per tenant and bucket of ids.

    Buckets keep any single event small however many ids one tenant deletes.
    """
    kind = next(k for k in KINDS if k.entity == entity)
    total = ids.agg(F.count("*")).scalar()
    bucket = F.pmod(F.xxhash64("id"), F.greatest(F.ceil(total / rows_per_event), F.lit(1)))
    return (ids.groupBy("tenant_id", bucket.alias("bucket")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select("tenant_id", F.lit(entity).alias("aggregate_type"), F.lit(None).cast("string").alias("aggregate_id"),
                    F.lit(f"{entity.capitalize()}sDeleted").alias("type"),
                    F.to_json(F.struct(F.col("tenant_id").alias("tenantId"), F.col("ids").alias(kind.bulk_key),
                                       F.lit(False).alias("visible"),
                                       F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurredAt")))
                    .alias("payload")))
