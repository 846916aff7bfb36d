"""SQL twins of the table, event, relation, quality and metric queries."""

from oracle.base import oracle

IK = "tenant_id, entity_type, entity_id"

oracle("entity_scan", """
select 'CONTACT' entity, id, tenant_id, null::double amount, null::varchar currency, version, not deleted live from contacts
union all select 'LISTING', id, tenant_id, price::double, currency, version, not deleted from listings
union all select 'TRANSACTION', id, tenant_id, total::double, currency, version, not deleted from transactions""",
       "contacts", "listings", "transactions")
_T = "'2024-01-01T00:00:00Z'"
oracle("outbox_append", f"""
select id, null as new_for, tenant_id, case when id % 101 = 0 then 'CAMPAIGN' else aggregate_type end aggregate_type, "type", payload, id % 3 = 0 as published from (
  select id::bigint * 4 id, tenant_id, 'CONTACT' aggregate_type, 'ContactUpdated' "type", '{{"type":"ContactUpdated","tenantId":"' || tenant_id || '","contactId":"' || id
    || '","title":"' || full_name || '","subtitle":"' || label || '","visible":true,"version":' || version || ',"occurredAt":"' || {_T} || '"}}' payload from contacts
  union all select id::bigint * 4 + 1, tenant_id, 'LISTING', 'ListingCreated', '{{"type":"ListingCreated","tenantId":"' || tenant_id || '","listingId":"' || id
    || '","mls_id":"' || mls_id || '","contactId":"' || contact_id || '","title":"' || title || '","subtitle":"' || subtitle
    || '","visible":true,"version":' || version || ',"occurredAt":"' || {_T} || '"}}' from listings
  union all select id::bigint * 4 + 2, tenant_id, 'TRANSACTION', 'TransactionDeleted', '{{"type":"TransactionDeleted","tenantId":"' || tenant_id || '","transactionId":"' || id
    || '","visible":false,"version":' || version || ',"occurredAt":"' || {_T} || '"}}' from transactions)
union all select null, s_suppkey::varchar, 't' || (s_suppkey % 4), 'REFERRAL', 'ReferralCreated', '{{"type":"ReferralCreated","title":"' || s_name || '"}}', false from supplier""",
       "contacts", "listings", "transactions")
oracle("outbox_unpublished", """
select id, tenant_id, aggregate_type, aggregate_id, "type" from outbox where not published order by id limit 500""", "outbox")
oracle("outbox_mark_published", """
select id, aggregate_type, published or b.bid is not null as published, b.bid is not null marked_now
from outbox left join (select id bid from outbox where not published order by id limit 500) b on b.bid = id""", "outbox")
oracle("outbox_route", """
select id, case aggregate_type when 'CONTACT' then 'contact.events.v1' when 'LISTING' then 'listing.events.v1'
    when 'TRANSACTION' then 'transaction.events.v1' end topic,
  tenant_id || ':' || aggregate_id as key,
  case when aggregate_type = 'CAMPAIGN' then 'unsupported_type:CAMPAIGN' end reject_reason from outbox""", "outbox")
oracle("search_items_build", f"select {IK}, title, subtitle from items", "items")
oracle("event_actions", """
select 'contact.events.v1' topic, event_id as "offset", entity_type, tenant_id, entity_id, action, title, subtitle, version from acts
union all select 'listing.events.v1', id::bigint, 'LISTING', tenant_id, id, case when deleted then 'DELETE' else 'UPSERT' end,
  case when not deleted then title end,
  case when not deleted then subtitle || case when version = 0 then '' else mls_id end end, version from listings
union all select 'transaction.events.v1', id::bigint, 'TRANSACTION', tenant_id, id, case when deleted then 'DELETE' else 'UPSERT' end,
  case when not deleted then title end, case when not deleted then subtitle end, version from transactions""",
       "acts", "listings", "transactions")
oracle("event_skips", """
select 'contact.events.v1' topic, event_id as "offset", skip_reason from ev where skip_reason is not null""", "ev")
oracle("json_fields", """
select event_id as "offset", case when ok then title else '' end title, case when ok then entity_id else '' end contact_id,
  '' as missing, ok and visible visible, case when not ok or event_id % 37 = 0 then true else visible end visible_or_true,
  k::varchar k, k <> 0 as k_flag
from (select ev.*, event_id % 97 <> 0 and event_id % 101 <> 0 ok,
        regexp_extract(e.props, '"k": ?([0-9]+)', 1)::bigint k from ev join events e using (event_id))""", "ev")
oracle("latest_event", f"""
select {IK}, action, title, subtitle, event_id as "offset" from last""", "last")
oracle("latest_event_by_version", f"""
select {IK}, action, title, subtitle, event_id as "offset" from acts
qualify row_number() over (partition by tenant_id, entity_id order by version desc, event_id desc) = 1""", "acts")
_UP = f"""
select {IK}, title, subtitle from items i where not exists (select 1 from last l where l.action = 'UPSERT'
  and l.tenant_id = i.tenant_id and l.entity_type = i.entity_type and l.entity_id = i.entity_id)
union all select {IK}, title, subtitle from last where action = 'UPSERT'"""
oracle("index_upsert", _UP, "items", "last")
oracle("index_delete", f"""
select {IK}, title, subtitle from items i where not exists (select 1 from last l where l.action = 'DELETE'
  and l.tenant_id = i.tenant_id and l.entity_type = i.entity_type and l.entity_id = i.entity_id)""", "items", "last")
oracle("index_delete_count", """
select count(*) deleted from items i where exists (select 1 from last l where l.action = 'DELETE'
  and l.tenant_id = i.tenant_id and l.entity_type = i.entity_type and l.entity_id = i.entity_id)""", "items", "last")


def _proj(entity: str, key: str, frm: str, title: str, sub: str, mls: bool) -> str:
    low = f"{entity.capitalize()}"
    return f"""select '{entity}' aggregate_type, id aggregate_id, '{low}' || v "type", '{low}' || v json_type, id json_id,
      case when v <> 'Deleted' then {title} else '' end title, case when v <> 'Deleted' then {sub} else '' end subtitle,
      {"case when v = 'Updated' then mls_id else '' end" if mls else "''"} mls_camel,
      {"case when v = 'Created' then mls_id else '' end" if mls else "''"} mls_snake,
      v <> 'Deleted' visible, version::varchar as version, '2024-01-01T00:00:00Z' occurred_at
      from (select *, ['Created', 'Updated', 'Deleted'][version + 1] v from {frm})"""


oracle("event_projection", " union all ".join([
    _proj("CONTACT", "contactId", "contacts", "full_name", "label", False),
    _proj("LISTING", "listingId", "listings", "title", "subtitle", True),
    _proj("TRANSACTION", "transactionId", "transactions", "title", "subtitle", False)]),
       "contacts", "listings", "transactions")
oracle("bulk_delete_explode", """
select 'CONTACT' entity_type, tenant_id, id entity_id, 'DELETE' as action from contacts where deleted
union all select 'LISTING', tenant_id, id, 'DELETE' from listings where deleted
union all select 'TRANSACTION', tenant_id, id, 'DELETE' from transactions where deleted""", "contacts", "listings", "transactions")

oracle("tenant_scope", "select id, tenant_id, title, total::double total from transactions where tenant_id = 't1'", "transactions")
oracle("live_rows", "select id, tenant_id, status from transactions where not deleted", "transactions")
_W = """(select distinct 't' || (case when o_orderstatus = 'P' then (o_custkey + 1) % 4 else o_custkey % 4 end) tenant_id,
  o_custkey::varchar id from orders)"""
oracle("lookup_by_id", f"""
select c.tenant_id, c.id, full_name, version from contacts c join {_W} w on w.tenant_id = c.tenant_id and w.id = c.id
where not deleted""", "contacts")
oracle("lookup_incl_deleted", f"""
select c.tenant_id, c.id, full_name, deleted from contacts c join {_W} w on w.tenant_id = c.tenant_id and w.id = c.id""", "contacts")


def _search(frm: str, cols: list[str], order: str, out: str, calls: list[tuple[str, str, int]], prefix: bool) -> str:
    parts = []
    for i, (t, q, n) in enumerate(calls):
        pat = f"'{q}%'" if prefix else f"'%{q}%'"
        cond = " or ".join(f"lower(coalesce({c}, '')) like {pat}" for c in cols)
        parts.append(f"(select {i}::bigint as search, {out} from {frm} where tenant_id = '{t}' and not deleted and ({cond}) "
                     f"order by lower({order}), id limit {n})")
    return " union all ".join(parts)


oracle("contact_prefix_search", _search(
    "contacts", ["full_name", "email", "phone"], "full_name", "id, full_name, email",
    [("t1", "customer#00", 30), ("t2", "customer.0000001", 20), ("t3", "%5", 20), ("t3", "+48 1", 100)], True), "contacts")
oracle("contact_prefix_batch", """
select search, position, id, full_name, email from (
  select q.search, row_number() over (partition by q.search order by lower(c.full_name), c.id) as position, q.n, c.id, c.full_name, c.email
  from (
    select c_custkey as search, 't' || (c_custkey % 4) as tenant_id,
      case when c_custkey % 3 = 0 then replace(typed, '#', '.') else typed end as term, case when c_custkey % 7 = 0 then 20 else c_custkey % 7 end as n
    from (select c_custkey, substr(lower(c_name), 1, cast(length(c_name) - case when c_custkey % 2 = 0 then 0 when c_custkey % 4 = 1 then 1 else 4 end as bigint)) as typed from customer)
    union all values (-1, 't3', '%5', 20), (-2, 't3', '+48 1', 100), (-3, 't1', 'customer#00', 30), (-5, 't0', 'cust_mer.%4', 50)) q
  join contacts c on c.tenant_id = q.tenant_id and not c.deleted
    and (lower(c.full_name) like q.term || '%' or lower(c.email) like q.term || '%' or lower(coalesce(c.phone, '')) like q.term || '%'))
where position <= n""", "contacts")
oracle("listing_search", _search(
    "listings", ["title", "subtitle", "mls_id"], "title", "id, title, mls_id",
    [("t1", "ring", 100), ("t2", "brand#2", 20), ("t0", "s_all", 7), ("t3", "-1", 20)], False), "listings")
oracle("transaction_search", _search(
    "transactions", ["title", "subtitle"], "title", "id, title, subtitle",
    [("t1", "order 12", 100), ("t2", "urgent", 20), ("t0", "99", 20)], False), "transactions")
oracle("entity_page", """
(select 'CONTACT' entity, id, full_name title, version from contacts where tenant_id = 't1' and not deleted order by id limit 25 offset 20)
union all (select 'LISTING', id, title, version from listings where tenant_id = 't2' and not deleted order by id limit 50)
union all (select 'TRANSACTION', id, title, version from transactions where tenant_id = 't3' and not deleted order by id limit 200 offset 100)""",
       "contacts", "listings", "transactions")
oracle("entity_page_after", """
select id, title from transactions where tenant_id = 't1' and not deleted and id > '120' order by id limit 40""", "transactions")

oracle("contact_exists", """
select id, tenant_id, contact_id from listings l where exists (select 1 from contacts c where not c.deleted
  and c.tenant_id = l.tenant_id and c.id = l.contact_id)""", "listings", "contacts")
oracle("listing_exists", """
select id, tenant_id, listing_id from transactions t where listing_id is not null and not exists (select 1 from listings l
  where not l.deleted and l.tenant_id = t.tenant_id and l.id = t.listing_id)""", "transactions", "listings")
oracle("listing_contact_link", """
select t.id, t.contact_id, t.listing_id, l.contact_id linked_contact from transactions t
left join listings l on l.tenant_id = t.tenant_id and l.id = t.listing_id and not l.deleted
where t.contact_id is not null and t.listing_id is not null and (l.contact_id is null or l.contact_id <> t.contact_id)""",
       "transactions", "listings")
oracle("fk_orphans", """
select id, contact_id from transactions_raw t where contact_id is not null
  and not exists (select 1 from contacts c where c.id = t.contact_id)""", "transactions_raw", "contacts")
oracle("fk_cross_tenant", """
select t.id, t.tenant_id, t.listing_id, l.tenant_id parent_tenant from transactions t join listings l on l.id = t.listing_id
where l.tenant_id <> t.tenant_id""", "transactions", "listings")

oracle("null_checks", """
select 'contacts' t, count(*) n_rows, count(*) filter (email is null) a, 0::bigint b from contacts_raw
union all select 'listings', count(*), count(*) filter (mls_id is null), count(*) filter (currency is null) from listings_raw
union all select 'transactions', count(*), count(*) filter (total is null), count(*) filter (status is null) from transactions_raw""",
       "contacts_raw", "listings_raw", "transactions_raw")
oracle("duplicate_keys", """
select tenant_id, lower(trim(email)) as key, count(*) n, 'contacts' t from contacts_raw where email is not null group by 1, 2 having count(*) > 1
union all select tenant_id, 'm' || (case when id::bigint % 10 = 8 then id::bigint - 4 else id::bigint end), count(*), 'listings'
from listings group by 1, 2 having count(*) > 1
union all select tenant_id, entity_type || '/' || entity_id, count(*) + count(*) filter (entity_type = 'REFERRAL'), 'items'
from items group by tenant_id, entity_type, entity_id having count(*) + count(*) filter (entity_type = 'REFERRAL') > 1""", "contacts_raw", "listings", "items")
oracle("gated_write", """
select t, n_rows, a, b, case when a + b = 0 then n_rows else 0 end written_rows from (
  select 'contacts' t, count(*) n_rows, count(*) filter (email is null) a, count(*) filter (email <> trim(email)) b from contacts_raw
  union all select 'contacts_clean', count(email), 0, 0 from contacts_raw
  union all select 'listings', count(*), count(*) filter (mls_id is null), count(*) filter (currency is null or not regexp_full_match(currency, '[A-Z]{3}')) from listings_raw
  union all select 'listings_filled', count(*), 0, count(*) filter (not regexp_full_match(upper(coalesce(nullif(trim(currency), ''), 'USD')), '[A-Z]{3}')) from listings_raw) checks""", "contacts_raw", "listings_raw")
oracle("clean_email", "select id, trim(email) email, trim(email) hard_trim from contacts_raw", "contacts_raw")
oracle("backfill_mls", "select id, coalesce(mls_id, id) mls_id from listings_raw", "listings_raw")
oracle("currency_normalize", """
select id, upper(coalesce(nullif(trim(currency), ''), 'USD')) currency, coalesce(nullif(trim(currency), ''), 'USD') backfilled
from listings_raw""", "listings_raw")
oracle("currency_violations", """
select id, currency from (select id, upper(coalesce(nullif(trim(currency), ''), 'USD')) currency from listings_raw)
where not regexp_matches(currency, '^[A-Z]{3}$')""", "listings_raw")
oracle("total_backfill", """
select id, coalesce(total, amount, 0)::decimal(19,2)::double total, coalesce(status, 'NEW') status from transactions_raw""",
       "transactions_raw")
oracle("money_normalize", """
select id, case when ok then round(price, 2)::double end amount, case when ok then ccy end currency,
  case when not ok then 'invalid_currency' end money_reject
from (select *, case when currency is null or trim(currency) = '' then 'USD' else currency end ccy,
        regexp_matches(case when currency is null or trim(currency) = '' then 'USD' else currency end, '^[A-Z]{3}$') ok from listings_raw)""",
       "listings_raw")
oracle("money_equal", """
select l.id, true as same, round(r.price, 2) = l.price as same_rounded, round(r.price, 2)::decimal(19,2)::varchar || ' USD' txt, true same_hash
from listings l join listings_raw r on r.id = l.id""", "listings", "listings_raw")
oracle("null_text", """
select id, case when trim(currency) <> '' then currency end blank_null, currency empty_null, coalesce(currency, '') or_empty,
  coalesce(trim(currency) = '', true) blank from listings_raw""", "listings_raw")
oracle("request_counts", "select tenant_id, result, count(*) requests from log group by 1, 2", "log")
oracle("latency_slo", """
select tenant_id, result, count(*) n, count(*) filter (latency_ms <= 100) le_100, count(*) filter (latency_ms <= 200) le_200,
  count(*) filter (latency_ms <= 400) le_400, max(latency_ms) max_ms from log group by 1, 2""", "log")
oracle("latency_percentiles", """
select tenant_id, result, max(n) n, min(latency_ms) filter (rn >= ceil(round(0.95 * n, 9))) p95_ms,
  min(latency_ms) filter (rn >= ceil(round(0.99 * n, 9))) p99_ms
from (select *, row_number() over (partition by tenant_id, result order by latency_ms) rn,
        count(*) over (partition by tenant_id, result) n from log) group by 1, 2""", "log")
oracle("latency_sketch_rank_error", """
select tenant_id, result, count(*) n, p, true as within from log, (values (0.95::double), (0.99::double)) v(p) group by 1, 2, 4""", "log")
oracle("entity_page_at", """
select t.tenant_id, id, title, position from (
  select *, row_number() over (partition by tenant_id order by id) - 1 as position from transactions where not deleted) t
join (values ('t0', 0), ('t1', 250), ('t2', 3000), ('t3', 3300), ('t0', 10000), ('t1', 1000000000)) v(tenant_id, o)
  on t.tenant_id = v.tenant_id and position >= o and position < o + 60""", "transactions")
oracle("query_log_masked", """
select event_id, case when user_id % 2 = 0 then '' else 'find ' end || '<email> or <phone>'
    || case when user_id % 7 = 0 then ' ' || repeat('x', 100) else '' end as q,
  case when user_id % 2 = 0 then 'control_chars' when user_id % 7 = 0 then 'too_long' end reject_reason from log""", "log")

# what all three topics say last: contact events, then one row per listing and transaction
_ALL_LAST = """
  select tenant_id, entity_type, entity_id, action, title, subtitle, event_id as "offset" from last
  union all select tenant_id, 'LISTING', id, case when deleted then 'DELETE' else 'UPSERT' end, title,
    subtitle || case when version = 0 then '' else mls_id end, id::bigint from listings
  union all select tenant_id, 'TRANSACTION', id, case when deleted then 'DELETE' else 'UPSERT' end, title, subtitle, id::bigint from transactions"""
oracle("index_stream", f"select {IK}, title, subtitle from ({_ALL_LAST}) where action = 'UPSERT'", "last", "listings", "transactions")
# the odd records come after the even ones
oracle("stream_restart", f"""
select {IK}, title, subtitle from (
  select tenant_id, entity_type, entity_id, action, title, subtitle from (
    select * from acts qualify row_number() over (partition by tenant_id, entity_id order by event_id % 2 desc, event_id desc) = 1)
  union all select {IK}, action, title, subtitle from ({_ALL_LAST}) where entity_type <> 'CONTACT')
where action = 'UPSERT'""", "acts", "last", "listings", "transactions")
oracle("stream_dead_letters", """select 'contact.events.v1' topic, event_id as "offset", skip_reason from ev where skip_reason is not null""", "ev")
oracle("bulk_delete_indexed", f"""
select {IK}, title, subtitle from (
  select {IK}, title, subtitle from items i where not exists (select 1 from ({_ALL_LAST}) l
    where l.tenant_id = i.tenant_id and l.entity_type = i.entity_type and l.entity_id = i.entity_id)
  union all select {IK}, title, subtitle from ({_ALL_LAST}) where action = 'UPSERT') a
where not exists (select 1 from (
    select tenant_id, 'CONTACT' entity_type, id entity_id from contacts where id::bigint % 11 = 0
    union all select tenant_id, 'LISTING', id from listings where id::bigint % 11 = 0
    union all select tenant_id, 'TRANSACTION', id from transactions where id::bigint % 11 = 0) g
  where g.tenant_id = a.tenant_id and g.entity_type = a.entity_type and g.entity_id = a.entity_id)""", "items", "last", "contacts", "listings", "transactions")
_FOLDED = f"""
select {IK}, title, subtitle from items i where not exists (select 1 from last l
  where l.tenant_id = i.tenant_id and l.entity_type = i.entity_type and l.entity_id = i.entity_id)
union all select {IK}, title, subtitle from last where action = 'UPSERT'"""
for _name in ("stream_replay", "replay_idempotent", "apply_actions"):
    oracle(_name, _FOLDED, "items", "last")
oracle("replay_by_version", _FOLDED.replace("from last", "from newest").replace("join last", "join newest"), "items", "newest")
oracle("outbox_stream", """
select id, case aggregate_type when 'CONTACT' then 'contact.events.v1' when 'LISTING' then 'listing.events.v1'
    when 'TRANSACTION' then 'transaction.events.v1' else 'rejected' end topic, tenant_id || ':' || aggregate_id as key
from outbox where not published""", "outbox")
oracle("outbox_polled", """
select id + late::bigint * 1000000000000 id, topic, "key", case when late then first_polls else 0 end + (row_number() over (partition by late order by id) - 1) // 500 as batch
from (select id, "type" = 'TransactionDeleted' late, case aggregate_type when 'CONTACT' then 'contact.events.v1' when 'LISTING' then 'listing.events.v1'
    when 'TRANSACTION' then 'transaction.events.v1' else 'rejected' end topic, tenant_id || ':' || aggregate_id as "key" from outbox where not published) o,
  (select (count(*) + 499) // 500 first_polls from outbox where not published and "type" <> 'TransactionDeleted')""", "outbox")
