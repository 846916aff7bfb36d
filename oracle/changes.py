"""SQL twins of the change-set queries, in closed form per contact."""

from oracle.base import oracle

# Which change of the mixed set is accepted, and the state after it.
_STATE = """
st as (select *, id::bigint n, id::bigint % 2 = 0 u1 from contacts),
s3 as (select *, version + u1::bigint v1, n % 3 = 0 and not deleted del3 from st),
s4 as (select *, v1 + del3::bigint v3, deleted or del3 d3, n % 17 = 0 and n % 5 = 0 und4 from s3),
s5 as (select *, v3 + und4::bigint v4, d3 and not und4 d4, n % 13 = 0 and not (d3 and not und4) bulk5 from s4)"""
_NEW = """select 't' || (s_suppkey % 4) tenant_id, 's' || s_suppkey id, s_name full_name, 'new@example.com' email,
  null::varchar phone, n_name label, 0::bigint as version, false deleted from supplier left join nation on n_nationkey = s_nationkey"""


def _with(body: str) -> str:
    from oracle.base import sql
    return sql("", "contacts").rstrip() + "," + _STATE + "\n" + body


def _put(name: str, body: str) -> None:
    from oracle.base import ORACLES
    ORACLES[name] = _with(body)


_COLS = "tenant_id, id, full_name, email, phone, label, version, deleted"
_put("apply_insert", f"select {_COLS} from contacts union all {_NEW}")
_put("apply_update", """
select tenant_id, id, case when u1 then full_name || ' II' else full_name end full_name, email,
  case when not u1 then phone end phone, case when u1 then 'VIP' else label end label, v1 as version, deleted from s5""")
_put("apply_soft_delete", """
select tenant_id, id, full_name, email, phone, label, version + (not u1 and del3)::bigint as version, deleted or (not u1 and del3) deleted from s5""")
_put("apply_undelete", """
select tenant_id, id, full_name, email, phone, label, version + (not u1 and und4)::bigint as version, deleted and not (not u1 and und4) deleted from s5""")
_put("apply_bulk_delete", """
select tenant_id, id, (not deleted)::bigint affected from s5 where n % 13 = 0""")
_put("apply_mixed", f"""
select tenant_id, id, case when u1 then full_name || ' II' else full_name end full_name, email,
  case when not u1 then phone end phone, case when u1 then 'VIP' else label end label,
  v4 + bulk5::bigint as version, d4 or bulk5 deleted from s5 union all {_NEW}""")
_put("stale_writes", """
select tenant_id, id, n * 10 + 2 seq, 'update' op, version expected_version, 'stale_version' reject_reason from s5 where n % 4 = 0
union all select tenant_id, id, n * 10 + 3, 'delete', v1, 'stale_version' from s5 where n % 3 = 0 and not del3
union all select tenant_id, id, n * 10 + 5, 'bulk_delete', null, 'not_live' from s5 where n % 13 = 0 and not bulk5
union all select 't' || (s_suppkey % 4), 's' || s_suppkey, s_suppkey * 10 + 1, 'insert', null, 'duplicate_key' from supplier where s_suppkey % 10 = 0""")
_put("change_events", """
select tenant_id, id aggregate_id, 'ContactUpdated' "type", full_name || ' II' title, 'VIP' subtitle, true visible, v1 as version from s5 where u1
union all select tenant_id, id, 'ContactDeleted', '', '', false, v3 from s5 where del3
union all select 't' || (s_suppkey % 4), 's' || s_suppkey, 'ContactCreated', s_name, coalesce(n_name, ''), true, 0
  from supplier left join nation on n_nationkey = s_nationkey""")
oracle("apply_listing_update", """
select id, case when n % 7 = 0 then 'unsupported_op' when n % 23 = 0 or n % 5 = 0 or deleted then 'stale_version' end reject_reason,
  case when ok then case when n % 29 <> 0 then title || ' new' end else title end title,
  case when ok and n % 2 = 0 then 'fresh' else subtitle end subtitle,
  case when ok and n % 3 <> 0 then round((price + 0.005)::decimal(19,3), 2) else price end::double price,
  case when ok and n % 3 <> 0 then 'EUR' else currency end currency,
  case when ok and n % 31 = 0 then 'nobody' else contact_id end contact_id, version + ok::bigint as version
from (select *, id::bigint n, not (id::bigint % 7 = 0 or id::bigint % 23 = 0 or id::bigint % 5 = 0 or deleted) ok from listings)""", "listings")
oracle("validate_changes", """
select id, op, case when op = 'update' and n % 29 = 0 then 'missing_title'
    when op = 'update' and n % 23 = 0 then 'missing_expected_version' when op = 'update' and n % 3 = 0 then 'missing_price'
    when op = 'update' and (n % 41 = 0 or n % 43 = 0) then 'invalid_currency' end invalid,
  case when op = 'update' and n % 31 = 0 then 'contact_missing'
    when op = 'update' and n % 2 = 0 and not exists (select 1 from contacts c where c.tenant_id = l.tenant_id and c.id = l.contact_id and not c.deleted)
    then 'contact_missing' end bad_relation
from (select *, id::bigint n, case when id::bigint % 7 = 0 then 'undelete' else 'update' end op from listings) l""", "listings", "contacts")

oracle("validate_changes_others", """
select 'CONTACT' entity, seq, op, invalid, cast(null as varchar) bad_relation from (
  select id::bigint * 10 + 1 seq, 'update' op, case when id::bigint % 3 = 0 then 'missing_full_name' end invalid from contacts where id::bigint % 2 = 0
  union all select id::bigint * 10 + 2, 'update', case when id::bigint % 7 = 0 then 'missing_expected_version' end from contacts where id::bigint % 4 = 0
  union all select id::bigint * 10 + 3, 'delete', null from contacts where id::bigint % 3 = 0
  union all select id::bigint * 10 + 4, 'undelete', null from contacts where id::bigint % 85 = 0
  union all select id::bigint * 10 + 5, 'bulk_delete', null from contacts where id::bigint % 13 = 0
  union all select s_suppkey * 10, 'insert', null from supplier
  union all select s_suppkey * 10 + 1, 'insert', case when s_suppkey % 3 = 0 then 'missing_full_name' end from supplier where s_suppkey % 10 = 0) c
union all
select 'TRANSACTION', n * 10 + 1, 'update', case when n % 4 <> 0 then 'missing_title' when n % 3 = 0 then 'missing_total' end,
  case when n % 47 = 0 or not exists (select 1 from contacts c where c.tenant_id = t.tenant_id and c.id = t.contact_id and not c.deleted) then 'contact_missing'
    when listing_id is not null and not exists (select 1 from listings l where l.tenant_id = t.tenant_id and l.id = t.listing_id and not l.deleted) then 'listing_missing'
    when listing_id is not null and not exists (select 1 from listings l where l.tenant_id = t.tenant_id and l.id = t.listing_id and l.contact_id = t.contact_id) then 'listing_not_linked' end
from (select *, id::bigint n from transactions) t where n % 2 = 0
union all select 'TRANSACTION', id::bigint * 10 + 2, 'bulk_delete', null, null from transactions where id::bigint % 13 = 0
union all select 'TRANSACTION', id::bigint * 10 + 3, 'delete', null, null from transactions where id::bigint % 4 = 0
union all select 'TRANSACTION', id::bigint * 10 + 4, 'insert', case when listing_id is null then 'missing_listing_id' end, null from transactions where id::bigint % 17 = 0
union all select 'TRANSACTION', id::bigint * 10 + 5, 'insert', 'missing_contact_id', null from transactions where id::bigint % 19 = 0""", "contacts", "listings", "transactions")

# transactions: state after each step of the change set
_TX = """t0 as (select *, id::bigint n, id::bigint % 2 = 0 has1, id::bigint % 2 = 0 and id::bigint % 5 <> 0 and not deleted ok1,
    version + (id::bigint % 5 <> 0 and not deleted)::bigint expected3 from transactions),
t1 as (select * exclude (title, total, currency, status), version + ok1::bigint v1, case when ok1 and n % 4 = 0 then title || ' new' else title end title,
    case when ok1 and n % 3 <> 0 then round((total + 0.005)::decimal(19,3), 2) else total end::double total,
    case when ok1 and n % 3 <> 0 then 'EUR' else currency end currency, case when ok1 and n % 7 = 0 then 'DONE' else status end status from t0),
t2 as (select *, n % 13 = 0 and not deleted ok2, v1 + (n % 13 = 0 and not deleted)::bigint v2, deleted or n % 13 = 0 d2 from t1),
t3 as (select *, n % 4 = 0 and v2 = expected3 and not d2 ok3, v2 + (n % 4 = 0 and v2 = expected3 and not d2)::bigint v3,
    d2 or (n % 4 = 0 and v2 = expected3 and not d2) d3 from t2)"""


def _tx(body: str) -> str:
    from oracle.base import sql
    return sql("", "transactions").rstrip() + "," + _TX + "\n" + body


def _put_tx(name: str, body: str) -> None:
    from oracle.base import ORACLES
    ORACLES[name] = _tx(body)


_put_tx("apply_outcomes", """
select n * 10 + 1 seq, 'update' op, case when not ok1 then 'stale_version' end reject_reason, tenant_id, id, title, status, total, currency, v1 as version, deleted from t3 where has1
union all select n * 10 + 2, 'bulk_delete', case when not ok2 then 'not_live' end, tenant_id, id, title, status, total, currency, v2, d2 from t3 where n % 13 = 0
union all select n * 10 + 3, 'delete', case when not ok3 then 'stale_version' end, tenant_id, id, title, status, total, currency, v3, d3 from t3 where n % 4 = 0
union all select n * 10 + 4, 'insert', 'duplicate_key', tenant_id, id, title, status, total, currency, v3, d3 from t3 where n % 17 = 0
union all select n * 10 + 5, 'insert', 'missing_id', tenant_id, null, null, null, null, null, null, false from t3 where n % 19 = 0""")
_put_tx("apply_transaction_update", "select tenant_id, id, title, status, total, currency, v1 as version, deleted from t3")
_put_tx("apply_transaction_bulk_delete", "select tenant_id, id, (not deleted)::bigint affected from t3 where n % 13 = 0")
_put_tx("change_events_bulk", "select 'TRANSACTION' entity_type, tenant_id, id entity_id, 'DELETE' as action from t3 where ok2")

# Who moved: place 2 in even blocks or without a place 3; 1 and 0 if the next place moved or is not there.
_CHAIN = """
k0 as (select *, id::bigint k, id::bigint // 16 block, id::bigint % 16 // 4 place from contacts),
m2 as (select *, block % 2 = 0 or k + 4 not in (select k from k0) moved from k0 where place > 1),
m1 as (select a.*, b.k is null or b.moved moved from k0 a left join m2 b on b.k = a.k + 4 where a.place = 1 union all select * from m2),
m0 as (select a.*, b.k is null or b.moved moved from k0 a left join m1 b on b.k = a.k + 4 where a.place = 0 union all select * from m1),
asked as (select step, c.*, f.k first_k, f.moved first_moved,
    case when step in (2, 3) or step = 1 and c.block % 2 = 1 then 'CUSTOMER.' || lpad((c.k + 4)::varchar, 9, '0')
      when step = 5 then 'other' || (c.k - 12) else 'other' || c.k end || '@example.com' wish
  from m0 c join (values (1, 2), (2, 1), (3, 0), (4, 0), (5, 3)) s(step, who) on c.place = who
  left join m0 f on f.k = c.k - 12 and c.place = 3)"""


def _put_chain(name: str, body: str) -> None:
    from oracle.base import ORACLES, sql
    ORACLES[name] = sql("", "contacts").rstrip() + "," + _CHAIN + "\n" + body


_put_chain("apply_unique", """
select step * 1000000000000 + k seq, tenant_id, id, reason reject_reason,
  case when reason is null then wish when step = 4 then 'CUSTOMER.' || lpad((k + 4)::varchar, 9, '0') || '@example.com' else email end email,
  version + (reason is null or step = 4)::bigint as version
from (select *, case when step < 4 then case when not moved then 'not_unique' end when step = 4 then case when moved then 'stale_version' end
    when first_k is not null and not first_moved then 'not_unique' end reason from asked)""")


def _checked() -> None:
    from oracle.base import ORACLES
    oracle("apply_checked", f"""
select n as seq, id, op, case when reason is null and wants and n <> first then 'not_unique' else reason end reject_reason,
  case when reason is null and n = first then 'shared-' || tenant_id else mls_id end mls_id,
  version + (reason is null and not (wants and n <> first))::bigint as version
from (select *, min(case when reason is null and wants then n end) over (partition by tenant_id) as first
  from (select l.*, l.id::bigint n, v.op, l.id::bigint % 10 = 8 wants, coalesce(v.invalid, v.bad_relation,
      case when v.op = 'undelete' then 'unsupported_op' when l.id::bigint % 23 = 0 or l.id::bigint % 5 = 0 or deleted then 'stale_version' end) reason
    from listings l join ({ORACLES["validate_changes"]}) v on v.id = l.id))""", "listings")


_checked()
