"""Shared CTEs: the same views over the driver tables that the Spark side uses."""

from __future__ import annotations

from larkseek.fixtures import QUERY_TEXTS

WORD = "[\\p{L}\\p{N}]+"
ORACLES: dict[str, str] = {}


def trigrams(e: str) -> str:
    return (f"list_distinct(flatten(list_transform(regexp_extract_all(lower({e}), '{WORD}'), "
            "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


def jaccard(a: str, b: str) -> str:
    x = f"len(list_intersect({a}, {b}))"
    return (f"(case when {a} is null or {b} is null then null when len({a}) + len({b}) - {x} = 0 then 0.0 "
            f"else {x}::double / (len({a}) + len({b}) - {x}) end)")


_QTEXT = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUERY_TEXTS))

CTES: dict[str, tuple[list[str], str]] = {
    "contacts": ([], """
      select c_custkey::varchar id, 't' || (c_custkey % 4) tenant_id, c_name full_name,
        replace(lower(c_name), '#', '.') || '@example.com' email,
        case when c_custkey % 5 <> 0 then '+48 ' || c_custkey end phone, c_mktsegment label,
        c_custkey % 3 as version, c_custkey % 17 = 0 as deleted from customer"""),
    "listings": ([], """
      select p_partkey::varchar id, 't' || (p_partkey % 4) tenant_id, p_name title, p_type subtitle,
        p_brand || '-' || p_partkey mls_id, p_retailprice::decimal(19,2) price, 'USD' currency,
        (p_partkey % (select count(*) from customer))::varchar contact_id,
        p_partkey % 3 as version, p_partkey % 19 = 0 as deleted from part"""),
    "transactions": ([], """
      select o_orderkey::varchar id, 't' || (o_custkey % 4) tenant_id, 'Order ' || o_orderkey title,
        o_orderpriority subtitle, o_totalprice::decimal(19,2) total, 'USD' currency, o_orderstatus status,
        o_custkey::varchar contact_id, lp.part::varchar listing_id,
        o_orderkey % 3 as version, o_orderkey % 23 = 0 as deleted
      from orders left join (select l_orderkey, min(l_partkey) part from lineitem group by 1) lp on l_orderkey = o_orderkey"""),
    "items": (["contacts", "listings", "transactions"], """
      select tenant_id, 'CONTACT' entity_type, id entity_id, full_name title, label subtitle from contacts where not deleted
      union all select tenant_id, 'LISTING', id, title, subtitle || mls_id from listings where not deleted
      union all select tenant_id, 'TRANSACTION', id, title, subtitle from transactions where not deleted
      union all select 't' || (s_suppkey % 4), 'REFERRAL', s_suppkey::varchar, s_name, n_name
        from supplier left join nation on n_nationkey = s_nationkey
      union all select 't0', 'PRODUCT', p_brand || '/' || p_type, p_type, p_brand from (select distinct p_brand, p_type from part)
      union all select 't' || (item_id % 4), 'MAILING', item_id::varchar, "text", null from benchmark"""),
    "contacts_raw": (["contacts"], """
      select * exclude (email), case when id::bigint % 53 = 0 then null
        when id::bigint % 59 = 0 and id::bigint >= 4 then upper('customer.' || lpad((id::bigint - 4)::varchar, 9, '0') || '@example.com')
        when id::bigint % 29 = 0 then '  ' || email || ' ' else email end email from contacts"""),
    "listings_raw": (["listings"], """
      select l.* exclude (price, currency, mls_id), (p_retailprice + 0.005)::decimal(19,3) price,
        case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then '  ' when p_partkey % 17 = 0 then ' usd '
          when p_partkey % 41 = 0 then 'US1' else currency end currency,
        case when p_partkey % 31 <> 0 then mls_id end mls_id
      from listings l join part on p_partkey = l.id::bigint"""),
    "transactions_raw": (["transactions"], """
      select * exclude (total, status, contact_id), case when id::bigint % 3 = 0 then total + 1 end amount,
        case when id::bigint % 37 <> 0 then total end total, case when id::bigint % 43 <> 0 then status end status,
        case when id::bigint % 47 = 0 then '-1' else contact_id end contact_id from transactions"""),
    # what each contact record means, straight from the event columns
    "ev": ([], """
      select event_id, user_id, event_type,
        case when event_id % 97 = 0 then 'tombstone' when event_id % 101 = 0 then 'bad_json'
          when event_id % 41 = 0 then 'missing_ids' when event_id % 103 = 0 then 'unknown_type'
          when event_type <> 'error' and visible and event_id % 29 = 0 then 'missing_title' end skip_reason,
        case when event_type <> 'error' and visible then 'UPSERT' else 'DELETE' end action, visible,
        't' || (user_id % 4) tenant_id, user_id::varchar entity_id,
        case when event_id % 29 = 0 then '' else 'User ' || user_id || ' ' || event_type end title,
        case when event_id % 5 <> 0 then event_type end subtitle, (event_id * 7919) % 1000003 as version
      from (select *, event_id % 37 <> 0 and event_id % 31 <> 0 visible from events)"""),
    "acts": (["ev"], """
      select event_id, tenant_id, 'CONTACT' entity_type, entity_id, action, version,
        case when action = 'UPSERT' then title end title, case when action = 'UPSERT' then subtitle end subtitle
      from ev where skip_reason is null"""),
    "last": (["acts"], """
      select * from acts qualify row_number() over (partition by tenant_id, entity_id order by event_id desc) = 1"""),
    "newest": (["acts"], """
      select * from acts qualify row_number() over (partition by tenant_id, entity_id order by version desc, event_id desc) = 1"""),
    "outbox": (["contacts", "listings", "transactions"], """
      select *, id % 3 = 0 as published, case when id % 101 = 0 then 'CAMPAIGN' else entity end aggregate_type from (
        select id::bigint * 4 id, tenant_id, id aggregate_id, 'CONTACT' entity, 'ContactUpdated' "type" from contacts
        union all select id::bigint * 4 + 1, tenant_id, id, 'LISTING', 'ListingCreated' from listings
        union all select id::bigint * 4 + 2, tenant_id, id, 'TRANSACTION', 'TransactionDeleted' from transactions)"""),
    "log": ([], """
      select event_id, 't' || (user_id % 4) tenant_id,
        case when event_type = 'error' then 'error' when event_type = 'view' then 'empty' else 'ok' end as result,
        value * 10 as latency_ms, user_id from events"""),
    "queries": ([], f"""
      select i * 4 + t query_id, 't' || t tenant_id, q, [5, 50, 0, 99][t + 1] lim
        from (values {_QTEXT}) v(i, q), range(0, 4) r(t)
      union all select min(p_partkey) + 1000, 't' || (p_partkey % 4),
        split_part(p_name, ' ', 1) || ' ' || substr(split_part(p_name, ' ', 2), 1, 2), 5 from part group by 2, 3"""),
    "customer_queries": ([], """
      select 10000000000 + c_custkey query_id, 't' || (c_custkey % 4) tenant_id,
        substr(lower(c_name), 1, length(c_name) - case when c_custkey % 2 = 0 then 0 when c_custkey % 4 = 1 then 1 else 4 end) q, 5 lim from customer"""),
    "lex": (["items"], f"""
      select tenant_id, entity_type, entity_id, ws[i] lexeme, i pos, 'A' weight
        from (select *, regexp_extract_all(lower(title), '{WORD}') ws from items) x, unnest(range(1, len(ws) + 1)) u(i)
      union all
      select tenant_id, entity_type, entity_id, vs[i], len(ws) + i, 'B'
        from (select *, regexp_extract_all(lower(title), '{WORD}') ws, regexp_extract_all(lower(coalesce(subtitle, '')), '{WORD}') vs
              from items) x, unnest(range(1, len(vs) + 1)) u(i)"""),
    "itx": (["items"], f"""
      select *, lower(title) tl, lower(subtitle) sl, {trigrams("title")} ttg, {trigrams("subtitle")} stg,
        ' ' || array_to_string(regexp_extract_all(lower(title || ' ' || coalesce(subtitle, '')), '{WORD}'), ' ') line from items"""),
    "dq": (["queries"], f"""
      select distinct tenant_id, norm, lower(norm) term, length(norm) <= 2 is_short,
        list_sort(list_distinct(regexp_extract_all(lower(norm), '{WORD}'))) terms, {trigrams("norm")} qtg
      from (select tenant_id, regexp_replace(trim(q), '\\s+', ' ', 'g') norm from queries) where norm <> ''"""),
    "pairs": (["dq", "itx"], f"""
      select q.*, i.* exclude (tenant_id), {jaccard("ttg", "qtg")} tsim, {jaccard("stg", "qtg")} ssim
      from dq q join itx i on i.tenant_id = q.tenant_id
      where tl like '%' || term || '%' or sl like '%' || term || '%'
        or (not is_short and len(terms) > 0
            and len(list_filter(terms, lambda t: contains(line, ' ' || t))) = len(terms))"""),
    "th": (["pairs", "lex"], """
      select p.tenant_id, norm, p.entity_type, p.entity_id, len(terms) n_terms, t.t, lexeme, pos,
        case weight when 'A' then 1.0 else 0.4 end::double w,
        max(lexeme) over (partition by p.tenant_id, norm, p.entity_type, p.entity_id, t.t) lastlex
      from (select tenant_id, norm, entity_type, entity_id, terms from pairs where not is_short) p, unnest(terms) t(t)
      join lex l on l.tenant_id = p.tenant_id and l.entity_type = p.entity_type and l.entity_id = p.entity_id
        and starts_with(lexeme, t.t)"""),
    "rank1": (["th"], """
      select tenant_id, norm, entity_type, entity_id, sum((wm + resj - wm / (jm * jm)) / 1.64493406685) r from (
        select tenant_id, norm, entity_type, entity_id, lexeme, max(w) wm, sum(w / (j * j)) resj, arg_max(j, w * 100000 - j) jm
        from (select *, row_number() over (partition by tenant_id, norm, entity_type, entity_id, lexeme order by pos) j
              from th where n_terms = 1) group by 1, 2, 3, 4, 5) group by 1, 2, 3, 4"""),
    "rank2": (["th"], """
      select a.tenant_id, a.norm, a.entity_type, a.entity_id,
        1 - product(1 - sqrt(a.w * b.w * case when abs(a.pos - b.pos) > 100 then 1e-30
                    else 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5::double - 2)) end)) r
      from th a join th b on a.tenant_id = b.tenant_id and a.norm = b.norm and a.entity_type = b.entity_type
        and a.entity_id = b.entity_id and a.t < b.t and a.lexeme = a.lastlex and a.pos <> b.pos
      where a.n_terms > 1 group by 1, 2, 3, 4"""),
    "scored": (["pairs", "rank1", "rank2"], """
      select tenant_id, norm, is_short, entity_type, entity_id, title, subtitle, round(coalesce(r, 0.0), 6) fts_score,
        round(greatest(tsim, ssim), 6) trigram,
        round(case when is_short then greatest(tsim, ssim) * 0.3
              else coalesce(r, 0.0) * 0.9::double + greatest(0.0, tsim) * 0.3::double end, 6) score
      from pairs left join (select * from rank1 union all select * from rank2) using (tenant_id, norm, entity_type, entity_id)"""),
    "capped": (["scored"], """
      select *, row_number() over (partition by tenant_id, norm order by score desc, entity_id, entity_type) as position
      from scored qualify position <= 200"""),
    "normed": (["capped"], """
      select *, case when max(score) over w = min(score) over w then 0.0
        else (score - min(score) over w) / (max(score) over w - min(score) over w) end ns
      from capped window w as (partition by tenant_id, norm)"""),
    "typed": (["normed"], """
      select *, row_number() over (partition by tenant_id, norm, entity_type order by score desc, entity_id) type_rank,
        case entity_type when 'CONTACT' then 'c_' when 'LISTING' then 'l_' when 'REFERRAL' then 'r_'
          when 'TRANSACTION' then 't_' when 'PRODUCT' then 'p_' else 'm_' end || entity_id hit_id from normed"""),
}


def sql(body: str, *needs: str) -> str:
    """Prefix a query with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            add(dep)
        order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in order) + "\n" + body


def oracle(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = sql(body, *needs)
