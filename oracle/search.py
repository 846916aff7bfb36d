"""SQL twins of the text, score and type-ahead queries."""

from oracle.base import CTES, ORACLES, WORD, jaccard, oracle, trigrams

K = "tenant_id, norm, entity_type, entity_id"

oracle("query_tokens", f"""
select src, norm, len(toks) n_tokens, array_to_string(list_transform(toks, lambda t: t || ':*'), ' & ') tsquery
from (select src, norm, list_filter(string_split(norm, ' '), lambda t: t <> '') toks
      from (select src, regexp_replace(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') norm
            from (select query_id::varchar src, q from queries
                  union all select conv_id || '/' || turn, "text" from conversations)))""", "queries")
oracle("tsv_build", "select tenant_id, entity_type, entity_id, lexeme, pos::bigint pos, weight from lex", "lex")
oracle("document_tsv", f"""
select doc_id, len(ws)::bigint entries, len(list_distinct(ws))::bigint lexemes, len(ws)::bigint last_pos
from (select doc_id, regexp_extract_all(lower("text"), '{WORD}') ws from documents)""")
oracle("listing_vector", f"""
select id, ws[i] lexeme, (i + off)::bigint pos, weight from (
  select id, regexp_extract_all(lower(title), '{WORD}') ws, 0 off, 'A' weight from listings
  union all select id, regexp_extract_all(lower(subtitle), '{WORD}'), len(regexp_extract_all(lower(title), '{WORD}')), 'B' from listings
  union all select id, regexp_extract_all(lower(mls_id), '{WORD}'), len(regexp_extract_all(lower(title || ' ' || subtitle), '{WORD}')), 'A' from listings
) x, unnest(range(1, len(ws) + 1)) u(i)""", "listings")
oracle("trigram_similarity", f"""
select id, round({jaccard("ta", "tb")}, 6) sim from (
  select id, {trigrams("a")} ta, {trigrams("b")} tb from (
    select 'p' || p_partkey id, p_name a, 'Red ' || p_type b from part
    union all select 'o' || id, title, case when version > 0 then 'order ' || contact_id end from transactions))""", "transactions")
oracle("fts_match", f"select {K} from pairs where not is_short", "pairs")
oracle("short_query", f"select {K}, fts_score, score from scored where is_short", "scored")
oracle("ts_rank", f"select {K}, fts_score from scored where not is_short", "scored")
oracle("hybrid_score", f"select {K}, trigram, score from scored", "scored")
oracle("hard_cap", f"select {K}, score, position from capped", "capped")
oracle("score_bounds", """
select tenant_id, norm, min(score) min_score, max(score) max_score, count(*) n_rows from capped group by 1, 2""", "capped")
oracle("score_normalize", f"select {K}, round(ns, 6) norm_score from normed", "normed")
oracle("topn_per_type", f"select {K}, type_rank from typed where type_rank <= 5", "typed")
oracle("hits_by_type", """
select tenant_id, norm, entity_type, count(*) n_hits, string_agg(entity_id, ',' order by position) ids
from capped group by 1, 2, 3""", "capped")

TYPES = ("CONTACT", "LISTING", "REFERRAL", "TRANSACTION", "PRODUCT", "MAILING")
_text = "hit_id || '|' || title || '|' || coalesce(subtitle, '-')"
oracle("hits_grouped", "select tenant_id, norm, " + ", ".join(
    f"coalesce(string_agg({_text}, ';' order by type_rank) filter (entity_type = '{t}'), '') {t.lower()}" for t in TYPES)
    + " from typed where type_rank <= 5 group by 1, 2", "typed")


def _answer(extra: str = "") -> str:
    ids = ", ".join(
        f"coalesce(string_agg(hit_id, ',' order by type_rank) filter (entity_type = '{t}'), '') {t.lower()}" for t in TYPES)
    return f"""
select query_id, a.tenant_id, case when count(hit_id) > 0 then 'ok' else 'empty' end as result, {ids}{extra}
from (select *, case when lim < 1 then 5 when lim > 50 then 50 else lim end n,
        regexp_replace(trim(q), '\\s+', ' ', 'g') nq from queries) a
left join typed h on h.tenant_id = a.tenant_id and h.norm = a.nq and h.type_rank <= a.n
group by 1, 2"""


oracle("typeahead_batch", _answer(
    ", round(coalesce(max(ns) filter (entity_type = 'CONTACT'), -1.0), 4) best_contact"), "typed", "queries")
ORACLES["typeahead_postings"] = ORACLES["typeahead_batch"]
oracle("substring_candidates", f"select {K} from pairs where tl like '%' || term || '%' or sl like '%' || term || '%'", "pairs")
oracle("prefix_lexemes", """
select q.tenant_id, term, lexeme, count(distinct entity_type || '/' || entity_id) n_items
from (select distinct tenant_id, unnest(terms) term from dq where not is_short) q join lex l on l.tenant_id = q.tenant_id and starts_with(lexeme, term)
group by 1, 2, 3""", "dq", "lex")
# the same answer for the customer queries: only the query CTE differs
_saved = CTES["queries"]
CTES["queries"] = CTES["customer_queries"]
for _name in ("typeahead_shuffled", "typeahead_with_stats", "typeahead_layout"):
    oracle(_name, _answer(), "typed", "queries")
CTES["queries"] = _saved
# the same queries over the items after four batches of events, batch by batch
CTES["items_before"] = CTES["items"]
CTES["batched"] = (["acts"], """
  select * from acts qualify row_number() over (partition by tenant_id, entity_id order by event_id % 4 desc, event_id desc) = 1""")
_saved = CTES["items"]
CTES["items"] = (["items_before", "batched"], """
  select i.* from items_before i anti join batched b using (tenant_id, entity_type, entity_id)
  union all select tenant_id, entity_type, entity_id, title, subtitle from batched where action = 'UPSERT'""")
oracle("layout_after_events", """
select tenant_id, lexeme, count(distinct entity_type || '/' || entity_id) n_items from lex group by 1, 2""", "lex")
oracle("postings_after_events", f"select {K}, score, position from capped", "capped")
CTES["items"] = _saved
