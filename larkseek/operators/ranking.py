"""Match predicates, scores, caps, normalisation and grouping of hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkseek.functions.fulltext import (item_vector_sql, lexeme_line_sql, lexemes_sql, matches_all_sql, rank_sql, term_hits_sql,
                                         with_item_tsv, with_query_terms)
from larkseek.functions.text import contains_like_sql, normalize_query, staged, with_like_columns
from larkseek.functions.trigrams import jaccard_of_sql, trigram_sql, windows_sql
from larkseek.schemas import ENTITY_TYPES, HIT_PREFIX

# Candidate cap, short-query length, score weights.
HARD_CAP = 200
SHORT_LENGTH = 2
RANK_WEIGHT = 0.9
TRIGRAM_WEIGHT = 0.3
SCORE_DIGITS = 6

QUERY_KEY = ["tenant_id", "norm"]


def with_search_columns(items: DataFrame, mode: str = "simple", windows: bool = True) -> DataFrame:
    """Everything a query needs of an item, computed once per item.

    ``probe_keys`` are the raw 1-, 2- and 3-character windows of both texts (plus the heads of the
    lexemes when stemming can change a word, plus the empty key every item has); without ``windows``
    they are left out.
    """
    if "probe_keys" in items.columns:
        return items
    sub = "coalesce(subtitle_lc, '')"
    keys = ["array('')"] + [windows_sql(t, q) for t in ("title_lc", sub) for q in (1, 2, 3)]
    if mode == "english":
        keys += [f"transform(tsv, e -> substring(e.lexeme, 1, {q}))" for q in (1, 2, 3)]
    probe_keys = {"probe_keys": f"array_distinct(concat({', '.join(keys)}))"} if windows else {}
    out = with_item_tsv(items, mode).selectExpr("*", "lower(title) as title_lc", "lower(subtitle) as subtitle_lc")
    return staged(out, *items.columns, "title_lc", "subtitle_lc", "tsv", lexeme_line=lexeme_line_sql(),
                  title_tg=trigram_sql("title_lc"), subtitle_tg=trigram_sql("subtitle_lc"), **probe_keys)


def distinct_queries(queries: DataFrame, mode: str = "simple", reference_compat: bool = False) -> DataFrame:
    """Distinct non-empty (tenant, normalised text) pairs with their parsed form.

    Type-ahead logs repeat themselves; equal queries are answered once and joined back later. A
    query without a tenant has no answer; :func:`typeahead_batch` reports it as ``no_tenant``.
    """
    base = (queries.select("tenant_id", normalize_query("q").alias("norm"))
            .where("norm <> '' and tenant_id is not null").distinct())
    out = (with_query_terms(base, mode, reference_compat)
           .selectExpr("*", "lower(norm) as term", f"length(norm) <= {SHORT_LENGTH} as is_short",
                       f"{trigram_sql('norm')} as term_tg"))
    return with_like_columns(out)


def verified(pairs: DataFrame) -> DataFrame:
    """Keep the (query, item) pairs the query really matches.

    The substring test is staged, so that the filter stays above the candidate join: merged into
    the join condition its lambda would take join and explode out of generated code.
    """
    like = f"{contains_like_sql('title_lc')} or {contains_like_sql('subtitle_lc')}"
    tested = staged(pairs, *pairs.columns, is_like=like)
    if "lexeme_line" in pairs.columns:
        words = matches_all_sql()
    else:
        # words are cut only where both texts hold all terms somewhere
        line = f"concat_ws(' ', '', {lexemes_sql('title')}, {lexemes_sql('subtitle')})"
        words = (f"forall(terms, t -> contains(title_lc, t) or contains(coalesce(subtitle_lc, ''), t)) "
                 f"and exists(array({line}), l -> {matches_all_sql('l')})")
    return tested.where(f"is_like or (not is_short and {words})").drop("is_like")


def with_trigrams(pairs: DataFrame) -> DataFrame:
    """Trigrams of the texts of (query, item) pairs that came without them."""
    return staged(pairs, *pairs.columns, title_tg=trigram_sql("title_lc"), subtitle_tg=trigram_sql("subtitle_lc"))


def scored(pairs: DataFrame) -> DataFrame:
    """Add ``fts_score``, ``trigram`` and ``score``.

    Long queries: 0.9 rank + 0.3 title similarity. Short ones: 0.3 best similarity, rank 0. Scores
    are rounded to six digits, so the tie order never hangs on the last bit of a double.
    """
    # without a vector it is made here, for matches of long queries only
    hits = term_hits_sql() if "tsv" in pairs.columns else f"transform(array({item_vector_sql()}), v -> {term_hits_sql('v')})[0]"
    # what both hold is counted once, outside the branches that use it
    met = pairs.selectExpr("*", "size(array_intersect(term_tg, title_tg)) as _title_n", "size(array_intersect(term_tg, subtitle_tg)) as _sub_n")
    parts = met.selectExpr(
        "*", f"{jaccard_of_sql('title_tg', 'term_tg', '_title_n')} as _title_sim", f"{jaccard_of_sql('subtitle_tg', 'term_tg', '_sub_n')} as _sub_sim",
        f"if(is_short, null, {hits}) as _hits")
    ranked = parts.selectExpr("*", f"{rank_sql('_hits')} as _rank")
    return ranked.selectExpr(
        "*", f"round(greatest(_title_sim, _sub_sim), {SCORE_DIGITS}) as trigram", f"round(_rank, {SCORE_DIGITS}) as fts_score",
        f"round(if(is_short, greatest(_title_sim, _sub_sim) * {TRIGRAM_WEIGHT}D, _rank * {RANK_WEIGHT}D + "
        f"greatest(0D, _title_sim) * {TRIGRAM_WEIGHT}D), {SCORE_DIGITS}) as score").drop("_title_n", "_sub_n", "_title_sim", "_sub_sim", "_hits", "_rank")


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("entity_id").asc(), F.col("entity_type").asc()]


def hard_cap(hits: DataFrame, cap: int = HARD_CAP, salt_buckets: int = 8, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    """Best ``cap`` hits per query, with ``position`` 1..cap.

    Each task first keeps its own best (a group limit below the shuffle), then ``salt_buckets``
    reducers per query keep theirs, and only those rows meet in one place. So a query that matches
    a third of all items never sends more than ``cap * salt_buckets`` rows to one task.
    """
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64("entity_id", "entity_type"), F.lit(salt_buckets)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*_order())
    final = Window.partitionBy(*keys).orderBy(*_order())
    return (salted.withColumn("position", F.row_number().over(first)).where(F.col("position") <= cap)
            .drop("_salt").withColumn("position", F.row_number().over(final)).where(F.col("position") <= cap))


def score_bounds(capped: DataFrame, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    return capped.groupBy(*keys).agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"),
                                     F.count("*").alias("n_rows"))


def normalize_scores(capped: DataFrame, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    """Min-max normalise to [0, 1] over the capped rows of a query; 0 when all scores are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return (capped.withColumn("_lo", lo).withColumn("_hi", hi)
            .withColumn("norm_score", F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0))
                        .otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
            .drop("_lo", "_hi"))


def topn_per_type(hits: DataFrame, n: int | Column, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    """Best ``n`` hits per query and entity type, ``type_rank`` 1..n. Unknown types are dropped."""
    w = Window.partitionBy(*keys, "entity_type").orderBy(*_order())
    return (hits.where(F.col("entity_type").isin(list(ENTITY_TYPES)))
            .withColumn("type_rank", F.row_number().over(w)).where(F.col("type_rank") <= n))


def hits_by_type(hits: DataFrame, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    """Hit ids per query and type in rank order, with their number. ``hits`` are capped hits, so a
    list holds at most the cap."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "entity_id")))
    return (hits.where(F.col("entity_type").isin(list(ENTITY_TYPES))).groupBy(*keys, "entity_type")
            .agg(ordered.alias("_o"))
            .select(*keys, "entity_type", F.size("_o").cast("long").alias("n_hits"),
                    F.transform("_o", lambda e: e["entity_id"]).alias("entity_ids")))


def _hit_sql(entity: str) -> str:
    mls = ", cast(null as string) as mlsId" if entity == "LISTING" else ""
    return (f"sort_array(collect_list(if(entity_type = '{entity}', struct(type_rank, "
            f"concat('{HIT_PREFIX[entity]}', entity_id) as id, title, nullif(subtitle, '') as subtitle, "
            f"float(norm_score) as score, entity_id as {entity.lower()}Id{mls}), null))) as {entity.lower()}")


def grouped_hits(ranked: DataFrame, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    """One row per query with six hit arrays in rank order. ``ranked`` comes from
    :func:`topn_per_type`, which bounds every array."""
    return ranked.groupBy(*keys).agg(*[F.expr(_hit_sql(t)) for t in ENTITY_TYPES])
