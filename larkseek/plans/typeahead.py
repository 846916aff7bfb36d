"""Many type-ahead queries against the item table in one job.

Every query names one probe key: a character window that any matching item must contain. Items
expose all their windows, so candidates come from an equi join on (tenant, window) and are then
verified exactly. Nothing pairs all queries with all items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkseek.functions.trigrams import qgrams_sql, trigram_sql
from larkseek.operators import ranking as R
from larkseek.operators.reads import group_limit
from larkseek.plans.postings import candidate_pairs
from larkseek.functions.text import normalize_query
from larkseek.schemas import ENTITY_TYPES, ITEM_KEY
from larkseek.sources.postings import Postings, materialized

# Largest probe side that is broadcast; beyond it the candidate join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
JOIN_SALTS = 16
# Most words of 64 bits that are broadcast to thin out postings before a shuffle; up to four asked (tenant, window) pairs
# a word about one posting in a hundred passes unasked, with more pairs more do.
KEY_ROWS = 1 << 21
# Size of the long windows, by which a long query finds few items however many there are, and the least size of a whole
# term that may stand in for one.
LONG = 8
MIDDLE = 4
BUCKETS = 1 << 16
#: Texts are cut into pieces of so many places before their windows are.
PIECE = 256
#: SQL: a row of :func:`window_rows` is the first of its key in its item.
FIRST_PLACE = "(size = 0 or if(in_sub, instr(subtitle_lc, key) = at and not contains(title_lc, key), instr(title_lc, key) = at))"
#: Up to so many keys of one size a tenant, texts are tested for each key instead of being cut into windows.
FEW_KEYS = 16
#: All windows of an item: the stored short ones and the longer ones.
_ALL_KEYS = f"array_distinct(concat(probe_keys, {', '.join(qgrams_sql(t, q) for t in ('title_lc', "coalesce(subtitle_lc, '')") for q in range(MIDDLE, LONG + 1))}))"


def gram_stats(items: DataFrame, mode: str = "simple") -> DataFrame:
    """Item count per (tenant, window): lets every query probe with its rarest window. Written next
    to the items by the index build; counts combine before the shuffle. Long windows, nearly as many as
    there are texts, are counted together by the bucket of their hash, so the table stays small."""
    short = R.with_search_columns(items, mode).select("tenant_id", F.explode_outer("probe_keys").alias("key"))
    texts = items.selectExpr("tenant_id", "lower(title) as title_lc", "lower(subtitle) as subtitle_lc")
    # each kind is counted by itself: the short ones as they are stored, the long ones cut in generated code
    buckets = (window_rows(texts, [LONG]).where(FIRST_PLACE).selectExpr("tenant_id", f"pmod(xxhash64(key), {BUCKETS}) as _bucket")
               .groupBy("tenant_id", "_bucket").agg(F.count("*").alias("n_items")))
    return short.groupBy("tenant_id", "key").agg(F.count("*").alias("n_items")).unionByName(
        buckets.selectExpr("tenant_id", "concat('long ', _bucket) as key", "n_items"))


def _bucket(key: str) -> str:
    """SQL for what a long window is counted as; longer than any short window."""
    return f"concat('long ', pmod(xxhash64({key}), {BUCKETS}))"


def _long_windows(parts: str) -> str:
    """SQL for the long windows of the parts; none if all are shorter."""
    return f"array_distinct(flatten(transform({parts}, p -> {qgrams_sql('p', LONG)})))"


def _windows(parts: str) -> str:
    """SQL for the windows of the longest usable size (3, 2, 1) in the parts; the empty key if none."""
    def of(q: int) -> str:
        return f"array_distinct(flatten(transform({parts}, p -> {qgrams_sql('p', q)})))"
    longest = f"coalesce(array_max(transform({parts}, p -> length(p))), 0)"
    return f"case when {longest} >= 3 then {of(3)} when {longest} = 2 then {of(2)} when {longest} = 1 then {of(1)} else array('') end"


def query_probes(queries: DataFrame, stats: DataFrame | None = None, mode: str = "simple") -> DataFrame:
    """One or two probe rows per distinct query: ``key``, and ``skip_if`` on a second probe so that
    an item reached by both counts once.

    A substring match implies every window of the literal parts of the term; a full-text match
    implies every window of each term (in english mode: the head of each term). One shared window
    serves both branches; only when there is none are two probes needed. Long windows are taken where
    one serves all branches: of short ones even the rarest is held by a fixed share of all items, so that
    queries which grow with the items would meet ever more of them. As a long window may be a word that all items hold
    (``customer``), the query's other terms of ``MIDDLE`` and more characters are whole windows beside it.
    """
    fts = "array_distinct(transform(terms, t -> substring(t, 1, 3)))" if mode == "english" else _windows("terms")
    q = queries.selectExpr("*", r"split(term, r'\\.|[%_\\]') as _literals").selectExpr(
        "*", f"{_windows('_literals')} as _like", f"if(is_short or size(terms) = 0, null, {fts}) as _fts")
    long_fts = "array()" if mode == "english" else _long_windows("terms")
    middle = f"filter(terms, t -> length(t) >= {MIDDLE} and length(t) < {LONG} and exists(_literals, p -> contains(p, t)))"
    q = q.selectExpr("*", "array_intersect(_like, _fts) as _both", f"if(_fts is null, {_long_windows('_literals')}, "
                     f"array_intersect({_long_windows('_literals')}, {long_fts})) as _eight").selectExpr(
        "*", f"if(_fts is null or size(_eight) = 0, _eight, concat(_eight, {middle})) as _long").selectExpr(
        "*", "case when size(_long) > 0 then _long when _fts is null or size(_both) = 0 then _like else _both end as _first",
        "if(_fts is not null and size(_both) = 0 and size(_long) = 0, _fts, null) as _second")
    if stats is None:
        # Without counts take the last window: endings (digits of a number, a second word) tell
        # entities apart better than shared beginnings.
        last = "array_max(transform(_long, k -> struct(instr(term, k) + length(k) as upto, k as key))).key"
        q = q.selectExpr("*", f"if(size(_long) > 0, {last}, element_at(_first, -1)) as _k1", "element_at(_second, -1) as _k2")
    else:
        q = _rarest(q, stats)
    return q.selectExpr(
        *R.QUERY_KEY, "term", "terms", "is_short", "term_tg", "pattern", "is_wild",
        "inline_outer(filter(array(struct(_k1 as key, cast(null as string) as skip_if), struct(_k2 as key, _k1 as skip_if)), "
        "p -> p.key is not null))")


def _rarest(q: DataFrame, stats: DataFrame) -> DataFrame:
    """Pick the window with the fewest items for each slot; unknown windows count zero. Long windows are counted by
    buckets; a whole term between the sizes counts as the rarest short window in it."""
    options = q.selectExpr(
        *R.QUERY_KEY, "inline_outer(concat(transform(_first, k -> struct(1 as slot, k as key)), "
        "coalesce(transform(_second, k -> struct(2 as slot, k as key)), array())))").selectExpr(
        "*", f"explode(case when length(key) = {LONG} then array({_bucket('key')}) when length(key) >= {MIDDLE} then {qgrams_sql('key', 3)} "
        "else array(key) end) as counted_as")
    counted = options.join(stats.select("tenant_id", F.col("key").alias("counted_as"), "n_items"), ["tenant_id", "counted_as"], "left")
    known = counted.groupBy(*R.QUERY_KEY, "slot", "key").agg(F.min(F.coalesce("n_items", F.lit(0))).alias("n_items"))
    # of windows counted alike the longer one meets fewer items
    cost = F.struct("n_items", -F.length("key"), "key")
    best = known.groupBy(*R.QUERY_KEY).agg(
        F.min_by(F.col("key"), F.when(F.col("slot") == 1, cost)).alias("_k1"),
        F.min_by(F.col("key"), F.when(F.col("slot") == 2, cost)).alias("_k2"))
    return q.join(best, R.QUERY_KEY)


def fits_broadcast(queries: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure the distinct queries (at most two probes each, estimated bytes from their text) before
    deciding to broadcast their probes. Counting stops just past the row bound."""
    width = F.lit(400) + 40 * F.octet_length("norm")
    n, size = queries.select(width.alias("w")).limit(max_rows // 2 + 1).agg(F.count("*"), F.sum("w")).first()
    return 2 * n <= max_rows and 2 * (size or 0) <= max_bytes


_ITEM_SEARCH = ["title", "subtitle", "title_lc", "subtitle_lc", "tsv", "lexeme_line", "title_tg", "subtitle_tg"]


def candidates(probes: DataFrame, laid_items: DataFrame, broadcast: bool, key_rows: int = KEY_ROWS, mode: str = "simple") -> DataFrame:
    """(query, item) pairs that share a probe key, each pair once.

    Broadcast: one pass over the items, no shuffle of them. Otherwise slim (key, item id) postings
    are shuffled against the slim probes on a salted key, so that a window held by a large share of all
    items spreads over many tasks. Postings of windows nobody asks for are dropped before that shuffle
    (:func:`thinned`). The pairs are written once; only the texts of items are shuffled to them, and search
    columns are made for items that have a pair.
    """
    keyed = laid_items.selectExpr(*ITEM_KEY, *_ITEM_SEARCH, f"{_ALL_KEYS} as probe_keys")
    fresh = F.col("skip_if").isNull() | ~F.array_contains("probe_keys", F.col("skip_if"))
    if broadcast:
        exploded = keyed.withColumn("key", F.explode_outer("probe_keys"))
        return exploded.join(F.broadcast(probes), ["tenant_id", "key"]).where(fresh).drop("probe_keys", "key", "skip_if")
    probes = materialized(probes, "probes")
    pairs = _pairs(thinned(keyed.select(*ITEM_KEY, F.explode_outer("probe_keys").alias("key")), probes, key_rows), probes)
    texts = laid_items.select(*ITEM_KEY, "title", "subtitle").join(pairs.select(*ITEM_KEY).distinct(), ITEM_KEY, "left_semi")
    items = R.with_search_columns(texts, mode).selectExpr(*ITEM_KEY, *_ITEM_SEARCH, f"{_ALL_KEYS} as probe_keys")
    met = pairs.join(items, ITEM_KEY).where(fresh).drop("probe_keys", "skip_if")
    return met.join(probes.drop("skip_if"), [*R.QUERY_KEY, "key"]).drop("key")


def thinned(postings: DataFrame, probes: DataFrame, most_words: int = KEY_ROWS, counts: str = "true") -> DataFrame:
    """Postings without most of those that no probe asks for, and where the condition ``counts`` holds. Each asked (tenant,
    window) sets up to four bits of one word of 64, so what is broadcast is bounded however many are asked. With
    ``most_words`` 0 nothing is thinned."""
    if not most_words:
        return postings.where(counts)
    bits = " | ".join(f"shiftleft(1L, int(shiftrightunsigned(_hash, {at}) & 63))" for at in (40, 46, 52, 58))
    words = min(most_words, 1 << max(10, (probes.count() // 4).bit_length()))

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", F.xxhash64("tenant_id", "key")).selectExpr("*", f"pmod(_hash, {words}L) as _word", f"{bits} as _bits").drop("_hash")
    asked = hashed(probes.select("tenant_id", "key")).groupBy("_word").agg(F.expr("bit_or(_bits)").alias("_asked"))
    # one condition, as ``counts`` alone would be tested for every posting, below the join
    return hashed(postings).join(F.broadcast(asked), "_word").where(f"if((_asked & _bits) = _bits, {counts}, false)").select(*postings.columns)


def _pairs(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """Written (item, query, key, skip_if) rows of postings that share a probe key, joined on a salted key."""
    salt = F.pmod(F.xxhash64("entity_id"), F.lit(JOIN_SALTS)).cast("int")
    slim = probes.select(*R.QUERY_KEY, "key", "skip_if")
    spread = slim.withColumn("_salt", F.explode_outer(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return materialized(postings.select(*ITEM_KEY, salt.alias("_salt"), "key").join(spread, ["tenant_id", "key", "_salt"]).drop("_salt"), "candidate-pairs")


def shuffled(probes: DataFrame, items: DataFrame, most_words: int = KEY_ROWS) -> DataFrame:
    """:func:`candidates` beyond the broadcast, simple mode: windows only of sizes that are asked are cut from the texts, in
    generated code, and no column larger than the texts is shuffled. Search columns are left to the matches."""
    probes = materialized(probes, "probes")
    sizes = [r[0] for r in probes.select(F.length("key")).distinct().collect()]
    lower = ["lower(title) as title_lc", "lower(subtitle) as subtitle_lc"]
    windows = window_rows(items.selectExpr(*ITEM_KEY, *lower), sizes)
    pairs = _pairs(thinned(windows, probes, most_words, FIRST_PLACE).select(*ITEM_KEY, "key"), probes)
    texts = items.select(*ITEM_KEY, "title", "subtitle").join(pairs.select(*ITEM_KEY).distinct(), ITEM_KEY, "left_semi")
    # the joins shuffle the texts as they are
    met = pairs.join(texts, ITEM_KEY).join(probes.drop("skip_if"), [*R.QUERY_KEY, "key"]).selectExpr("*", *lower)
    return met.where("skip_if is null or not (contains(title_lc, skip_if) or contains(coalesce(subtitle_lc, ''), skip_if))").drop("key", "skip_if")


def window_rows(items: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """One row per window of the given sizes in ``title_lc`` and ``subtitle_lc``: ``key``, ``size``, its place ``at`` and
    ``in_sub``; size 0 is the empty key, once per item. Repeats are left in.

    Only generators and substrings, all in generated code and without arrays of windows. Texts are cut into
    overlapping pieces first, as a substring is found by counting from the beginning.
    """
    longest = max(sizes, default=0)
    texts = items.where("title_lc is not null").selectExpr(
        "*", "inline(array(struct(title_lc as _text, false as in_sub), struct(coalesce(subtitle_lc, '') as _text, true as in_sub)))")
    pieces = (texts.where("not in_sub or _text <> ''").selectExpr("*", f"explode(sequence(0, greatest(length(_text) - 1, 0) div {PIECE})) as _piece")
              .selectExpr("*", f"substring(_text, int(_piece * {PIECE} + 1), {PIECE + max(longest - 1, 0)}) as _part"))
    places = pieces.selectExpr("*", f"explode(sequence(if(in_sub or _piece > 0, 1, 0), least({PIECE}, length(_part)))) as _i")
    cut = ", ".join(f"struct({q} as size, {f'substring(_part, _i, {q})' if q else "''"} as key)" for q in sorted(sizes))
    return (places.selectExpr("*", f"inline(array({cut}))").where("if(_i = 0, size = 0, size > 0 and _i + size - 1 <= length(_part))")
            .selectExpr(*items.columns, "key", "size", "in_sub", f"int(_piece * {PIECE} + _i) as at"))


def scanned(probes: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`candidates` with a broadcast, simple mode: one pass over the items' texts, no shuffle. A tenant's keys of
    a size are looked up by the windows of the texts or, if they are few, each text is tested for them."""
    probes = materialized(probes, "probes")
    per_tenant = probes.groupBy("tenant_id", F.length("key").alias("size")).agg(F.count_distinct("key").alias("n"))
    sizes = [r["size"] for r in per_tenant.groupBy("size").agg(F.max("n").alias("n")).collect() if r["size"] and r["n"] > FEW_KEYS]
    via = F.when(F.length("key").isin(sizes), F.col("key")).otherwise("")
    # by one long key; different windows of one hash are told apart by the condition
    asked = probes.withColumns({"_via": F.xxhash64("tenant_id", via), "by_window": F.length("key").isin(sizes)}).withColumnsRenamed({"tenant_id": "asker", "key": "probe"})
    grams = ["title_tg", "subtitle_tg"] if "title_tg" in items.columns else [f"{trigram_sql(t)} as {t}_tg" for t in ("title", "subtitle")]
    texts = items.selectExpr(*ITEM_KEY, "title", "subtitle", "lower(title) as title_lc", "lower(subtitle) as subtitle_lc", *grams)
    rows = window_rows(texts, [0, *sizes]).withColumn("_via", F.xxhash64("tenant_id", "key"))
    sub = "coalesce(subtitle_lc, '')"
    # a window counts where it stands first in its item
    first = f"if(in_sub, instr({sub}, probe) = at and not contains(title_lc, probe), instr(title_lc, probe) = at)"
    met = (f"if(size = 0, not by_window and asker = tenant_id and (contains(title_lc, probe) or contains({sub}, probe)), "
           f"by_window and asker = tenant_id and probe = key and {first})")
    fresh = f"(skip_if is null or not (contains(title_lc, skip_if) or contains({sub}, skip_if)))"
    return rows.join(F.broadcast(asked), "_via").where(f"{met} and {fresh}").select(*texts.columns, *[c for c in probes.columns if c not in ("tenant_id", "key", "skip_if")])


def matches(queries: DataFrame, items: DataFrame | None, stats: DataFrame | None = None, mode: str = "simple",
            broadcast: bool | None = None, reference_compat: bool = False, postings: Postings | None = None,
            only: str = "true") -> DataFrame:
    """All verified and scored (distinct query, item) pairs. With ``postings`` candidates come from
    the written index and ``items`` is not read. ``only`` is a condition on the distinct queries."""
    asked = R.distinct_queries(queries, mode, reference_compat).where(only)
    if postings is not None:
        pairs = R.verified(candidate_pairs(asked, postings))
    else:
        if broadcast is None:
            broadcast = fits_broadcast(asked)
        probes = query_probes(asked, stats, mode)
        if mode == "simple":
            pairs = R.verified(scanned(probes, items)) if broadcast else R.with_trigrams(R.verified(shuffled(probes, items)))
        else:
            pairs = R.verified(candidates(probes, R.with_search_columns(items, mode), broadcast, mode=mode))
    return R.scored(pairs).select(
        *R.QUERY_KEY, "is_short", "entity_type", "entity_id", "title", "subtitle", "fts_score", "trigram", "score")


def ranked_hits(queries: DataFrame, items: DataFrame | None, per_group: int | None = None, cap: int = R.HARD_CAP, **how) -> DataFrame:
    """Capped, normalised and per-type ranked hits of every distinct query (flat rows). ``cap`` is
    the number of best candidates a query keeps before ranking per type.

    The windows after the cap share its partitioning, so the only shuffles are those of the cap.
    """
    top = per_group if per_group is not None else 50
    return R.topn_per_type(R.normalize_scores(R.hard_cap(matches(queries, items, **how), cap)), top)


def typeahead_batch(queries: DataFrame, items: DataFrame | None, **how) -> DataFrame:
    """Answer each row of ``queries(query_id, tenant_id, q, limit_per_group)`` with six hit arrays.

    Empty queries and queries without hits get empty arrays. ``result`` is ok or empty, or no_tenant for a query that names no tenant.
    """
    asked = queries.select("query_id", "tenant_id", "q", normalize_query("q").alias("norm"),
                           group_limit(F.col("limit_per_group")).alias("n"))
    grouped = R.grouped_hits(ranked_hits(queries, items, **how))
    joined = asked.join(grouped, R.QUERY_KEY, "left")
    # each query takes its own number of hits from the shared answer
    cols = [F.expr(f"slice(coalesce({t.lower()}, array()), 1, n) as {t.lower()}") for t in ENTITY_TYPES]
    out = joined.select("query_id", "tenant_id", "q", *cols)
    some = " or ".join(f"size({t.lower()}) > 0" for t in ENTITY_TYPES)
    return out.selectExpr("*", f"case when tenant_id is null then 'no_tenant' when {some} then 'ok' else 'empty' end as result")
