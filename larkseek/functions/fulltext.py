"""Weighted full-text vectors, prefix matching and rank.

A vector is ``array<struct<lexeme, pos, weight>>`` sorted by (lexeme, pos): one entry per
occurrence, so an entry list and a lexeme-to-positions map hold the same information and the
build stays one sort per text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkseek.functions.english import STOP_WORDS, stem_word, stem_words

# The default weight of each label, and the constant of the single-term sum.
LABEL_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
PI_SQUARED_OVER_SIX = 1.64493406685

# Fixed value: characters with a meaning in full-text query syntax.
OPERATOR_CHARS = "[&|!():'\\\\<*]"


def lexemes_sql(text: str) -> str:
    """SQL for the lower-cased words of a text, in text order (the simple configuration)."""
    return f"regexp_extract_all(lower(coalesce({text}, '')), r'[\\p{{L}}\\p{{N}}]+', 0)"


def _vector_sql(parts: Sequence[tuple[str, str]]) -> str:
    """SQL for the vector of labelled word-array columns. A null word keeps its position but has no
    entry; positions of a part continue after the last entry of the parts before it."""
    pieces, shift = [], "0"
    for words, label in parts:
        pieces.append(f"filter(transform({words}, (w, i) -> named_struct('lexeme', w, 'pos', int(i + 1 + {shift}), "
                      f"'weight', '{label}')), e -> e.lexeme is not null)")
        last = f"coalesce(array_max(transform({words}, (w, i) -> if(w is null, 0, i + 1))), 0)"
        shift = last if shift == "0" else f"if({last} > 0, {last} + {shift}, {shift})"
    return f"sort_array(concat({', '.join(pieces)}))"


def tsvector(parts: Sequence[tuple[str, str]]) -> Column:
    """Simple-mode vector of labelled text columns, e.g. ``[("title", "A"), ("subtitle", "B")]``."""
    return F.expr(_vector_sql([(lexemes_sql(text), label) for text, label in parts]))


def concat_vectors(left: str, right: str) -> Column:
    """Join two vector columns; positions on the right continue after the last one on the left."""
    return F.expr(f"sort_array(concat({left}, transform({right}, e -> named_struct('lexeme', e.lexeme, 'pos', "
                  f"int(e.pos + coalesce(array_max(transform({left}, x -> x.pos)), 0)), 'weight', e.weight))))")


def listing_search_vector(title: str = "title", subtitle: str = "subtitle", mls_id: str = "mls_id") -> Column:
    """Vector of a listing row: title A, subtitle B, MLS id A, always in simple mode."""
    return tsvector([(title, "A"), (subtitle, "B"), (mls_id, "A")])


def _with_words(df: DataFrame, mode: str, **texts: str) -> DataFrame:
    """Add word arrays of text columns; english mode stems them and nulls stop words."""
    out = df.selectExpr("*", *[f"{lexemes_sql(t)} as {name}" for name, t in texts.items()])
    if mode == "english":
        for name in texts:
            out = out.withColumn(name, stem_words(F.col(name)))
    elif mode != "simple":
        raise ValueError(f"unknown text mode {mode!r}")
    return out


def with_item_tsv(items: DataFrame, mode: str = "simple") -> DataFrame:
    """Add the ``tsv`` of a search item: title A, subtitle B."""
    words = _with_words(items, mode, _t="title", _s="subtitle")
    return words.selectExpr("*", f"{_vector_sql([('_t', 'A'), ('_s', 'B')])} as tsv").drop("_t", "_s")


def item_vector_sql() -> str:
    """SQL for the simple-mode ``tsv`` of a search item, from its texts."""
    return _vector_sql([(lexemes_sql("title"), "A"), (lexemes_sql("subtitle"), "B")])


def lexeme_counts(texts: DataFrame, text: str, mode: str = "simple") -> DataFrame:
    """(lexeme, n): how often each lexeme stands in a text column. Words are counted before they are
    stemmed, so Python sees each distinct word of the table once and never a row's text."""
    words = texts.selectExpr(f"explode({lexemes_sql(text)}) as lexeme").groupBy("lexeme").agg(F.count("*").alias("n"))
    if mode == "simple":
        return words
    if mode != "english":
        raise ValueError(f"unknown text mode {mode!r}")
    # by a filter on the stem, which is pushed below the count, every occurrence would be stemmed
    stems = words.where(~F.col("lexeme").isin(STOP_WORDS)).select(stem_word(F.col("lexeme")).alias("lexeme"), "n")
    return stems.groupBy("lexeme").agg(F.sum("n").alias("n"))


def with_query_terms(queries: DataFrame, mode: str = "simple", reference_compat: bool = False) -> DataFrame:
    """Add ``terms``, the distinct sorted prefix terms of ``norm``.

    Tokens go through the same word splitting and normalisation as indexed text, so operator
    characters in user text vanish. With ``reference_compat`` a long query holding such characters
    is dropped (there it is a syntax error that ends in an empty answer).
    """
    out = queries
    if reference_compat:
        out = out.where((F.length("norm") <= 2) | ~F.col("norm").rlike(OPERATOR_CHARS))
    words = _with_words(out, mode, _w="norm")
    return words.selectExpr("*", "sort_array(array_distinct(filter(_w, t -> t is not null))) as terms").drop("_w")


def lexeme_line_sql(tsv: str = "tsv") -> str:
    """SQL for all lexemes in one string, each after a blank: prefix tests become substring tests."""
    return f"concat(' ', array_join(transform({tsv}, e -> e.lexeme), ' '))"


def matches_all_sql(line: str = "lexeme_line", terms: str = "terms") -> str:
    """SQL: every term is a prefix of some lexeme; no terms match nothing."""
    return f"(size({terms}) > 0 and forall({terms}, t -> contains({line}, concat(' ', t))))"


def _weight_sql(label: str) -> str:
    whens = " ".join(f"when '{k}' then {v}D" for k, v in LABEL_WEIGHTS.items())
    return f"(case {label} {whens} end)"


def term_hits_sql(tsv: str = "tsv", terms: str = "terms") -> str:
    """SQL: per term, its matching entries as (lexeme, pos, w), sorted by lexeme and position."""
    return (f"transform({terms}, t -> transform(filter({tsv}, e -> startswith(e.lexeme, t)), "
            f"e -> named_struct('lexeme', e.lexeme, 'pos', e.pos, 'w', {_weight_sql('e.weight')})))")


def _single_term_sql(hits: str) -> str:
    """Sum over matched lexemes of (best weight + decayed rest)."""
    closed = f"if(a.j > 0, (a.best + a.decayed - a.best / (a.best_j * a.best_j)) / {PI_SQUARED_OVER_SIX}D, 0D)"
    same = "(a.j > 0 and a.lexeme = e.lexeme)"
    j = f"if({same}, a.j + 1D, 1D)"
    better = f"(not {same} or e.w > a.best)"
    return f"""aggregate({hits},
        named_struct('lexeme', '', 'j', 0D, 'decayed', 0D, 'best', 0D, 'best_j', 0D, 'total', 0D),
        (a, e) -> named_struct('lexeme', e.lexeme, 'j', {j},
            'decayed', if({same}, a.decayed, 0D) + e.w / ({j} * {j}),
            'best', if({better}, e.w, a.best), 'best_j', if({better}, {j}, a.best_j),
            'total', if({same}, a.total, a.total + {closed})),
        a -> a.total + {closed})"""


def _pairwise_sql(hits: str) -> str:
    """1 - prod(1 - c) over position pairs of two different terms. Of the earlier term only the
    positions of its last matching lexeme count."""
    last = f"transform({hits}, h -> filter(h, e -> e.lexeme = element_at(h, -1).lexeme))"
    d = "double(abs(p.pos - q.pos))"
    c = f"if(p.pos = q.pos, 0D, sqrt(p.w * q.w * if({d} > 100, 1e-30D, 1D / (1.005D + 0.05D * exp({d} / 1.5D - 2D)))))"
    return f"""1D - aggregate(sequence(1, size({hits}) - 1), 1D,
        (acc, k) -> acc * aggregate(flatten(slice({last}, 1, k)), 1D,
            (x, p) -> x * aggregate({hits}[k], 1D, (y, q) -> y * (1D - {c}))))"""


def rank_sql(hits: str) -> str:
    """SQL for the rank of AND-ed prefix terms, given their hits; 0 when nothing matches."""
    return (f"(case when coalesce(size({hits}), 0) = 0 then 0D when size({hits}) = 1 then {_single_term_sql(hits + '[0]')} "
            f"else {_pairwise_sql(hits)} end)")


def with_ts_rank(df: DataFrame, tsv: str = "tsv", terms: str = "terms", name: str = "rank") -> DataFrame:
    """Add the rank of a vector for AND-ed prefix terms."""
    return (df.selectExpr("*", f"{term_hits_sql(tsv, terms)} as _hits")
            .selectExpr("*", f"{rank_sql('_hits')} as {name}").drop("_hits"))
