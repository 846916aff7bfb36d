"""Candidates of type-ahead queries from a written inverted index.

Full text: each prefix term is a range of the sorted dictionary; the term whose words have the
fewest items is looked up. Substrings: the rarest windows of the literal text are looked up and their
lists merged by counting, an item being a candidate when all of them hold it. Items are read only
for the (query, item) pairs that are left, and verified exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkseek.operators import ranking as R
from larkseek.sources.postings import END, Postings, gram_slab, materialized, page_of

#: Sorts after every text that begins with what stands before it.
AFTER = "\U0010ffff"
#: Windows merged per query, and how much longer than the shortest list a further one may be.
MERGED, LONGER = 3, 8


def prefix_words(prefixes: DataFrame, index: Postings) -> DataFrame:
    """(prefix, word, n_items, slab): the dictionary words that begin with each distinct ``prefix``;
    counts of all batches are added, and words that no item has any more are left out."""
    bounds = prefixes.select(F.col("prefix").alias("low"), F.concat("prefix", F.lit(AFTER)).alias("high"))
    placed = page_of(bounds.select(F.explode(F.array("low", "high")).alias("word")).distinct(), index.pages)
    ranges = (bounds.join(placed.select(F.col("word").alias("low"), F.col("page").alias("from_page")), "low")
              .join(placed.select(F.col("word").alias("high"), F.col("page").alias("to_page")), "high"))
    wanted = ranges.select(F.col("low").alias("prefix"), F.explode(F.sequence("from_page", "to_page")).alias("page"))
    return (index.dictionary.join(wanted, "page").where("startswith(word, prefix)").groupBy("prefix", "word")
            .agg(F.sum("n_items").alias("n_items"), F.max("slab").alias("slab")).where("n_items > 0"))


def _asked_slabs(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only the folders that ``wanted`` names: a filter that prunes the scan (at most as many values
    as there are folders)."""
    return df.where(F.col("slab").isin([r[0] for r in wanted.select("slab").distinct().collect()]))


def fulltext_candidates(asked: DataFrame, index: Postings) -> DataFrame:
    """(query, item) pairs in which the item has a lexeme for the query's rarest term."""
    terms = asked.where("not is_short").select(*R.QUERY_KEY, F.explode("terms").alias("term")).withColumn("prefix", F.concat("tenant_id", F.lit(END), "term"))
    words = materialized(prefix_words(terms.select("prefix").distinct(), index), "prefix-words")
    cost = words.groupBy("prefix").agg(F.sum("n_items").alias("n"))
    rarest = (terms.join(cost, "prefix", "left").groupBy(*R.QUERY_KEY)
              .agg(F.min_by("prefix", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "prefix")).alias("prefix")))
    chosen = materialized(rarest.join(words.select("prefix", "word", "slab"), "prefix").select(*R.QUERY_KEY, "word", "slab"), "chosen-words")
    return _asked_slabs(index.lexemes, chosen).select("word", "item").join(chosen.drop("slab"), "word").select(*R.QUERY_KEY, "item")


def substring_candidates(asked: DataFrame, index: Postings) -> DataFrame:
    """(query, item) pairs in which the item holds all of the query's rarest windows."""
    from larkseek.plans.typeahead import _windows
    options = (asked.selectExpr(*R.QUERY_KEY, r"split(term, r'\\.|[%_\\]') as _literals").selectExpr(*R.QUERY_KEY, f"explode({_windows('_literals')}) as gram")
               .withColumn("word", F.concat("tenant_id", F.lit(END), "gram")))
    # the stored words that hold a window: itself, or those that begin with one of one or two characters
    size = f"length(word) - instr(word, '{END}')"
    held = index.gram_counts.groupBy("word").agg(F.sum("n_items").alias("n_items")).where("n_items > 0")
    stored = held.selectExpr("word as stored", "n_items", f"explode(if({size} = 0, array(word), array(left(word, length(word) - 2), left(word, length(word) - 1), word))) as word")
    stored = materialized(stored.join(options.select("word").distinct(), "word", "left_semi"), "stored-windows")
    cost = stored.groupBy("word").agg(F.sum("n_items").alias("n"))
    counted = options.join(cost, "word", "left").groupBy(*R.QUERY_KEY, "word").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    # a query has at most as many windows as characters
    picked = counted.groupBy(*R.QUERY_KEY).agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("g")).selectExpr(
        *R.QUERY_KEY, f"filter(slice(g, 1, {MERGED}), x -> x.n <= {LONGER} * g[0].n) as g")
    wanted = picked.selectExpr(*R.QUERY_KEY, "shiftleft(1, size(g)) - 1 as need", "posexplode(g.word) as (nth, word)")
    chosen = wanted.join(stored.select("word", "stored"), "word").selectExpr(*R.QUERY_KEY, "need", "shiftleft(1, nth) as bit", "stored as word")
    chosen = materialized(chosen.withColumn("slab", gram_slab()), "chosen-windows")
    return (_asked_slabs(index.grams, chosen).select("word", "item").join(chosen.drop("slab"), "word")
            .groupBy(*R.QUERY_KEY, "item", "need").agg(F.bit_or("bit").alias("met")).where("met = need").select(*R.QUERY_KEY, "item"))


def candidate_pairs(asked: DataFrame, index: Postings) -> DataFrame:
    """Distinct queries with the items that may match them, ready for verification."""
    asked = materialized(asked, "asked-queries")
    pairs = materialized(fulltext_candidates(asked, index).unionByName(substring_candidates(asked, index)).distinct(), "candidate-pairs")
    items = index.items.select("item", "entity_type", "entity_id", "title", "subtitle", "title_lc", "subtitle_lc", "tsv", "lexeme_line", "title_tg", "subtitle_tg")
    return items.join(pairs, "item").drop("item").join(asked, R.QUERY_KEY)
