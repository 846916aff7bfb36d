"""A written inverted index of the search items.

* ``items``: the items with their search columns and a number each.
* ``lexemes``: one row per lexeme occurrence (word, item, pos, weight); ``word`` is tenant and lexeme.
* ``dictionary``: the distinct words in order, cut into pages of 64; ``pages`` has the first of each.
  A prefix is a range of words, so it is found in the pages from its lower to its upper bound.
* ``grams``: one row per window of three characters of an item, filled up at the end of a text, and one with the
  empty window; ``gram_counts``: items per window. A shorter window is the beginning of stored ones.

Lexemes lie in folders by page range and grams in folders by hash; a batch of queries reads the
folders its words stand in. Lexemes inside a file are sorted by word. A word that very many items have
is spread over files by the rebalance before the write.

A batch of changes is written as a delta beside the base: changed items get new numbers, the numbers
they had are retracted, and counts are signed, so what is written follows the batch and not the
table. Pages stay those of the base; a new word belongs to the page it would stand in. Readers name
the batches they want; a batch written again replaces itself. A new full build ends the deltas.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkseek.functions.trigrams import qgrams_sql
from larkseek.operators.ranking import with_search_columns
from larkseek.schemas import ITEM_KEY
from larkseek.session import materialized

PAGE_WORDS = 64
#: Fills windows up at the end of a text, so that shorter windows are beginnings of stored ones.
FILL = "\x01"
#: Longest title and subtitle whose windows are each looked for in the whole text.
SHORT_TEXT = 512
SLABS = 32
#: Schemas of the folders; a table without rows has no file to name them.
SLABBED = {"lexemes": "word string, item bigint, pos int, weight string, slab int", "grams": "word string, item bigint, slab int"}
#: Stands between tenant and text in a word; sorts before everything else.
END = "\x00"


@dataclass(frozen=True)
class Postings:
    items: DataFrame
    lexemes: DataFrame
    dictionary: DataFrame
    pages: DataFrame
    grams: DataFrame
    gram_counts: DataFrame


def word(text: str | Column) -> Column:
    return F.concat("tenant_id", F.lit(END), text)


def gram_slab() -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(SLABS)).cast("int")


def page_of(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``words`` (distinct column word) with ``page``, the last page whose first word is not
    greater, or the first. Pages and words are merged in order, range by range."""
    both = pages.select(F.col("first").alias("word"), F.lit(0).alias("asked"), "page").unionByName(
        words.select("word", F.lit(1).alias("asked"), F.lit(None).cast("long").alias("page")))
    merged = materialized(both.repartitionByRange("word", "asked").withColumn("part", F.spark_partition_id()), "page-merge")
    # one row per range
    last = merged.groupBy("part").agg(F.max("page").alias("last"))
    carried = last.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = F.max("page").over(Window.partitionBy("part").orderBy("word", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return (merged.withColumn("here", here).where("asked = 1").join(F.broadcast(carried), "part")
            .select("word", F.coalesce("here", "carried", F.lit(0)).alias("page")))


def _entries(laid: DataFrame) -> DataFrame:
    return laid.select("tenant_id", "item", F.explode("tsv").alias("e")).select(word(F.col("e.lexeme")).alias("word"), "item", "e.pos", "e.weight")


def _words(laid: DataFrame) -> DataFrame:
    """The distinct words of each item, one row each."""
    return laid.select(F.explode(F.array_distinct(F.transform("tsv", lambda e: F.concat("tenant_id", F.lit(END), e["lexeme"])))).alias("word"))


def _grams(laid: DataFrame) -> DataFrame:
    """The distinct windows of each item: one of three characters from every place, filled up at the end of a
    text, and the empty one. In short texts they are cut in generated code, a window where it stands first."""
    from larkseek.plans.typeahead import FIRST_PLACE, window_rows
    filled = laid.select("tenant_id", "item", *[F.concat(t, F.lit(FILL * 2)).alias(t) for t in ("title_lc", "subtitle_lc")])
    short = f"coalesce(length(title_lc) + coalesce(length(subtitle_lc), 0) <= {SHORT_TEXT}, false)"
    cut = window_rows(filled.where(short), (0, 3)).where(FIRST_PLACE).select(word("key").alias("word"), "item")
    keys = f"array_distinct(concat(array(''), {qgrams_sql('title_lc', 3)}, {qgrams_sql("coalesce(subtitle_lc, '')", 3)}))"
    arrays = filled.where(f"not {short}").selectExpr("tenant_id", "item", f"explode({keys}) as key").select(word("key").alias("word"), "item")
    return cut.unionByName(arrays).withColumn("slab", gram_slab())


def _write_slabs(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "slab", "word").sortWithinPartitions("slab", "word").write.mode("overwrite").partitionBy("slab").parquet(path)


def _write_grams(rows: DataFrame, path: str) -> None:
    """Windows are many times the items and few different ones, so dictionaries of a file compress them without an
    order of their own; the writer orders the rows by folder alone."""
    rows.hint("rebalance", "slab").write.mode("overwrite").partitionBy("slab").parquet(path)


def write_postings(items: DataFrame, path: str, mode: str = "simple") -> None:
    """Full build below ``path``. Items without a tenant are found by no query and have no rows."""
    spark = items.sparkSession
    laid = with_search_columns(items, mode, windows=False).where("tenant_id is not null")
    laid.withColumn("item", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/items")
    laid = spark.read.parquet(f"{path}/items")
    (_words(laid).groupBy("word").agg(F.count("*").alias("n_items")).repartitionByRange("word").sortWithinPartitions("word")
     .withColumn("nth", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/sorted_words"))
    placed = spark.read.parquet(f"{path}/sorted_words").selectExpr("word", "n_items", "shiftright(nth, 33) as part", f"(nth & ((1L << 33) - 1)) div {PAGE_WORDS} as page_here")
    # one row per range
    before = (placed.groupBy("part").agg((F.max("page_here") + 1).alias("n"))
              .select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")))
    numbered = placed.join(F.broadcast(before), "part").select("word", "n_items", (F.col("page_here") + F.col("earlier")).alias("page"))
    n_pages = (numbered.agg(F.max("page")).first()[0] or 0) + 1
    numbered.withColumn("slab", F.expr(f"int(page * {SLABS} div {n_pages})")).sortWithinPartitions("page").write.mode("overwrite").parquet(f"{path}/dictionary")
    dictionary = spark.read.parquet(f"{path}/dictionary")
    dictionary.groupBy("page").agg(F.min("word").alias("first"), F.first("slab").alias("slab")).write.mode("overwrite").parquet(f"{path}/pages")
    _write_slabs(_entries(laid).join(dictionary.select("word", "slab"), "word"), f"{path}/lexemes")
    _write_grams(_grams(laid), f"{path}/grams")
    spark.read.schema(SLABBED["grams"]).parquet(f"{path}/grams").groupBy("word").agg(F.count("*").alias("n_items")).write.mode("overwrite").parquet(f"{path}/gram_counts")


def write_delta(spark: SparkSession, path: str, batch: str, earlier: Sequence[str], last: DataFrame, mode: str = "simple") -> None:
    """Write the changes of one batch: ``last`` has one row per item key with action, title and
    subtitle. ``earlier`` names the batches that it comes after."""
    out = f"{path}/deltas/{batch}"
    now = read_postings(spark, path, earlier)
    gone = now.items.select(*ITEM_KEY, "item", "tsv", "title_lc", "subtitle_lc").join(last.select(*ITEM_KEY), ITEM_KEY, "left_semi")
    gone.write.mode("overwrite").parquet(f"{out}/gone")
    fresh = with_search_columns(last.where("action = 'UPSERT' and tenant_id is not null").select(*ITEM_KEY, "title", "subtitle"), mode, windows=False)
    # numbers of a batch never meet those of the base or of another batch
    fresh.withColumn("item", F.monotonically_increasing_id() + F.lit(len(earlier) + 1) * F.lit(1 << 56)).write.mode("overwrite").parquet(f"{out}/items")
    gone, fresh = spark.read.parquet(f"{out}/gone"), spark.read.parquet(f"{out}/items")
    words = (_words(gone).withColumn("d", F.lit(-1)).unionByName(_words(fresh).withColumn("d", F.lit(1)))
             .groupBy("word").agg(F.sum("d").cast("long").alias("n_items")))
    words = materialized(words, "delta-words")
    placed = page_of(words.select("word"), now.pages).join(now.pages.select("page", "slab"), "page", "left").withColumn("slab", F.coalesce("slab", F.lit(0)))
    words.join(placed, "word").select("word", "n_items", "page", "slab").write.mode("overwrite").parquet(f"{out}/dictionary")
    _write_slabs(_entries(fresh).join(spark.read.parquet(f"{out}/dictionary").select("word", "slab"), "word"), f"{out}/lexemes")
    _write_grams(_grams(fresh), f"{out}/grams")
    (_grams(gone).withColumn("d", F.lit(-1)).unionByName(_grams(fresh).withColumn("d", F.lit(1)))
     .groupBy("word").agg(F.sum("d").cast("long").alias("n_items")).write.mode("overwrite").parquet(f"{out}/gram_counts"))


def read_postings(spark: SparkSession, path: str, batches: Sequence[str] = ()) -> Postings:
    """The base with the changes of ``batches``. Dictionary and gram counts hold a row per word and
    batch, which add up; postings of retracted numbers find no item."""
    def read(name: str) -> DataFrame:
        reader = spark.read.schema(SLABBED[name]) if name in SLABBED else spark.read
        base = reader.parquet(f"{path}/{name}")
        for b in batches:
            more = spark.read.schema(base.schema).parquet(f"{path}/deltas/{b}/{name}")
            base = base.unionByName(more)
        return base

    items = read("items")
    for b in batches:
        items = items.join(spark.read.parquet(f"{path}/deltas/{b}/gone").select("item"), "item", "left_anti")
    return Postings(items, read("lexemes"), read("dictionary"), spark.read.parquet(f"{path}/pages"), read("grams"), read("gram_counts"))
