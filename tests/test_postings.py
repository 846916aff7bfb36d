import os

import pytest
from pyspark.sql import functions as F

from larkseek.operators import ranking as R
from larkseek.plans import catalog as C
from larkseek.plans import postings as PO
from larkseek.plans import typeahead as TA
from larkseek.sources.postings import END, page_of, read_postings, write_delta, write_postings


@pytest.fixture(scope="module")
def built(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings"))
    write_postings(C.item_table(spark, sf), path)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_pages_of_words(spark):
    pages = spark.createDataFrame([("b", 0, 0), ("d", 1, 0), ("é", 2, 0)], "first string, page long, slab int")
    words = ["", "a", "b", "bz", "c", "d", "d" + PO.AFTER, "z", "é", "日本"]
    got = {r["word"]: r["page"] for r in page_of(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), pages).collect()}
    assert got == {"": 0, "a": 0, "b": 0, "bz": 0, "c": 0, "d": 1, "d" + PO.AFTER: 1, "z": 1, "é": 2, "日本": 2}


def test_prefixes_are_ranges_of_the_dictionary(spark, built):
    index = read_postings(spark, built)
    words = [r["word"] for r in index.dictionary.select("word").collect()]
    asked = [f"t{t}{END}{p}" for t in (0, 9) for p in ("", "c", "order", "0000", "zzz", "é", "a" * 50)]
    got = rows(PO.prefix_words(spark.createDataFrame([(p,) for p in asked], "prefix string"), index).select("prefix", "word"))
    assert got == sorted((p, w) for p in asked for w in words if w.startswith(p)) and len(got) > 100
    pages = index.dictionary.groupBy("page").agg(F.count("*"), F.min("word"), F.max("word")).orderBy("page").collect()
    assert [r[0] for r in pages] == list(range(len(pages))) and all(r[1] <= 64 for r in pages)
    assert all(a[3] < b[2] for a, b in zip(pages, pages[1:], strict=False))


def test_hits_equal_the_scan(spark, sf, built):
    odd = spark.createDataFrame([(1, None, "red", 5), (2, "t0", "", 5), (3, "t0", "%_%", 5), (4, "t1", "a\\%", 5), (5, "t9", "red", 5), (6, "t0", "ORDER 1", 5), (7, "t2", "é", 5),
                                 (8, "t3", "x" * 300, 5)], "query_id long, tenant_id string, q string, limit_per_group int")
    asked = C.all_queries(spark, sf).unionByName(odd)
    want = rows(TA.matches(asked, C.item_table(spark, sf)))
    assert rows(TA.matches(asked, None, postings=read_postings(spark, built))) == want and want


def test_candidates_are_few_and_scans_are_pruned(spark, built):
    asked = spark.createDataFrame([(k, "t1", q, 5) for k, q in enumerate(("order 12", "customer#00000001", "economy br", "supplier#0000", "rge"))],
                                  "query_id long, tenant_id string, q string, limit_per_group int")
    index = read_postings(spark, built)
    parsed = R.distinct_queries(asked)
    hits = TA.matches(asked, None, postings=index)
    like = hits.where("contains(lower(title), lower(norm)) or contains(lower(coalesce(subtitle, '')), lower(norm))").count()
    assert 0 < PO.substring_candidates(parsed, index).count() <= 5 * like
    for found in (PO.fulltext_candidates(parsed, index), PO.substring_candidates(parsed, index)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [slab#" in plan and "title" not in plan


def test_deltas_follow_the_batch(spark, sf, built, tmp_path):
    """New, changed, deleted and repeated items; the index equals a rebuild, and few bytes are written."""
    items = C.item_table(spark, sf)
    keys = [tuple(r) for r in items.select("tenant_id", "entity_type", "entity_id").where("entity_type = 'CONTACT'").orderBy("entity_id").limit(6).collect()]
    cols = "tenant_id string, entity_type string, entity_id string, action string, title string, subtitle string"
    one = spark.createDataFrame([(*keys[0], "UPSERT", "Zebra Über crossing", None), (*keys[1], "DELETE", None, None), ("t0", "CONTACT", "new", "UPSERT", "Aardvark 12", "zebra"),
                                 ("t0", "CONTACT", "never", "DELETE", None, None)], cols)
    two = spark.createDataFrame([(*keys[0], "UPSERT", "Crossing again", "x"), (*keys[1], "UPSERT", "back", None), ("t0", "CONTACT", "new", "DELETE", None, None),
                                 (None, "CONTACT", "lost", "UPSERT", "no tenant", None)], cols)
    write_delta(spark, built, "one", [], one)
    write_delta(spark, built, "two", ["one"], two)
    write_delta(spark, built, "two", ["one"], two)
    index = read_postings(spark, built, ["one", "two"])
    after = items.where("true")
    for batch in (one, two):
        after = after.join(batch, C.ITEM_KEY, "left_anti").unionByName(batch.where("action = 'UPSERT'").select(*after.columns))
    write_postings(after, str(tmp_path))
    fresh = read_postings(spark, str(tmp_path))
    for t in ("dictionary", "gram_counts"):
        a = getattr(index, t).groupBy("word").agg(F.sum("n_items").alias("n")).where("n <> 0")
        assert rows(a) == rows(getattr(fresh, t).select("word", "n_items"))
    asked = spark.createDataFrame([(k, t, q, 5) for k, (t, q) in enumerate((t, q) for t in ("t0", "t1", "t2", "t3") for q in ("zebra", "aard", "crossing ag", "back", "cust", "ü"))],
                                  "query_id long, tenant_id string, q string, limit_per_group int")
    assert rows(TA.matches(asked, None, postings=index)) == rows(TA.matches(asked, after))
    # the base holds some 1000 items, a batch three
    assert size(f"{built}/deltas/two") < size(built) / 5
    # readers that do not name the batches still see the base
    assert read_postings(spark, built).items.count() == items.count()


def test_empty_table(spark, sf, tmp_path):
    write_postings(C.item_table(spark, sf).where("false"), str(tmp_path))
    assert TA.matches(C.all_queries(spark, sf), None, postings=read_postings(spark, str(tmp_path))).collect() == []


def test_windows_are_stored_once_a_place(spark, tmp_path):
    """One row for each distinct window of three characters from a place, and the empty one, of short and of long
    texts; shorter windows are found as beginnings of them, at the end of a text too."""
    rows = [("t0", "CONTACT", "1", "abcab", None), ("t0", "CONTACT", "2", "xa", "ab"), ("t0", "CONTACT", "3", "q\x00b", ""), ("t0", "MAILING", "4", "zabab " * 200, "end")]
    items = spark.createDataFrame(rows, "tenant_id string, entity_type string, entity_id string, title string, subtitle string")
    write_postings(items, str(tmp_path))
    index = read_postings(spark, str(tmp_path))
    got = {}
    for r in index.grams.join(index.items.select("item", "entity_id"), "item").collect():
        got.setdefault(r["entity_id"], []).append(r["word"].split(END, 1)[1])
    for _, _, i, title, subtitle in rows:
        want = {""} | {(t + "\x01\x01")[k:k + 3] for t in (title, subtitle or "") for k in range(len(t))}
        assert sorted(got[i]) == sorted(want)
    asked = spark.createDataFrame([(k, "t0", q, 5) for k, q in enumerate(("a", "b", "ab", "xa", "bc", "%", "q\x00", "d", "ba", "zab", "nd"))],
                                  "query_id long, tenant_id string, q string, limit_per_group int")
    parsed = R.distinct_queries(asked)
    met = {}
    for r in PO.substring_candidates(parsed, index).join(index.items.select("item", "entity_id"), "item").collect():
        met.setdefault(r["norm"], []).append(r["entity_id"])
    for q in [r["norm"] for r in parsed.collect()]:
        want = [i for _, _, i, title, subtitle in rows if q == "%" or q in title or q in (subtitle or "")]
        assert sorted(met.get(q, [])) == want
