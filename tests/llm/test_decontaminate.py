import hashlib
import re

from llm_cases import LONG, PROSE, clashing, empty, odd_docs, odd_rows, rows

from larkseek.llm import decontaminate
from larkseek.llm.common import table
from larkseek.llm.decontaminate import SLICE_WORDS

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ITEMS = [(1, ITEM), (10, "The Lazy DOG"), (2, ""), (3, None), (None, "green forest"), (10, "the lazy dog"), (5, ITEM.replace("fifteen", "sixteen"))]
FILLER = "lorem ipsum dolor sit amet " * 30


def words(t):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().translate(lower))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            b = words(item)
            n = min(13, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s:s + n] == b[k:k + n]:
                        hit.update(range(s, s + n))
                        names.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    return [r[:2] for r in odd_rows() if r[1] != LONG] + [
        (20, ITEM), (21, ITEM.upper().replace(" ", ", ")), (22, FILLER + ITEM), (23, FILLER * 10 + " ".join(ITEM.split()[1:14]) + "!"),
        (24, " ".join(ITEM.split()[:12])), (25, "the lazy dog the lazy dog"), (26, "green forest " * 3), (27, "lazy dog the")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    docs = spark.createDataFrame(cases(), "doc_id long, text string").repartition(3)
    want = brute(cases(), ITEMS)
    assert rows(decontaminate.report(docs, bench(spark))) == want
    # slices of two words: several passes give the same hits
    assert rows(decontaminate.report(docs, bench(spark), slice_words=60)) == want


def test_given_table(spark, sf):
    docs, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    pick = [tuple(r) for r in docs.where("length(text) < 1200").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in decontaminate.report(docs, b).collect()}
    for w in brute(pick, [tuple(r) for r in b.select("item_id", "text").collect()]):
        assert got[w[0]] == w
    assert len(got) == docs.count()


def test_long_text_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, LONG + ITEM), (2, LONG)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench(spark)).collect()}
    assert got[1]["n_hit"] == 15 and not got[1]["contaminated"] and got[2]["n_hit"] == 0
    assert got[1]["n_words"] == got[2]["n_words"] + 15
    assert decontaminate.report(empty(spark), bench(spark)).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.report(docs, bench(spark, [])).collect())


def test_removal_keeps_clean_rows_as_they_are(spark):
    docs = clashing(spark.createDataFrame(cases(), "doc_id long, text string"))
    bad = {r[0] for r in brute(cases(), ITEMS) if r[5]}
    for size in (SLICE_WORDS, 60):
        left = decontaminate.decontaminate(docs, bench(spark), slice_words=size)
        assert left.schema == docs.schema
        assert rows(left) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] not in bad), key=repr)


def test_removal_of_spans(spark):
    data = [(1, f"Before, {ITEM}. After."), (2, PROSE.replace("lazy", "busy").replace("green", "red")), (3, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench(spark), remove="spans").collect()}
    assert got == {1: "Before, . After.", 2: data[1][1], 3: None}
    assert decontaminate.decontaminate(odd_docs(spark), bench(spark), remove="spans").count() == len(odd_rows())
