"""Batch type-ahead against a brute-force reading of the predicate, and its invariants."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from larkseek.functions.english import STOP_WORDS, stem
from larkseek.operators import ranking as R
from larkseek.operators import reads as RD
from larkseek.plans import typeahead as TA
from larkseek.schemas import SEARCH_ITEMS
from larkseek.sources.tables import read_search_layout, write_search_layout

SEARCH_COLUMNS = ["tenant_id", "entity_type", "entity_id", "title", "subtitle"]

QS = ["re wi", "red", "r", "ge", "a_b", "%", "50%", "b\\_c", "x\\y", "brand#2", "wi re", "é", "Émile zo", "--", "_", "redd",
      "houses", "the house", "running", "of", "", "  ", "happy", "ring small", "customer#000", "0001"]


@pytest.fixture(scope="module")
def items(spark):
    rnd = random.Random(3)
    vocab = ["red", "widget", "bolt", "ring", "small", "brand#2", "houses", "happily", "running", "the", "a_b", "50%", "b_c",
             "xy", "Émile", "Zola", "Customer#0001", "geg", "—"]
    rows = []
    for i in range(150):
        title = " ".join(rnd.choices(vocab, k=rnd.randint(1, 4)))
        sub = None if i % 5 == 0 else " ".join(rnd.choices(vocab, k=rnd.randint(0, 3)))
        rows.append((f"t{i % 3 and 1}", ["CONTACT", "LISTING", "PRODUCT"][i % 3], str(i), title, sub))
    return spark.createDataFrame(rows, SEARCH_ITEMS).repartition(4), rows


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i * 2 + t, f"t{t}", q, 3 + t) for i, q in enumerate(QS) for t in (0, 1)]
    return spark.createDataFrame(rows, "query_id bigint, tenant_id string, q string, limit_per_group int")


def like(term, text):
    if text is None:
        return False
    out, i = "", 0
    pat = "%" + term + "%"
    while i < len(pat):
        ch = pat[i]
        if ch == "\\" and i + 1 < len(pat):
            i += 1
            out += re.escape(pat[i])
        else:
            out += {"%": ".*", "_": "."}.get(ch, re.escape(ch))
        i += 1
    return re.fullmatch(out, text, re.S) is not None


def lex(text, english):
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    return [stem(w) for w in ws if w not in STOP_WORDS] if english else ws


def brute(rows, english):
    want = set()
    for t in ("t0", "t1"):
        for q in QS:
            norm = re.sub(r"\s+", " ", q.strip())
            if not norm:
                continue
            term, terms = norm.lower(), set(lex(norm, english))
            for tenant, kind, i, title, sub in rows:
                if tenant != t:
                    continue
                words = lex(title, english) + lex(sub, english)
                fts = len(norm) > 2 and terms and all(any(w.startswith(x) for w in words) for x in terms)
                if fts or like(term, title.lower()) or like(term, sub and sub.lower()):
                    want.add((t, norm, kind, i))
    return want


@pytest.mark.parametrize("english", [False, True])
@pytest.mark.parametrize("how", ["broadcast", "shuffle", "stats"])
def test_same_as_brute_force(items, queries, english, how):
    df, rows = items
    mode = "english" if english else "simple"
    kw = {"stats": TA.gram_stats(df, mode)} if how == "stats" else {"broadcast": how == "broadcast"}
    got = [tuple(r) for r in TA.matches(queries, df, mode=mode, **kw).select("tenant_id", "norm", "entity_type", "entity_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, english)


def test_invariants(items, queries):
    df, rows = items
    tenant_of = {i: t for t, _, i, _, _ in rows}
    flat = TA.ranked_hits(queries, df, 2).collect()
    assert flat
    for r in flat:
        assert tenant_of[r.entity_id] == r.tenant_id
        assert 0.0 <= r.norm_score <= 1.0
        assert r.type_rank <= 2
    answers = TA.typeahead_batch(queries, df).collect()
    assert len(answers) == len(QS) * 2
    for a in answers:
        limit = 3 + int(a.tenant_id[1])
        assert all(len(a[k]) <= limit for k in ("contact", "listing", "product"))
        if not a.q.strip():
            assert a.result == "empty" and a.contact == []
        for h in a.contact:
            assert h.id == "c_" + h.contactId
        for h in a.listing:
            assert h.mlsId is None


def test_single_hit_normalises_to_zero(spark):
    df = spark.createDataFrame([("t0", "CONTACT", "1", "Sam Chen", "Buyer lead")], SEARCH_ITEMS)
    q = spark.createDataFrame([(1, "t0", "sam", 5), (2, "t1", "sam", 5)], "query_id bigint, tenant_id string, q string, limit_per_group int")
    got = {r.query_id: r for r in TA.typeahead_batch(q, df).collect()}
    assert got[1].contact[0].score == 0.0 and got[1].contact[0].title == "Sam Chen"
    assert got[2].contact == [] and got[2].result == "empty"


def test_cap_is_exact_across_salts(spark):
    rows = [("t0", "q", "CONTACT", str(i), float(i % 50)) for i in range(1000)]
    df = spark.createDataFrame(rows, "tenant_id string, norm string, entity_type string, entity_id string, score double")
    want = sorted(rows, key=lambda r: (-r[4], r[3]))[:200]
    got = R.hard_cap(df).orderBy("position").collect()
    assert [(r.entity_id, r.position) for r in got] == [(w[3], i + 1) for i, w in enumerate(want)]


def test_operator_characters(spark):
    df = spark.createDataFrame([("t0", "CONTACT", "1", "Sam & Co", None)], SEARCH_ITEMS)
    q = spark.createDataFrame([(1, "t0", "sam & co", 5)], "query_id bigint, tenant_id string, q string, limit_per_group int")
    assert TA.typeahead_batch(q, df).first().result == "ok"
    assert TA.typeahead_batch(q, df, reference_compat=True).first().result == "empty"


def test_broadcast_needs_a_measured_size(items, queries):
    asked = R.distinct_queries(queries)
    assert TA.fits_broadcast(asked)
    assert not TA.fits_broadcast(asked, max_rows=5)
    assert not TA.fits_broadcast(asked, max_bytes=100)


def test_shuffled_candidates_without_thinning(items, queries):
    laid = R.with_search_columns(items[0])
    probes = TA.query_probes(R.distinct_queries(queries))
    cols = ["tenant_id", "norm", "entity_type", "entity_id"]
    sets = [sorted(map(tuple, TA.candidates(probes, laid, b, k).select(*cols).collect())) for b, k in ((True, 0), (False, 0), (False, 10_000))]
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) == len(set(sets[0]))


def test_argument_guards(spark):
    assert [RD.search_limit(x) for x in (None, 0, -1, 7, 100, 101)] == [20, 20, 20, 7, 100, 20]
    assert RD.page_bounds(-3, 500) == (0, 200) and RD.page_bounds(None, None) == (0, 50) and RD.page_bounds(5, 0) == (5, 1)
    assert [RD.api_group_limit(x) for x in (None, 0, 21)] == [5, 1, 20]
    with pytest.raises(ValueError):
        RD.require_tenant(" ")


def test_long_queries_meet_few_items_however_many_there_are(spark):
    """Whole names share their last three digits with many items, yet are met by their own one."""
    rows = [("t0", "CONTACT", str(i), f"Customer#{i:09d}", "x") for i in range(300)]
    rows += [("t0", "TRANSACTION", str(i), f"Order {i}", "x") for i in range(1000, 16000)]
    laid = R.with_search_columns(spark.createDataFrame(rows, SEARCH_ITEMS))
    asked = R.distinct_queries(spark.createDataFrame([(i, "t0", f"customer#{i:09d}", 5) for i in range(0, 300, 7)],
                                                     "query_id bigint, tenant_id string, q string, limit_per_group int"))
    for stats in (None, TA.gram_stats(laid)):
        for broadcast in (True, False):
            met = TA.candidates(TA.query_probes(asked, stats), laid, broadcast)
            assert met.where("entity_type = 'CONTACT'").count() >= asked.count() and met.count() <= 4 * asked.count()


@pytest.mark.parametrize("few", [0, 16])
@pytest.mark.parametrize("piece", [5, 256])
def test_scanned_texts_meet_what_their_windows_meet(spark, items, queries, monkeypatch, few, piece):
    """Keys tested one by one or found by windows, in whole texts or in pieces of long ones: the same pairs, each once."""
    monkeypatch.setattr(TA, "FEW_KEYS", few)
    monkeypatch.setattr(TA, "PIECE", piece)
    more = spark.createDataFrame([("t0", "MAILING", "long", "red widget é " * 40 + "ring small", "ge" * 300), ("t0", "MAILING", "blank", "", None)], SEARCH_ITEMS)
    texts = items[0].unionByName(more)
    probes = TA.query_probes(R.distinct_queries(queries))
    cols = ["tenant_id", "norm", "entity_type", "entity_id"]
    got = sorted(map(tuple, TA.scanned(probes, texts).select(*cols).collect()))
    assert got == sorted(map(tuple, TA.candidates(probes, R.with_search_columns(texts), True).select(*cols).collect())) and len(got) == len(set(got))


def test_a_scan_makes_no_arrays_of_windows(items, queries):
    plan = TA.matches(queries, items[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(" in plan and "probe_keys" not in plan and plan.count("regexp_extract_all(title") <= 8


@pytest.mark.parametrize("laid", [False, True])
@pytest.mark.parametrize("words", [0, 1, 1 << 21])
def test_shuffled_texts_meet_what_their_windows_meet(items, queries, words, laid):
    """However few words thin the postings out: the same pairs, each once."""
    texts = R.with_search_columns(items[0]) if laid else items[0]
    probes = TA.query_probes(R.distinct_queries(queries))
    cols = ["tenant_id", "norm", "entity_type", "entity_id"]
    got = sorted(map(tuple, TA.shuffled(probes, texts, words).select(*cols).collect()))
    assert got == sorted(map(tuple, TA.candidates(probes, R.with_search_columns(items[0]), True).select(*cols).collect())) and len(got) == len(set(got))


def test_postings_nobody_asks_for_are_dropped_however_many_are_asked(spark):
    """More asked windows than words are broadcast: few others pass, and all that are asked."""
    keys = spark.range(40_000).selectExpr("'t0' as tenant_id", "lpad(id, 8, '0') as key")
    met = TA.thinned(keys, keys.where("key % 4 = 0"), 2048)
    assert met.where("key % 4 = 0").count() == 10_000 and met.count() < 12_000
    assert TA.thinned(keys, keys.where("key % 4 = 0")).count() < 10_600


def test_shuffled_candidates_make_no_arrays_of_windows(items, queries):
    plan = TA.matches(queries, items[0], broadcast=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "probe_keys" not in plan and plan.count("regexp_extract_all(title") <= 8


def test_a_word_that_all_items_hold_is_no_probe(spark):
    """Names cut short share their long word with all items, yet meet only those that hold their digits."""
    rows = [("t0", "CONTACT", str(i), f"Customer#{i:09d}", "x") for i in range(0, 100_000, 50)]
    texts = spark.createDataFrame(rows, SEARCH_ITEMS)
    asked = R.distinct_queries(spark.createDataFrame([(i, "t0", f"customer#0000{i}", 5) for i in range(10)],
                                                     "query_id bigint, tenant_id string, q string, limit_per_group int"))
    for stats in (None, TA.gram_stats(R.with_search_columns(texts))):
        met = TA.shuffled(TA.query_probes(asked, stats), texts)
        assert met.where("startswith(title_lc, term)").count() == len(rows) and met.count() <= 1.5 * len(rows)


def test_a_layout_is_made_by_all_tasks_evenly(spark, tmp_path):
    """One large folder is no single task's work, and the rows are all there."""
    rows = [("t0", "TRANSACTION", str(i), f"Order {i}", "5-LOW") for i in range(4000)] + [("t1", "CONTACT", "1", "Sam", None), (None, "CONTACT", "2", "Sam", None)]
    write_search_layout(spark.createDataFrame(rows, SEARCH_ITEMS), str(tmp_path))
    laid = read_search_layout(spark, str(tmp_path))
    files = [r[0] for r in laid.where("tenant_id = 't0'").groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(files) >= 4 and max(files) < 2000
    assert sorted(map(str, laid.select(*SEARCH_COLUMNS).collect())) == sorted(str(Row(**dict(zip(SEARCH_COLUMNS, r)))) for r in rows)


def test_window_counts_of_a_layout(spark, items, tmp_path):
    """Counted as stored, the long ones without arrays of them."""
    df, rows = items
    write_search_layout(df, str(tmp_path))
    stats = TA.gram_stats(read_search_layout(spark, str(tmp_path)))
    assert "regexp_extract_all" not in stats._jdf.queryExecution().optimizedPlan().toString()

    def windows(title, sub, sizes):
        return {t[i:i + q] for t in (title.lower(), (sub or "").lower()) for q in sizes for i in range(len(t) - q + 1 if q else 1)}
    short, long = Counter(), Counter()
    for tenant, _, _, title, sub in rows:
        short.update((tenant, w) for w in windows(title, sub, (0, 1, 2, 3)))
        long[tenant] += len(windows(title, sub, (TA.LONG,)))
    got = stats.collect()
    assert {(r.tenant_id, r.key): r.n_items for r in got if not r.key.startswith("long ")} == short
    assert {t: sum(r.n_items for r in got if r.tenant_id == t and r.key.startswith("long ")) for t in long} == long
