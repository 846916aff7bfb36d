"""Golden values of the scalar expressions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkseek.functions import fulltext as FT
from larkseek.functions import json_fields as J
from larkseek.functions import money as M
from larkseek.functions import text as T
from larkseek.functions import trigrams as G
from larkseek.functions.english import STOP_WORDS, stem


def one(spark, expr, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} string" for n in names) or "z string"
    df = spark.createDataFrame([tuple(cols[n] for n in names) or ("",)], schema)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,norm,tokens,ts", [
    (None, "", [], ""), ("", "", [], ""), ("  sam \t gal ", "sam gal", ["sam", "gal"], "sam:* & gal:*"),
    (" Red\n\nWidget", "Red Widget", ["Red", "Widget"], "Red:* & Widget:*"), ("a", "a", ["a"], "a:*")])
def test_query_text(spark, raw, norm, tokens, ts):
    n = T.normalize_query("q")
    assert one(spark, n, q=raw) == norm
    assert one(spark, T.query_tokens(n), q=raw) == tokens
    assert one(spark, T.prefix_tsquery(T.query_tokens(n)), q=raw) == ts


def test_trims_and_blanks(spark):
    assert one(spark, T.control_trim("q"), q="\t a b\x00\n ") == "a b"
    assert one(spark, T.control_trim("q"), q=" a") == " a"
    assert one(spark, T.is_blank("q"), q="  \t") is True
    assert one(spark, T.is_blank("q"), q=" ") is False
    assert one(spark, T.blank_to_null("q"), q=" x ") == " x "
    assert one(spark, T.blank_to_null("q"), q="  ") is None


@pytest.mark.parametrize("term,text,hit", [
    ("b_lt", "blue bolt", True), ("%", "anything", True), ("50%", "50 percent", True), ("a\\_b", "xa_by", True),
    ("a\\_b", "xaxby", False), ("a\\xb", "axb", True), ("plain", "explaan it", False), ("plain", "plainly", True)])
def test_like(spark, term, text, hit):
    df = spark.createDataFrame([(term, text)], "term string, t string")
    assert T.with_like_columns(df).select(F.expr(T.contains_like_sql("t"))).first()[0] is hit


def test_escape_like(spark):
    assert one(spark, T.escape_like("q"), q="50%_\\") == "50\\%\\_\\\\"


def test_similarity(spark):
    assert round(one(spark, G.similarity("a", "b"), a="word", b="two words"), 6) == 0.363636
    assert one(spark, G.similarity("a", "b"), a="", b="") == 0.0
    assert one(spark, G.similarity("a", "b"), a=None, b="x") is None
    assert one(spark, G.trigram_set("a"), a="a b") == ["  a", " a ", "  b", " b "]


@pytest.mark.parametrize("title,subtitle,q,rank", [
    ("red widget", "x", "red", 0.607927), ("x", "red", "red", 0.243171), ("red red", "", "red", 0.759909),
    ("a b", "c", "zz", 0.0), ("red", "x", "red", 0.607927), ("red", "red", "red", 0.668720)])
def test_rank_single_term(spark, title, subtitle, q, rank):
    df = spark.createDataFrame([(title, subtitle, q)], "title string, subtitle string, norm string")
    got = FT.with_ts_rank(FT.with_query_terms(FT.with_item_tsv(df))).select("rank").first()[0]
    assert round(got, 6) == rank


def test_rank_two_terms(spark):
    import math
    df = spark.createDataFrame([("red widget", None, "re wi")], "title string, subtitle string, norm string")
    got = FT.with_ts_rank(FT.with_query_terms(FT.with_item_tsv(df))).select("rank").first()[0]
    assert math.isclose(got, math.sqrt(1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2))), rel_tol=1e-12)


def test_vector_positions_and_weights(spark):
    df = spark.createDataFrame([("Two-Bedroom apartment", "City", "MLS-1")], "title string, subtitle string, mls_id string")
    v = [tuple(e) for e in df.select(FT.listing_search_vector().alias("v")).first()["v"]]
    assert v == [("1", 6, "A"), ("apartment", 3, "A"), ("bedroom", 2, "A"), ("city", 4, "B"), ("mls", 5, "A"), ("two", 1, "A")]
    two = df.select(FT.tsvector([("title", "A")]).alias("a"), FT.tsvector([("subtitle", "B")]).alias("b"))
    joined = [tuple(e) for e in two.select(FT.concat_vectors("a", "b").alias("v")).first()["v"]]
    assert joined == [("apartment", 3, "A"), ("bedroom", 2, "A"), ("city", 4, "B"), ("two", 1, "A")]


def test_english_vector(spark):
    df = spark.createDataFrame([("The running houses", "of a city", "the houses")], "title string, subtitle string, norm string")
    r = FT.with_query_terms(FT.with_item_tsv(df, "english"), "english").first()
    assert [tuple(e) for e in r["tsv"]] == [("citi", 6, "B"), ("hous", 3, "A"), ("run", 2, "A")]
    assert r["terms"] == ["hous"]


@pytest.mark.parametrize("word,want", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
    ("motoring", "motor"), ("hopping", "hop"), ("hoping", "hope"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("valency", "valenc"), ("digitizer", "digit"), ("radically", "radic"),
    ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"),
    ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"),
    ("generally", "general"), ("skis", "ski"), ("dying", "die"), ("by", "by"), ("year", "year"), ("boys", "boy"), ("gas", "gas")])
def test_stem(word, want):
    assert stem(word) == want


def test_stop_words():
    assert len(STOP_WORDS) == 127 == len(set(STOP_WORDS))


def test_money(spark):
    df = spark.createDataFrame([(None, None), ("2.005", "USD"), ("1", "usd"), ("1", " "), ("1.5", "US1")], "a string, c string")
    got = df.select(M.money(F.col("a").cast("decimal(20,4)"), "c").alias("m"), M.valid_currency("c").alias("ok")).collect()
    assert [(r.m and (r.m.amount, r.m.currency), r.ok) for r in got] == [
        ((Decimal("0.00"), "USD"), True), ((Decimal("2.01"), "USD"), True), (None, False), ((Decimal("1.00"), "USD"), True), (None, False)]


def test_money_rounds_once_and_matches_the_whole_currency(spark):
    df = spark.createDataFrame([("0.00499999999999", "USD\n"), ("0.005", "USD")], "a string, c string")
    got = df.select(M.money_amount(F.col("a").cast("decimal(20,14)")).alias("d"), M.money_amount("a").alias("s"), M.valid_currency("c").alias("ok")).collect()
    assert [(str(r.d), str(r.s), r.ok) for r in got] == [("0.00", "0.00", False), ("0.01", "0.01", True)]


def test_json_access(spark):
    v = '{"a":" x\\t","b":true,"c":{"z":1},"d":12,"e":"true","f":null,"g":1.5,"h":[1],"i":0,"k":"1","l":false}'
    df = spark.createDataFrame([(v,)], "v string").select(J.parse("v").alias("p"))
    texts = df.select(*[J.text_field("p", c).alias(c) for c in "abcdefghz"]).first()
    assert tuple(texts) == ("x", "true", "", "12", "true", "", "1.5", "", "")
    flags = df.select(*[J.bool_field("p", c).alias(c) for c in "abcdefghiklz"]).first()
    assert tuple(flags) == (False, True, False, True, True, False, True, False, False, False, False, False)
    assert df.select(J.bool_field("p", "z", True)).first()[0] is True


def test_mask(spark):
    got = one(spark, T.mask_pii("q"), q="sam\x07 sam@example.com +48 600 000 001")
    assert got == "sam <email> <phone>"


def test_lexeme_counts_stem_distinct_words(spark):
    """Equal to the entries of the vectors, and Python sees no arrays of words; null and empty texts have none."""
    from larkseek.functions import fulltext as FT
    texts = ["Running runs the ÉTÉS and 12 skies", "the running, cats' cat", "", None, "of the", "news 12"]
    df = spark.createDataFrame([(t, None) for t in texts], "title string, subtitle string")
    want = FT.with_item_tsv(df, "english").selectExpr("explode(tsv) as e").groupBy("e.lexeme").count()
    got = FT.lexeme_counts(df, "title", "english")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.rindex("Aggregate")
    lists = spark.createDataFrame([(["the", "cats", None],), (None,), ([],), (["skies"],)], "w array<string>")
    from larkseek.functions.english import stem_words
    assert [r[0] for r in lists.select(stem_words(F.col("w"))).collect()] == [[None, "cat", None], None, [], ["sky"]]
