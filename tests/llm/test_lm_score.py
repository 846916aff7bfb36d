import math
import re
from collections import Counter

from llm_cases import LONG, clashing, empty, odd_docs, odd_rows

from larkseek.llm import lm_score
from larkseek.llm.common import table


def words(t):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().translate(lower))


def brute(docs, target):
    seqs = [(i, [".", *words(t), "."]) for i, t in docs]
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, s in seqs:
        for k in (0, 1):
            if k == 1 or i in target:
                uni[k].update(s[1:])
                bi[k].update(zip(s, s[1:], strict=False))
    total, size = [sum(u.values()) for u in uni], len(uni[1])

    def loss(k, h, w):
        p1 = (uni[k][w] + 1) / (total[k] + size)
        return math.log((bi[k][h, w] + 4 * p1) / (uni[k][h] + 4))
    out = []
    for i, s in seqs:
        d = sum(round((loss(1, h, w) - loss(0, h, w)) * 1e6) for h, w in zip(s, s[1:], strict=False))
        out.append((i, len(s) - 1, d))
    return sorted(out, key=repr)


def test_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").where("length(text) < 3000")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    target = {i for i, _ in data if i % 3 == 0}
    got = lm_score.score(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute(data, target)
    assert all(r["score"] == r["loss_difference"] / (1_000_000 * r["n_tokens"]) for r in got)


def test_many_buckets_and_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(lm_score, "BUCKET_ENTRIES", 3000)
    monkeypatch.setattr(lm_score, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lm_score, "BROADCAST_IDS", 0)
    docs = table(spark, sf, "documents").where("length(text) < 1500")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    target = {i for i, _ in data if i % 2}
    got = lm_score.score(docs, spark.createDataFrame([(i,) for i in [*target, *target]], "doc_id long")).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute(data, target)


def test_rows_grow_with_the_tokens(spark, monkeypatch):
    """Every word is counted, a common bigram asks once per block, and rows stay below the words of blocks."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 300)
    asked = {}
    for n in (200, 800):
        docs = spark.createDataFrame([(i, f"shared start w{i} x{i} y{i}", i % 2 == 0) for i in range(n)], "doc_id long, text string, target boolean").repartition(2, "doc_id")
        blocks = lm_score._blocks(docs).persist()
        pairs, words = (lm_score._asks(blocks, how, 200).collect() for how in (lm_score._asked_bigrams, lm_score._asked_words))
        rows = [*pairs, *words]
        asked[n] = sum(len(lm_score._unpacked(bytes(r["data"]), lm_score.ASKED)[0]) for r in rows)
        assert len(rows) <= asked[n]
        digests = {int(d) for r in words for d in lm_score._unpacked(bytes(r["data"]), lm_score.ASKED)[0].cumsum(dtype="uint64")}
        assert len(digests) == 3 * n + 3
    assert asked[800] < 4.2 * asked[200]


def test_odd_rows(spark):
    data = [r[:2] for r in odd_rows()]
    got = lm_score.score(clashing(odd_docs(spark)), spark.createDataFrame([(1,), (None,), (6,)], "doc_id long")).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute(data, {1, 6})
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(empty(spark), none).collect() == []
    assert sorted((tuple(r)[:3] for r in lm_score.score(odd_docs(spark), none).collect()), key=repr) == brute(data, set())


def test_very_long_word(spark):
    data = [(1, "ab" * 500_000 + " tail"), (2, "x" * 65 + " tail")]
    got = lm_score.score(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long")).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute(data, {2}) and len(LONG) > 10 ** 6
