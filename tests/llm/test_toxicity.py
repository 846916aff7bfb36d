import random
import zlib

from llm_cases import clashing, empty, odd_docs, odd_rows

from larkseek.llm import toxicity

BAD = ["idiot", "stupid", "pathetic", "moron", "worthless"]


def corpus(seed, n):
    rng = random.Random(seed)
    syllables = ["ta", "ne", "ro", "li", "mu", "ke", "so", "vi", "da", "pol", "ster", "ing"]
    out = []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 250))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((k, " ".join(words), int(toxic)))
    return out


def frames(spark, data):
    return (spark.createDataFrame([r[:2] for r in data], "doc_id long, text string"),
            spark.createDataFrame([(r[0], r[2]) for r in data], "doc_id long, toxic int"))


def test_learns_and_scores_unseen_documents_and_misspellings(spark):
    data = corpus(1, 500)
    docs, labels = frames(spark, data)
    scorer = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, scorer).collect()}
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in data)
    right = sum(got[i]["predicted"] == y for i, _, y in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    known = scorer.words()
    filler = data[[r[2] for r in data].index(0)][1]
    plain = scorer.score(filler, known)
    for bad in ("idiott", "stupiid", "patheticc", "morons"):
        assert scorer.score(f"{filler} such a {bad} {filler}", known) > plain + 0.1
    # one passage in a very long text
    assert scorer.score(" ".join([filler] * 300 + ["what a pathetic stupid idiot"] + [filler] * 300), known) >= 0.3


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark):
    data = corpus(2, 120)
    docs, labels = frames(spark, data)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in data]
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert a.prior == b.prior and (a.weights == b.weights).all() and (a.scale, a.shift) == (b.scale, b.shift)


def test_odd_rows(spark):
    data = corpus(3, 80)
    scorer = toxicity.fit(*frames(spark, data))
    docs = clashing(odd_docs(spark))
    got = toxicity.score_documents(docs, scorer).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in odd_rows())
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.score_documents(empty(spark), scorer).collect() == []
    left = toxicity.remove_toxic(docs, scorer)
    kept = {repr(r["doc_id"]) for r in got if r["score"] < 0.3}
    assert left.dtypes == docs.dtypes and {repr(r["doc_id"]) for r in left.collect()} == kept


def test_without_labels_or_with_one_class(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(k, 1) for k in range(10)] + [(None, 0), (1, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, ones)).collect()} == {1.0}


def test_windows_cover_the_whole_text():
    import numpy as np
    weights = np.zeros(toxicity.BUCKETS)
    weights[toxicity.subwords(["hit"])[0]] = 100
    scorer = toxicity.Scorer(weights, -1.0)
    known = scorer.words()
    for n in (1, 7, 8, 9, 12, 13, 100, 101):
        words = [f"w{k}" for k in range(n)]
        base = scorer.log_odds(" ".join(words), known)
        for k in range(n):
            assert scorer.log_odds(" ".join(words[:k] + ["hit"] + words[k + 1:]), known) > base


def test_subwords_of_many_words_equal_those_of_each():
    words = ["idiot", "idiott,", "a", "", "!!!", "Ünï", "x" * 300, "日本語"]
    rows, owner = toxicity.subwords(words)
    for k, w in enumerate(words):
        alone, _ = toxicity.subwords([w])
        assert sorted(rows[owner == k].tolist()) == sorted(alone.tolist())
        n = len(w.strip(toxicity.EDGE) or w) + 2
        assert len(alone) == 1 + sum(max(n - g + 1, 0) for g in toxicity.GRAMS)
    assert len(set(toxicity.subwords(["idiot"])[0]) & set(toxicity.subwords(["idiott"])[0])) >= 8
    assert len(toxicity.subwords([])[0]) == 0


def long_corpus(seed, n):
    """Documents of 600 to 3 000 words; a toxic one has one passage of four toxic words."""
    rng = random.Random(seed)
    syllables = ["ta", "ne", "ro", "li", "mu", "ke", "so", "vi", "da", "pol", "ster", "ing"]
    out = []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(600, 3000))]
        if k % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(BAD, 4)
        out.append((k, " ".join(words), int(k % 3 == 0)))
    return out


def test_every_word_of_a_long_document_is_learned_from(spark):
    docs, labels = frames(spark, [(k, " ".join(f"d{k}w{j}" for j in range(999)), k % 2) for k in range(1, 9)])
    sample = toxicity._worded(toxicity._sampled(docs, labels, "doc_id", "text", "toxic", 100)[0])
    seen = {}
    for r in toxicity._windows(sample).collect():
        seen.setdefault(r["doc_id"], set()).update(r["words"].split())
    assert seen and all(len(v) == 999 for v in seen.values())


def test_long_documents(spark, monkeypatch):
    """One toxic passage anywhere in a long document; also with windows in chunks."""
    data = long_corpus(1, 300)
    docs, labels = frames(spark, data)
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    for chunk in (toxicity.CHUNK, 20_000):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        scorer = toxicity.fit(docs, labels)
        known = scorer.words()
        wrong = [sum((scorer.score(t, known) >= toxicity.THRESHOLD) != y for _, t, y in held if y == c) for c in (0, 1)]
        assert wrong[0] <= 0.1 * len(held) and wrong[1] <= 0.1 * len(held), (chunk, wrong, len(held))


def test_calibration_sees_what_scoring_sees(spark, monkeypatch):
    data = long_corpus(2, 120)
    given = []
    fitted = toxicity._calibrated
    monkeypatch.setattr(toxicity, "_calibrated", lambda x, y, w: given.append((x, y)) or fitted(x, y, w))
    scorer = toxicity.fit(*frames(spark, data))
    known = scorer.words()
    spare = [r for r in data if zlib.crc32(str(r[0]).encode()) % 4 != 2 and zlib.crc32(str(r[0]).encode()) // 4 % 5 == 0]
    assert [round(x, 9) for x in given[0][0]] == [round(scorer.log_odds(t, known), 9) for _, t, _ in spare]
