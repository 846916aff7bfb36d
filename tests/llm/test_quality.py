import random

import numpy as np
from llm_cases import clashing, empty, odd_docs, odd_rows

from larkseek.llm import quality


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 120))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w + "###" for w in words] if kind == 0 else [words[0]] * len(words) if kind == 1 else [w for x in words for w in (x, "|")]
        # the source tells the classes apart most of the time
        source = f"good{rng.randrange(3)}" if good == (rng.random() < 0.9) else f"bad{rng.randrange(3)}"
        text = " ".join(words).capitalize() + "."
        out.append((k, text, "en", source, len(text), int(good)))
    return out


def frames(spark, data, labelled):
    docs = spark.createDataFrame([r[:5] for r in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs, spark.createDataFrame([(r[0], r[5]) for r in data if labelled(r[0])], "doc_id long, quality int")


def test_unlabelled_documents_are_told_apart(spark):
    data = corpus(1, 700)
    docs, labels = frames(spark, data, lambda i: i % 4 == 0)
    rows = quality.features(docs, labels)
    models = quality.co_train(rows)
    got = {r["doc_id"]: r for r in quality.score_documents(rows, models).collect()}
    other = [r for r in data if r[0] % 4]
    assert sum(got[r[0]]["keep"] == bool(r[5]) for r in other) >= 0.97 * len(other)
    # the metadata view alone is right most of the time
    assert sum((got[r[0]]["metadata_score"] >= 0.5) == bool(r[5]) for r in other) >= 0.8 * len(other)
    left = quality.remove_low_quality(docs, models)
    assert left.dtypes == docs.dtypes and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, r in got.items() if r["keep"])


def test_views_exchange_pseudo_labels(spark):
    """With few labels, rounds of co-training change what the metadata view knows."""
    data = corpus(2, 600)
    docs, labels = frames(spark, data, lambda i: i < 150)
    rows = quality.features(docs, labels)
    alone, taught = quality.co_train(rows, rounds=0, confident=0.85), quality.co_train(rows, rounds=2, confident=0.85)
    k = quality.LANG_BUCKETS
    assert np.abs(alone.weights["metadata"][k:] - taught.weights["metadata"][k:]).max() > 0.1
    x = quality._views([r[1] for r in data], *([r[c] for r in data] for c in (2, 3, 4)))
    truth = np.array([r[5] for r in data])

    def loss(m):
        p = np.clip(quality._logistic(x["metadata"] @ m.weights["metadata"]), 1e-6, 1 - 1e-6)
        return -np.log(np.where(truth == 1, p, 1 - p)).mean()
    assert loss(taught) < loss(alone) + 0.02


def test_sums_equal_a_plain_fit(spark):
    """The distributed Newton steps reach the optimum of the ridge-penalised loss."""
    data = corpus(3, 200)
    docs, labels = frames(spark, data, lambda i: True)
    rows = quality.features(docs, labels)
    m = quality.co_train(rows, rounds=0)
    r = rows.collect()
    x = np.array([row["text_view"] for row in r], np.float64)
    y, w = np.array([row["label"] for row in r]), np.array([not row["spare"] for row in r], np.float64)
    gradient = x.T @ (w * (quality._logistic(x @ m.weights["text"]) - y)) + quality.RIDGE * m.weights["text"]
    assert np.abs(gradient).max() < 1e-3


def test_odd_rows(spark):
    data = corpus(4, 150)
    models = quality.co_train(quality.features(*frames(spark, data, lambda i: True)))
    docs = clashing(odd_docs(spark))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    rows = quality.features(docs, labels)
    got = quality.score_documents(rows, models).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in odd_rows())
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["label"] for r in rows.where("doc_id = 1").collect()} == {0}
    left = quality.remove_low_quality(docs, models)
    assert left.dtypes == docs.dtypes and left.count() == sum(r["keep"] for r in got)
    # one class only: everything stays
    assert quality.co_train(rows).learned is False
    none = quality.features(empty(spark), labels)
    assert quality.score_documents(none, quality.co_train(none)).collect() == []


def test_missing_metadata_columns(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    rows = quality.features(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_documents(rows, quality.co_train(rows)).collect()} == {1.0}


def test_lines_of_texts_of_any_length():
    """Distinct share and number of lines, also beyond 16 MiB."""
    for text in (None, "", "\n", "a", "a\n", "a\nb\na", "\n\nÖl\n\n", "one line of text\n" * 3 + "another", "x" * 50 + "\n" + "some words here\nmore of them\n" * 700_000):
        lines = (text or "").encode().split(b"\n")
        assert quality.line_counts((text or "").encode()) == (len(lines), len(set(lines)))
        assert np.allclose(quality.text_view(text)[-2:], [len(set(lines)) / len(lines), np.log1p(len(lines))])
