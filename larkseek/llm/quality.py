"""Quality classification by co-training of a text view and a metadata view.

* The text-content view measures the text: word and line statistics, repetition, classes of bytes.
* The page-metadata view sees language, source and the stated length only.

Each view has its own logistic model. Round 0 learns from the labels. In each further round, a model
also learns from the documents without a label on which the *other* view was confident in the round
before, with the other view's decision as a pseudo-label. A view keeps what a round taught it only if
its loss on spare labels did not rise. Views are then calibrated on labelled
documents that no model learned from, and combined: their calibrated log-odds add up, less the prior
that both contain (the views are taken as independent given the class).

Features of all documents are written once. Every step of every fit is a sum over all of them
(gradients and second derivatives, added up by Spark), so labels, pseudo-labels and calibration
cover every row and only sums of fixed size reach the driver.

Defined cases: a null or empty text has zero counts; null metadata have a bucket of their own; a
document labelled twice takes its lower label; labels that are null or name no document are not
used; without labels of both classes every score is the share of label 1 (1 without labels, so
nothing is rejected); an empty table gives no rows.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkseek.llm.common import blocks, output_batch, scratch, slices, stored, text_bytes

ROUNDS = 3
#: A view lends a pseudo-label where its probability is this close to 0 or 1.
CONFIDENT = 0.97
PSEUDO_WEIGHT = 0.5
KEEP = 0.5
RIDGE = 1.0
STEPS, LATER_STEPS = 8, 4
LANG_BUCKETS, SOURCE_BUCKETS = 8, 24
SPACE = re.compile(rb"[\x20\x09-\x0d]")

_KINDS = np.zeros(256, np.int64)  # byte classes: 0 other, then as listed
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" ", b"\t\n\v\f\r", b"|", b"#$%&*@^~_=+<>{}[]\\/", b"!?", b".,;:'\"()-", range(128, 256)), 1):
    _KINDS[list(_bytes)] = _k
TEXT_FEATURES = 10 + 8


def line_counts(data: bytes) -> tuple[int, int]:
    """Lines and distinct lines (by 64-bit digests), line by line, so that no list of the lines of a
    very long text is made."""
    seen, at, view = set(), 0, memoryview(data)
    while (end := data.find(b"\n", at)) >= 0:
        seen.add(xxhash.xxh64_intdigest(view[at:end]))
        at = end + 1
    seen.add(xxhash.xxh64_intdigest(view[at:]))
    return data.count(b"\n") + 1, len(seen)


def text_view(text: str | None) -> np.ndarray:
    """Content statistics; each is bounded or a logarithm."""
    data = text_bytes(text)
    kinds = np.bincount(_KINDS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 11)[1:] if data else np.zeros(10)
    n, distinct, repeats, marks, length, parts = 0, 0.0, 0, 0, 0, 0
    previous = b""
    for block in blocks(data, SPACE):
        words = block.split()
        if not words:
            continue
        parts += 1
        n += len(words)
        distinct += len(set(words)) / math.sqrt(len(words))
        repeats += sum(map(operator.eq, words, words[1:])) + (words[0] == previous)
        marks += sum(map(_marked, words))
        length += sum(map(len, words))
        previous = words[-1]
    lines, distinct_lines = line_counts(data)
    share = np.sqrt(kinds / max(len(data), 1))
    return np.concatenate([share, [math.log1p(n), 1.0 / (1 + n), min(length / max(n, 1), 40) / 10, min(distinct / max(parts, 1), 30) / 10,
                                   math.sqrt(repeats / max(n, 1)), math.sqrt(marks / max(n, 1)), distinct_lines / lines, math.log1p(lines)]])


def _marked(word: bytes) -> bool:
    """Ends in a symbol that prose does not end words with."""
    return word[-1] in b"#$%&*@^~_=+<>{}[]\\/|!"


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANG_BUCKETS + SOURCE_BUCKETS + 4)
    out[0 if lang is None else 1 + zlib.crc32(lang.encode()) % (LANG_BUCKETS - 1)] = 1
    out[LANG_BUCKETS + (0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCE_BUCKETS - 1))] = 1
    size = math.log1p(max(n_chars, 0)) / 10 if n_chars is not None else 0.0
    out[-4:] = [n_chars is None, size, size ** 2, size ** 3]
    return out


VIEWS = {"text": TEXT_FEATURES + 1, "metadata": LANG_BUCKETS + SOURCE_BUCKETS + 5}


def _views(texts: list, langs: list, sources: list, sizes: list) -> dict[str, np.ndarray]:
    """Feature matrices with a constant column."""
    n = len(texts)
    return {"text": np.column_stack([np.array([text_view(t) for t in texts]).reshape(n, -1), np.ones(n)]),
            "metadata": np.column_stack([np.array([metadata_view(*m) for m in zip(langs, sources, sizes, strict=True)]).reshape(n, -1), np.ones(n)])}


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Models:
    """Weights of both views, their calibrations, and the share of good labels."""

    def __init__(self):
        self.weights = {v: np.zeros(d) for v, d in VIEWS.items()}
        self.calibration = {v: np.array([1.0, 0.0]) for v in VIEWS}
        self.prior, self.learned = 1.0, False

    def scores(self, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Calibrated probability of each view, and combined."""
        n = len(next(iter(x.values())))
        if not self.learned:
            return {k: np.full(n, self.prior) for k in ("text", "metadata", "score")}
        odds = {v: self.calibration[v][0] * (x[v] @ self.weights[v]) + self.calibration[v][1] for v in VIEWS}
        prior = math.log(self.prior / (1 - self.prior))
        return {**{v: _logistic(z) for v, z in odds.items()}, "score": _logistic(odds["text"] + odds["metadata"] - prior)}


def _columns(docs: DataFrame, text: str, lang: str, source: str, n_chars: str) -> list:
    """Text and metadata; a metadata column that the table lacks is null."""
    have = {c.lower(): c for c in docs.columns}
    return [F.col(text).cast("string").alias("text")] + [(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(t).alias(n)
                                                         for c, t, n in ((lang, "string", "lang"), (source, "string", "source"), (n_chars, "long", "n_chars"))]


def features(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
             n_chars: str = "n_chars", label: str = "quality") -> DataFrame:
    """(doc_id, text_view, metadata_view, label, spare) of every document, written to the shared
    folder; ``spare`` marks labels kept for calibration."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *_columns(docs, text, lang, source, n_chars))
    schema = pa.schema([("doc_id", pa.int64()), ("text_view", pa.list_(pa.float32())), ("metadata_view", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, *columns = (c.to_pylist() for c in part.columns)
                x = _views(*columns)
                yield output_batch(schema, [ids, x["text"].astype(np.float32).tolist(), x["metadata"].astype(np.float32).tolist()])

    rows = stored(slim.mapInArrow(run, "doc_id long, text_view array<float>, metadata_view array<float>"), scratch(spark, "quality-features"))
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label")))
    spare = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    return stored(rows.join(known, "doc_id", "left").withColumn("spare", spare), scratch(spark, "quality-rows"))


def _sums(rows: DataFrame, contribute) -> dict[str, np.ndarray]:
    """Add up ``contribute(x, label, spare)``, a dictionary of arrays, over all rows."""
    schema = pa.schema([("name", pa.string()), ("k", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            x = {v: batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, d).astype(np.float64) for k, (v, d) in enumerate(VIEWS.items())}
            label = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            for name, value in contribute(x, label, np.asarray(batch.column(3).to_pylist(), bool)).items():
                total[name] = total.get(name, 0) + value
        for name, value in total.items():
            flat = np.ravel(value)
            yield output_batch(schema, [[name] * len(flat), np.arange(len(flat), dtype=np.int32), flat.astype(np.float64)])

    out: dict[str, dict[int, float]] = {}
    slim = rows.select("text_view", "metadata_view", "label", F.coalesce("spare", F.lit(False)).alias("spare"))
    for r in slim.mapInArrow(run, "name string, k int, v double").groupBy("name", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["name"], {})[r["k"]] = r["v"]
    return {name: np.array([v[k] for k in range(len(v))]) for name, v in out.items()}


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, b: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Gradient and second derivatives of the weighted log-loss."""
    p = _logistic(x @ b)
    return {f"{name}-g": x.T @ (weight * (p - y)), f"{name}-h": (x * (weight * p * (1 - p))[:, None]).T @ x}


def _moved(b: np.ndarray, sums: dict[str, np.ndarray], name: str, ridge: float, centre: np.ndarray | float = 0.0) -> np.ndarray:
    d = len(b)
    return b - np.linalg.solve(sums[f"{name}-h"].reshape(d, d) + ridge * np.eye(d), sums[f"{name}-g"] + ridge * (b - centre))


def _accepted(rows: DataFrame, before: dict[str, np.ndarray], after: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each view, the weights after a round, or those before where the round raised the loss on
    spare labels. Without spare labels of both classes nothing proves a round, and none is taken."""
    def losses(x, label, spare):
        at = spare & (label >= 0)
        out = {"n": np.array([(at & (label == c)).sum() for c in (0, 1)])}
        for v in VIEWS:
            for when, w in (("before", before[v]), ("after", after[v])):
                p = np.clip(_logistic(x[v][at] @ w), 1e-6, 1 - 1e-6)
                out[f"{v}-{when}"] = -np.log(np.where(label[at] == 1, p, 1 - p)).sum()
        return out

    sums = _sums(rows, losses)
    return {v: after[v] if sums["n"].all() and sums[f"{v}-after"] <= sums[f"{v}-before"] else before[v] for v in VIEWS}


def co_train(rows: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Models:
    """Fit both views on the output of :func:`features`."""
    m, other = Models(), {"text": "metadata", "metadata": "text"}
    counts = _sums(rows, lambda x, label, spare: {"n": np.array([((label == c) & (spare == s)).sum() for c in (0, 1) for s in (False, True)])}).get("n", np.zeros(4))
    bad, good = counts[:2].sum(), counts[2:].sum()
    m.prior = good / (bad + good) if bad + good else 1.0
    if not counts[0] or not counts[2]:
        return m
    m.learned = True
    lent: dict[str, np.ndarray] | None = None  # weights of the round before
    for r in range(rounds + 1):
        for _ in range(LATER_STEPS if r else STEPS):
            weights = m.weights

            def contribute(x, label, spare, weights=weights, lent=lent):
                out = {}
                for v in VIEWS:
                    y, w = label.astype(np.float64), ((label >= 0) & ~spare).astype(np.float64)
                    if lent is not None:
                        p = _logistic(x[other[v]] @ lent[other[v]])
                        taken = (label < 0) & (np.abs(p - 0.5) >= confident - 0.5)
                        y, w = np.where(taken, p > 0.5, y), np.where(taken, PSEUDO_WEIGHT, w)
                    out |= _newton(x[v], y, w, weights[v], v)
                return out

            sums = _sums(rows, contribute)
            m.weights = {v: _moved(weights[v], sums, v, RIDGE) for v in VIEWS}
        if lent is not None:
            m.weights = _accepted(rows, lent, m.weights)
        lent = dict(m.weights)
    # calibrate on labels that no model saw, or on all where one class has none spare
    every = not counts[1] or not counts[3]
    for _ in range(STEPS):
        weights, calibration = m.weights, m.calibration

        def calibrate(x, label, spare, weights=weights, calibration=calibration):
            w = ((label >= 0) & (spare | every)).astype(np.float64)
            out = {}
            for v in VIEWS:
                z = x[v] @ weights[v]
                out |= _newton(np.column_stack([z, np.ones(len(z))]), label.astype(np.float64), w, calibration[v], v)
            return out

        sums = _sums(rows, calibrate)
        m.calibration = {v: _moved(calibration[v], sums, v, 0.1, np.array([1.0, 0.0])) for v in VIEWS}
    return m


def score_documents(rows: DataFrame, models: Models, keep: float = KEEP) -> DataFrame:
    """doc_id, text_score, metadata_score, score, keep for every row of :func:`features`."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_score", pa.float64()), ("metadata_score", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            s = models.scores({v: batch.column(k + 1).flatten().to_numpy(zero_copy_only=False).reshape(n, d).astype(np.float64) for k, (v, d) in enumerate(VIEWS.items())})
            yield output_batch(schema, [batch.column(0), *(np.round(s[k], 6) for k in ("text", "metadata", "score")), s["score"] >= keep])

    return rows.select("doc_id", "text_view", "metadata_view").mapInArrow(run, "doc_id long, text_score double, metadata_score double, score double, keep boolean")


def remove_low_quality(docs: DataFrame, models: Models, text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars",
                       keep: float = KEEP) -> DataFrame:
    """``docs`` without the rows that score below ``keep``; all columns as they are."""
    have = {c.lower(): k for k, c in enumerate(docs.columns)}
    at, others = docs.columns.index(text), [have.get(c.lower()) for c in (lang, source, n_chars)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                metadata = [[None] * part.num_rows if k is None else part.column(k).to_pylist() for k in others]
                if part.num_rows:
                    s = models.scores(_views(part.column(at).to_pylist(), *metadata))["score"]
                    yield part.filter(pa.array(s >= keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
