"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its own token and its character n-grams (3 to 5, with word edges), each a row of a hashed
embedding table. The embeddings of a window of words are averaged, and a linear layer with softmax
tells the two classes apart; table and layer are trained together by gradient steps. A misspelling
that was never seen shares n-gram vectors with the word it stands for.

A document's score is the calibrated softmax of its most toxic window, over short windows that cover
the whole text, so one toxic word is found in a text of any length. Training follows that: after a
warm-up on all windows, a toxic document teaches by its ``TOXIC_WINDOWS`` most toxic windows (the
others may be harmless) and a clean one by its ``CLEAN_WINDOWS`` most toxic. The average is linear,
so after training every subword is one number, and a word the sum of its own. Words that repeat the
word before them are skipped.

The model is fitted on a bounded sample of rows: at most ``docs_per_class`` labelled documents of
each class, with every window of their whole texts. In the warm-up a document counts as at most
``windows_per_doc`` windows: those of a longer one weigh less. Windows come to the driver in chunks,
and the most toxic ones are chosen in tasks if there are more than one chunk of them. A fifth of the
documents calibrates, by the maximum over the whole text as in scoring.
Rows with crc32(id as text) % 4 = 2 are held out. Only the text is an input.

Defined cases: null and empty texts score as a window of no words, the prior of the softmax; with
labels of one class, or none, every score is the share of label 1 (0 without labels); null labels
and ids are not learned from; a document labelled twice takes its larger label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkseek.llm.common import blocks, output_batch, scratch, slices, stored, text_bytes

DOCS_PER_CLASS = 2_500
WINDOWS_PER_DOC = 32
#: Training windows in the memory of the driver.
CHUNK = 200_000
WINDOW, STRIDE = 8, 4
BUCKET_BITS, DIMENSIONS = 18, 8
BUCKETS = 1 << BUCKET_BITS
GRAMS = (3, 4, 5)
STEP, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
STEPS, BATCH, RATE = 800, 256, 0.3
TOXIC_WINDOWS, CLEAN_WINDOWS, PASSES = 2, 4, 2
#: A subword of fewer sampled documents is not learned.
SUBWORD_DOCS = 4
THRESHOLD = 0.3
CACHED_WORDS = 200_000
SPACE = re.compile(rb"[\x20\x09-\x0d]")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SCORE = "doc_id long, held_out boolean, score double, predicted int"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, word numbers) of all subwords of ``words``: each word and its n-grams, with outer
    punctuation removed. Polynomial hashes of code points, all words at once."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    framed = [f"<{w.strip(EDGE) or w}>" for w in words]
    length = np.array([len(w) for w in framed], np.int64)
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(codes)) - start[owner]
    left = length[owner] - at
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()) - 1, STEP, np.uint64)), dtype=np.uint64)
    hashes, owners, gram = [np.add.reduceat(codes * power[at], start)], [np.arange(len(words))], codes
    for n in range(2, GRAMS[-1] + 1):
        gram = gram[:-1] * STEP + codes[n - 1:]
        if n in GRAMS:
            inside = left[:len(gram)] >= n
            hashes.append(gram[inside] + np.uint64(n))
            owners.append(owner[:len(gram)][inside])
    h = np.concatenate(hashes) * MIX
    return (((h ^ (h >> np.uint64(29))) * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.concatenate(owners)


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lower-case words, without those that repeat the word before them."""
    last = ""
    for b in blocks(text_bytes(text), SPACE):
        words = b.decode("utf-8", "surrogatepass").lower().split()
        if words:
            yield [w for w, before in zip(words, [last, *words], strict=False) if w != before]
            last = words[-1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Softmax:
    """Embedding table and linear layer, trained by Adagrad on windows."""

    def __init__(self, learned: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.learned = learned.astype(np.float32)[:, None]
        self.table = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.01).astype(np.float32) * self.learned
        self.layer = rng.standard_normal((DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = [np.full(BUCKETS, 1e-6, np.float32), np.full((DIMENSIONS, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)]
        self.rng = rng

    def step(self, ids: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        n, of = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
        mean = np.add.reduceat(self.table[ids], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        z = mean @ self.layer + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), toxic] -= 1
        p *= weight[:, None] / n
        back = (p @ self.layer.T) / lengths[:, None]
        rows, which = np.unique(ids, return_inverse=True)
        grad = np.stack([np.bincount(which, back[of, d], len(rows)) for d in range(DIMENSIONS)], axis=1)
        self.seen[0][rows] += (grad ** 2).mean(axis=1)
        self.table[rows] -= RATE * grad / np.sqrt(self.seen[0][rows])[:, None] * self.learned[rows]
        for value, g, k in ((self.layer, mean.T @ p, 1), (self.bias, p.sum(axis=0), 2)):
            self.seen[k] += g ** 2
            value -= 0.3 * RATE * g / np.sqrt(self.seen[k])

    def one_pass(self, windows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, chosen: np.ndarray | None = None) -> int:
        """Number of steps made."""
        order = self.rng.permutation(np.arange(len(windows)) if chosen is None else chosen)
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            self.step(np.concatenate([windows[i] for i in some]), np.array([len(windows[i]) for i in some]), toxic[some], weight[some])
        return -(-len(order) // BATCH)

    def odds(self, windows: list[np.ndarray]) -> np.ndarray:
        weights, prior = self.weights()
        return np.array([prior + weights[w].mean() for w in windows])

    def teach(self, windows: list[np.ndarray], toxic: np.ndarray, doc: np.ndarray, done: int) -> None:
        """The steps that are left, on the most toxic of these windows of each document."""
        weight = np.ones(len(windows))
        while done < STEPS:
            top = pd.DataFrame({"doc": doc, "toxic": toxic, "odds": self.odds(windows)}).sort_values("odds", ascending=False, kind="stable")
            chosen = top.index[top.groupby("doc").cumcount() < np.where(top["toxic"] == 1, TOXIC_WINDOWS, CLEAN_WINDOWS)].to_numpy()
            for _ in range(PASSES):
                done += self.one_pass(windows, toxic, weight, chosen)

    def weights(self) -> tuple[np.ndarray, float]:
        """(log-odds of each subword, log-odds of no words)."""
        return self.table @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


class _Words(dict):
    """Word to (sum of its subwords' log-odds, number of subwords); forgets all when full."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def learn(self, words: Iterable[str]) -> None:
        """Add the words that are not known yet, all at once."""
        new = list({w for w in words if w not in self})
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(set(words))
        ids, owner = subwords(new)
        self.update(zip(new, zip(np.bincount(owner, self.weights[ids], len(new)).tolist(), np.bincount(owner, minlength=len(new)).tolist(), strict=True), strict=True))


class Scorer:
    """What a task needs: subword log-odds, prior, and calibration. A constant if nothing was learned."""

    def __init__(self, weights: np.ndarray | None, prior: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.prior, self.scale, self.shift = weights, prior, scale, shift

    def words(self) -> _Words:
        return _Words(self.weights)

    def log_odds(self, text: str | None, known: _Words) -> float:
        """Of the most toxic window. Windows of WINDOW words begin every STRIDE words."""
        parts = []
        for words in words_of(text):
            known.learn(words)
            parts.append(np.array([known[w] for w in words], np.float64).reshape(-1, 2))
        values = np.concatenate(parts) if parts else np.zeros((0, 2))
        if not len(values):
            return self.prior
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(values, axis=0)])
        begin = np.arange(0, max(len(values) - WINDOW + STRIDE, 1), STRIDE)
        window = total[np.minimum(begin + WINDOW, len(values))] - total[begin]
        return self.prior + float((window[:, 0] / window[:, 1]).max())

    def score(self, text: str | None, known: _Words | None) -> float:
        if self.weights is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.log_odds(text, known) + self.shift, -30, 30))))


def _sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, docs_per_class: int) -> tuple[DataFrame, list[int]]:
    """(doc_id, text, toxic) of the bounded sample, and the number of learnable labels by class."""
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    numbers = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        some = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.join(F.broadcast(chosen), "doc_id"), [numbers.get(0, 0), numbers.get(1, 0)]


def _all_words(text: str | None) -> list[str]:
    return [w for some in words_of(text) for w in some]


def _worded(sample: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, spare) of the documents that have words; ``spare`` ones calibrate."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32()), ("spare", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(d, t, y, zlib.crc32(str(d).encode()) // 4 % 5 == 0) for d, t, y in zip(*(c.to_pylist() for c in part.columns), strict=True) if any(words_of(t))]
                yield output_batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4)

    return stored(sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic int, spare boolean"), scratch(sample.sparkSession, "toxicity-sample"))


def _learnable(learned: DataFrame) -> np.ndarray:
    """Marks the subwords that at least SUBWORD_DOCS documents have."""
    schema = pa.schema([("subword", pa.int32()), ("docs", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    total[np.unique(subwords(sorted(set(_all_words(text))))[0])] += 1
        held = np.flatnonzero(total)
        yield output_batch(schema, [held.astype(np.int32), total[held]])

    out = np.zeros(BUCKETS, bool)
    counts = learned.select("text").mapInArrow(run, "subword int, docs int").groupBy("subword").agg(F.sum("docs").alias("docs"))
    out[counts.where(F.col("docs") >= SUBWORD_DOCS).select("subword").toPandas()["subword"].to_numpy(np.int64)] = True
    return out


def _windows(learned: DataFrame) -> DataFrame:
    """(doc_id, toxic, k, n, words): all n windows of each document, side by side over its text."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("k", pa.int64()), ("n", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 16):
                rows = []
                for doc, text, toxic in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = _all_words(text)
                    n = -(-len(words) // WINDOW)
                    rows += [(doc, toxic, k, n, " ".join(words[k * WINDOW:(k + 1) * WINDOW])) for k in range(n)]
                yield output_batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5)

    return learned.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, k long, n long, words string")


def _most_toxic(learned: DataFrame, model: Softmax) -> pd.DataFrame:
    """(doc_id, toxic, words) of the windows that teach, chosen among all of each document."""
    shared = learned.sparkSession.sparkContext.broadcast(model.weights()[0].astype(np.float64))
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(shared.value)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text, toxic in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    values, words = [], []
                    for some in words_of(text):
                        known.learn(some)
                        values += [known[w] for w in some]
                        words += some
                    total = np.add.reduceat(np.array(values, np.float64), np.arange(0, len(values), WINDOW), axis=0)
                    for k in np.argsort(-total[:, 0] / total[:, 1], kind="stable")[:TOXIC_WINDOWS if toxic else CLEAN_WINDOWS].tolist():
                        rows.append((doc, toxic, " ".join(words[k * WINDOW:(k + 1) * WINDOW])))
                yield output_batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 3)

    out = learned.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, words string").toPandas()
    return out.sort_values(["doc_id", "words"], kind="stable").reset_index(drop=True)


def _chunks(windows: DataFrame, windows_per_doc: int) -> Iterator[tuple]:
    """(subwords, toxic, document, weight) of at most CHUNK windows at a time, in a mixed order that
    is the same in every run."""
    mixed = windows.orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "words").toLocalIterator()
    while some := list(islice(mixed, CHUNK)):
        yield ([subwords(r["words"].split())[0] for r in some], np.array([r["toxic"] for r in some]), np.array([r["doc_id"] for r in some]),
               np.array([min(1.0, windows_per_doc / r["n"]) for r in some]))


def _train(learned: DataFrame, windows_per_doc: int) -> Softmax:
    model, done = Softmax(_learnable(learned)), 0
    windows = stored(_windows(learned), scratch(learned.sparkSession, "toxicity-windows"))
    if windows.count() <= CHUNK:
        own, toxic, doc, weight = next(_chunks(windows, windows_per_doc))
        while done < STEPS // 2:
            done += model.one_pass(own, toxic, weight)
        model.teach(own, toxic, doc, done)
        return model
    while done < STEPS // 2:
        for own, toxic, _, weight in _chunks(windows, windows_per_doc):
            done += model.one_pass(own, toxic, weight)
    done = STEPS // 2
    while done < STEPS:
        top = _most_toxic(learned, model)
        own = [subwords(w.split())[0] for w in top["words"]]
        for _ in range(PASSES):
            done += model.one_pass(own, top["toxic"].to_numpy(), np.ones(len(own)))
    return model


def _whole_odds(sample: DataFrame, scorer: Scorer) -> pd.DataFrame:
    """(doc_id, toxic, odds): what scoring sees of each document."""
    shared = sample.sparkSession.sparkContext.broadcast(scorer)
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("odds", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.words()
        for batch in batches:
            for part in slices(batch):
                yield output_batch(schema, [part.column(0), part.column(2), [shared.value.log_odds(t, known) for t in part.column(1).to_pylist()]])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, odds double").toPandas()


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Scale and shift of a logistic fit, by Newton steps with a small ridge."""
    a, b = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        b = b - np.linalg.solve(h, a.T @ (weight * (p - y)) + 1e-2 * (b - np.array([1.0, 0.0])))
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        docs_per_class: int = DOCS_PER_CLASS, windows_per_doc: int = WINDOWS_PER_DOC) -> Scorer:
    """Learn from the sample; at most CHUNK short windows are on the driver at a time."""
    sample, numbers = _sampled(docs, labels, doc_id, text, label, docs_per_class)
    sample = _worded(sample)
    have = {(r["toxic"], r["spare"]) for r in sample.select("toxic", "spare").distinct().collect()}
    if len({toxic for toxic, _ in have}) < 2:
        return Scorer(None, numbers[1] / max(sum(numbers), 1))
    model = _train(sample.where("not spare") if {(0, False), (1, False)} <= have else sample, windows_per_doc)
    weights, prior = model.weights()
    rows = _whole_odds(sample.where("spare") if {(0, True), (1, True)} <= have else sample, Scorer(weights.astype(np.float64), prior))
    best = rows.groupby("doc_id").agg(odds=("odds", "max"), toxic=("toxic", "max"))
    # the sample is balanced, the labels are not
    sampled = [min(n, docs_per_class) for n in numbers]
    weight = np.array([numbers[t] / sampled[t] for t in best["toxic"]])
    scale, shift = _calibrated(best["odds"].to_numpy(), best["toxic"].to_numpy(), weight / weight.mean())
    return Scorer(weights.astype(np.float64), prior, max(scale, 1e-3), shift)


def score_documents(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        known = s.words() if s.weights is not None else None
        for batch in batches:
            for part in slices(batch):
                p = [s.score(t, known) for t in part.column(2).to_pylist()]
                yield output_batch(schema, [part.column(0), part.column(1), p, [int(x >= threshold) for x in p]])

    return slim.mapInArrow(run, SCORE)


def remove_toxic(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        known = s.words() if s.weights is not None else None
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([s.score(t, known) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
