"""Cross-entropy difference: how much better a target model than a background model predicts a text.

Two bigram models with one vocabulary, one order and one smoothing: the target model counts the
target documents, the background model counts all documents. A document's score is the mean over its
tokens of loss under the target minus loss under the background (nats); lower is more target-like.

    p1(w)   = (c(w) + 1) / (N + size of the vocabulary)
    p(w|h)  = (c(h, w) + MU * p1(w)) / (c(h) + MU)

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII, of any length. The
vocabulary is every word of all documents and a boundary that opens and ends each document; it
follows the corpus and is nowhere held whole. A word is known by a 64-bit digest, a bigram by a
64-bit mix of two; different words of one digest would count as one (about n * n / 2**65 pairs).

1. One scan turns the documents into blocks of about BLOCK_TOKENS tokens: a list of the block's
   words and the documents as numbers of that list.
2. A block asks for each of its distinct words, then bigrams, once, with its counts, in the bucket of
   their digest. The bucket sums both models' counts and answers each block in the order asked. What
   one bigram sends to its bucket is at most one pair of counts per block, whatever documents hold it.
3. A block meets its answers, computes the loss of each distinct bigram and sums it per document.

Rows (block, bucket) are never empty, so there are at most as many as distinct bigrams of blocks.
Losses are rounded to millionths of a nat per distinct bigram, so sums do not depend on order.

Defined cases: null and empty texts have one token, the boundary; a target without documents leaves
the smoothed uniform target model; repeated rows count and are scored as often as they occur, null
ids among them; a document of more than BLOCK_TOKENS tokens is a block of its own; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkseek.llm.common import ASCII_LOWER, blocks, output_batch, scratch, shuffle_partitions, slices, stored, text_bytes

MU = 4.0
MICRO = 1_000_000
#: Words or bigrams of blocks per bucket on average, tokens and documents per block.
BUCKET_ENTRIES, BLOCK_TOKENS, BLOCK_DOCS = 300_000, 600_000, 60_000
#: Target ids up to this number are broadcast to mark documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
HISTORY, NEXT, MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0x9E3779B97F4A7C15)
#: The digest of no word.
BOUNDARY = xxhash.xxh64_intdigest(b"")
ASKED = [np.uint64, np.uint32, np.uint32]  # digest (as a step from the one before), count in target documents, count in all
ANSWER = [np.int64, np.int64]  # the models' counts
BLOCK = "block long, words binary, tokens binary, doc_ids array<long>, n_tokens array<long>, targets array<boolean>"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
                          ("n_tokens", pa.list_(pa.int64())), ("targets", pa.list_(pa.bool_()))])
BUCKET = "block long, bucket long, data binary"
BUCKET_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])


def _words(text: str | None) -> Iterator[list[bytes]]:
    for b in blocks(text_bytes(text).translate(ASCII_LOWER), GAP):
        yield WORD.findall(b)


def marked(docs: DataFrame, target_ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, target): documents whose id is among ``target_ids`` (column doc_id)."""
    ids = target_ids.where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")))


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows per Arrow batch while the table jobs inside run: texts are long, and each batch
    stands in the memory of the executor and of the Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length as compressed byte planes."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes, types: list[type]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 0, []
    planes = pa.decompress(data[8:], n * sum(np.dtype(t).itemsize for t in types), "zstd")
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


def _bucket_order(digests: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bucket of each place): digests in ascending order, cut into equal ranges."""
    order = np.argsort(digests, kind="stable")
    return order, (((digests[order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins; at least one value."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


class _Block:
    """Tokens of whole documents; words are numbered from 1 as they come, 0 is the boundary."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.lengths, self.targets, self.sequences, self.size = [], [], [], [], 0

    def add(self, doc: int | None, target: bool, text: str | None) -> None:
        get, numbers = self.numbers.setdefault, self.numbers
        own = [np.fromiter((get(w, len(numbers) + 1) for w in words), np.uint32, len(words)) for words in _words(text)]
        self.sequences += [*own, np.zeros(1, np.uint32)]
        self.ids.append(doc)
        self.targets.append(target)
        self.lengths.append(sum(map(len, own)) + 1)
        self.size += self.lengths[-1]

    def row(self, name: int) -> pa.RecordBatch:
        words = b"\n".join([b"", *self.numbers])
        return output_batch(BLOCK_SCHEMA, [[name], [len(words).to_bytes(8, "little") + pa.compress(words, "zstd", asbytes=True)],
                                           [_packed([np.concatenate(self.sequences)])], [self.ids], [self.lengths], [self.targets]])


def _blocks(docs: DataFrame) -> DataFrame:
    block_tokens, block_docs = BLOCK_TOKENS, BLOCK_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            for part in slices(batch):
                for doc, text, target in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    # a text has at most one word per two characters; only near the end it is counted
                    full = block.size + len(text or "") // 2 + 2 > block_tokens and block.size + sum(map(len, _words(text))) + 1 > block_tokens
                    if block.ids and (full or len(block.ids) >= block_docs):
                        yield block.row(name)
                        name, block = name + 1, _Block()
                    block.add(doc, target, text)
        if block.ids:
            yield block.row(name)

    return docs.mapInArrow(run, BLOCK)


def _opened(words: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests by word number, history of each token, tokens) of a block."""
    names = pa.decompress(words[8:], int.from_bytes(words[:8], "little"), "zstd", asbytes=True).split(b"\n")
    digests = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    sequence, = _unpacked(tokens, [np.uint32])
    return digests, np.concatenate([np.zeros(1, np.uint32), sequence[:-1]]), sequence


def _bigrams(digests: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mixed so that the digests of bigrams lie evenly in all ranges."""
    mixed = digests[h] * HISTORY + digests[w] * NEXT
    return (mixed ^ (mixed >> np.uint64(29))) * MIX


def _asked_words(digests: np.ndarray, h: np.ndarray, w: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return digests, np.bincount(w[target], minlength=len(digests)), np.bincount(w, minlength=len(digests))


def _asked_bigrams(digests: np.ndarray, h: np.ndarray, w: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = h.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64) << np.uint64(1) | target
    key.sort()
    starts = _starts(key >> np.uint64(1))
    in_target = np.add.reduceat(key & np.uint64(1), starts)
    count, key = np.diff(np.append(starts, len(key))), key[starts]
    return _bigrams(digests, key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)) >> np.uint64(1)), in_target, count


def _asks(rows: DataFrame, asked, buckets: int) -> DataFrame:
    """Rows (block, bucket, data) of what the blocks ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, tokens, lengths, targets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, *counts = asked(*_opened(words, tokens), np.repeat(np.array(targets), lengths))
                order, bucket = _bucket_order(digest, buckets)
                cuts = np.append(_starts(bucket), len(bucket))
                data = []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    who = order[a:b]
                    data.append(_packed([np.diff(digest[who], prepend=np.uint64(0)), *(c[who].astype(np.uint32) for c in counts)]))
                yield output_batch(BUCKET_SCHEMA, [[block] * len(data), bucket[cuts[:-1]], data])

    return rows.select("block", "words", "tokens", "n_tokens", "targets").mapInArrow(run, BUCKET)


def _in_bucket(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of a bucket's digests, given back to each block in the order it asked; a row without
    block holds the bucket's totals: distinct digests, tokens of target documents and of all."""
    parts = [_unpacked(d, ASKED) for d in group["data"]]
    digest = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    target, every = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    distinct, which = np.unique(digest, return_inverse=True)
    target, every = (np.bincount(which, c).astype(np.int64) for c in (target, every))
    cuts = np.cumsum([len(p[0]) for p in parts])
    data = [_packed([target[some], every[some]]) for some in np.split(which, cuts[:-1])]
    totals = _packed([np.array([len(distinct), target.sum(), every.sum()], np.int64)])
    bucket = group["bucket"].iloc[0]
    return pd.DataFrame({"block": pd.array([*group["block"], None], "Int64"), "bucket": bucket, "data": [*data, totals]})


def score(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_difference (millionths of a nat, summed) and score (nats per token) of
    every row of ``docs``. ``target_ids`` (column doc_id) names the target documents."""
    spark = docs.sparkSession
    known = marked(docs, target_ids, doc_id, text)
    letters = docs.select(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(spark), math.ceil(letters / 6 / BUCKET_ENTRIES))
    word_buckets = max(shuffle_partitions(spark), math.ceil(buckets / 4))
    with short_batches(spark):
        rows = stored(_blocks(known), scratch(spark, "token-blocks"))
    with short_batches(spark, 4):
        words = stored(_asks(rows, _asked_words, word_buckets).groupBy("bucket").applyInPandas(_in_bucket, BUCKET), scratch(spark, "word-sums"))
        pairs = stored(_asks(rows, _asked_bigrams, buckets).groupBy("bucket").applyInPandas(_in_bucket, BUCKET), scratch(spark, "bigram-sums"))
    size, target_tokens, tokens = 0, 0, 0
    for r in words.where("block is null").select("data").toLocalIterator():
        own = _unpacked(bytes(r["data"]), [np.int64])[0].tolist()
        size, target_tokens, tokens = size + own[0], target_tokens + own[1], tokens + own[2]

    def in_block(answers: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("bucket")
        digests, h, w = _opened(own["words"].iloc[0], own["tokens"].iloc[0])
        key, which = np.unique(h.astype(np.uint64) << np.uint64(32) | w, return_inverse=True)
        h, w = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)

        def counts(some: pd.Series, asked: np.ndarray, n: int) -> list[np.ndarray]:
            order, _ = _bucket_order(asked, n)
            out = []
            for column in zip(*(_unpacked(d, ANSWER) for d in some), strict=True):
                out.append(np.empty(len(asked), np.float64))
                out[-1][order] = np.concatenate(column)
            return out

        single = counts(answers["data"][~answers["pair"]], digests, word_buckets)
        pair = counts(answers["data"][answers["pair"]], _bigrams(digests, h, w), buckets)
        logs = [np.log((c + MU * ((s[w] + 1) / (total + size))) / (s[h] + MU)) for c, s, total in zip(pair, single, (target_tokens, tokens), strict=True)]
        loss = np.rint((logs[1] - logs[0]) * MICRO).astype(np.int64)[which]
        n_tokens = np.asarray(own["n_tokens"].iloc[0], np.int64)
        total = np.add.reduceat(loss, np.cumsum(n_tokens) - n_tokens)
        return pd.DataFrame({"doc_id": pd.array(list(own["doc_ids"].iloc[0]), "Int64"), "n_tokens": n_tokens, "loss_difference": total, "score": total / (MICRO * n_tokens)})

    answers = (words.withColumn("pair", F.lit(False)).unionByName(pairs.withColumn("pair", F.lit(True)))).where("block is not null")
    return (answers.groupBy("block").cogroup(rows.drop("targets").groupBy("block"))
            .applyInPandas(in_block, "doc_id long, n_tokens long, loss_difference long, score double"))
