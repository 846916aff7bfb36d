"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the digest of its model
file, library version and options. Counts of known (content, tokenizer) pairs come from the stored
cache; only distinct unknown contents are encoded, one text each, and their counts are appended.

The normalisation must not change the count. Null becomes the empty text; anything else is left to
the tokenizer's own normaliser.

Copies meet in a partial aggregate of the map tasks first, so a text that a third of the rows share
is shuffled once per task. Counts return to the documents by a join on the digest with one row per
digest on the other side, where adaptive execution may split a hot digest.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows stay repeated; an empty
table gives no rows. A cache that two jobs filled with the same content at once is read as one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkseek.llm.common import output_batch, read_if_present, scratch, slices, stored

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])
BATCH_CHARS = 1 << 20


def model_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Digest of everything that can change a count: model file, library version, options."""
    import sentencepiece
    with open(path, "rb") as f:
        h = hashlib.file_digest(f, "sha256")
    h.update(f"sentencepiece {sentencepiece.__version__} bos=0 eos=0".encode())
    return h.hexdigest()


def _encoder(path: str):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Lists of texts of bounded total length; a longer text stands alone."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > BATCH_CHARS:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def encode_counts(contents: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """(content, text) to cache rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        schema = pa.schema([("content", pa.binary()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])
        for batch in batches:
            for part in slices(batch):
                n = [k for g in _groups(part.column(1).to_pylist()) for k in count(g)]
                yield output_batch(schema, [part.column(0), [tokenizer] * len(n), n])
    return contents.mapInArrow(run, CACHE)


def count_tokens(docs: DataFrame, cache: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    ``cache`` is the folder of the stored counts; it is made when first used. ``path`` names the
    model file, readable at the same place on every executor.
    """
    spark, path = docs.sparkSession, path or model_path(MODEL)
    tokenizer = tokenizer_digest(path)
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = whole.withColumn("content", F.unhex(F.sha2("text", 256)))
    known = read_if_present(spark, cache, CACHE).where(F.col("tokenizer") == tokenizer)
    misses = keyed
    if known.limit(1).count():
        # slim keys first: texts of known contents are not shuffled when few are unknown
        unknown = stored(keyed.select("content").distinct().join(known, "content", "left_anti"), scratch(spark, "unknown-contents"))
        misses = keyed.join(unknown, "content", "left_semi")
    distinct = misses.select("content", "text").dropDuplicates(["content"])
    encode_counts(distinct, path, tokenizer).write.mode("append").parquet(cache)
    counts = stored(read_if_present(spark, cache, CACHE).where(F.col("tokenizer") == tokenizer)
                    .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), scratch(spark, "token-counts"))
    slim = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return (slim.join(counts, "content", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
