import uuid

import public_tokenizers
import pytest
import sentencepiece
from llm_cases import clashing, empty, odd_docs, odd_rows, rows

from larkseek.llm import token_counts
from larkseek.llm.common import scratch, table


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def want(docs, model):
    out = []
    for i, t in docs:
        n = len(model.encode(t or ""))
        out.append((i, len((t or "").encode()), n, n > 4096))
    return sorted(out, key=repr)


def test_odd_rows(spark, model):
    got = rows(token_counts.count_tokens(clashing(odd_docs(spark)), scratch(spark, "cache")))
    assert got == want([r[:2] for r in odd_rows()], model)
    assert token_counts.count_tokens(empty(spark), scratch(spark, "cache")).collect() == []


def test_cache_grows_by_distinct_misses_only(spark, sf, model):
    docs, cache = table(spark, sf, "documents"), scratch(spark, "cache")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    some = docs.where("doc_id % 2 = 0")
    assert rows(token_counts.count_tokens(some, cache)) == want([d for d in data if d[0] % 2 == 0], model)
    assert spark.read.parquet(cache).count() == len({t for i, t in data if i % 2 == 0})
    assert rows(token_counts.count_tokens(docs, cache)) == want(data, model)
    assert spark.read.parquet(cache).count() == len({t for _, t in data})
    assert rows(token_counts.count_tokens(docs, cache)) == want(data, model)
    assert spark.read.parquet(cache).count() == len({t for _, t in data})


def test_known_counts_are_read_and_other_tokenizers_are_not(spark, model):
    from pyspark.sql import functions as F
    cache, docs = scratch(spark, "cache"), spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    digest = token_counts.tokenizer_digest(token_counts.model_path(token_counts.MODEL))
    stored = spark.createDataFrame([("a b c", digest, 77), ("a b c", digest, 77), ("d", "another", 99)], "t string, tokenizer string, n_tokens long")
    stored.select(F.unhex(F.sha2("t", 256)).alias("content"), "tokenizer", "n_tokens").write.parquet(cache)
    assert [r["n_tokens"] for r in token_counts.count_tokens(docs, cache).orderBy("doc_id").collect()] == [77, len(model.encode("d"))]


def test_digest_names_the_file(tmp_path):
    a, b = tmp_path / f"{uuid.uuid4().hex}", tmp_path / "b"
    a.write_bytes(b"one")
    b.write_bytes(b"two")
    assert token_counts.tokenizer_digest(str(a)) != token_counts.tokenizer_digest(str(b))
