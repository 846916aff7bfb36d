import zlib

from llm_cases import clashing, empty, odd_docs, odd_rows

from larkseek.llm import sharding
from larkseek.llm.common import table


def check(got, docs, shards=24):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == \
        sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs), key=repr)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered]
    assert ids == sorted(ids)  # contiguous in id order
    sizes, largest = [0] * shards, max((r["size"] for r in got), default=0)
    for s in range(shards):
        own = [r for r in ordered if r["shard"] == s]
        assert [r["slot"] for r in own] == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    target = sum(sizes) / shards
    assert all(abs(x - target) <= largest for x in sizes)


def test_given_table(spark, sf):
    docs = table(spark, sf, "documents")
    check(sharding.shard(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    check(sharding.shard(clashing(odd_docs(spark)), shards=3).collect(), [r[:2] for r in odd_rows()], 3)
    assert sharding.shard(empty(spark)).collect() == []


def test_one_id_for_most_rows_is_spread(spark):
    data = [(7, "same")] * 400 + [(k, "x" * (k % 50)) for k in range(200)]
    got = sharding.shard(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    check(got, data)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) > 5
