import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import clashing, empty, odd_docs, odd_rows, rows
from tokenizers import Tokenizer

from larkseek.llm import packing
from larkseek.llm.common import table


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(got, docs, exact, capacity=1024):
    """Pieces rebuild every document; sequences are gapless and not too long."""
    want = []
    for doc, text in docs:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= capacity else (len(ids) % capacity or capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        if cuts[-1] != len(ids):
            cuts.append(len(ids))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in got)


def test_odd_rows(spark, exact):
    got = packing.pack(odd_docs(spark)).collect()
    check(got, [r[:2] for r in odd_rows()], exact)


def test_given_table_is_nearly_full(spark, sf, exact):
    docs = table(spark, sf, "documents")
    n, tokens = check(packing.pack(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], exact)
    assert n <= 1.02 * -(-tokens // 1024) + 1


def test_small_nodes_merge_through_a_tree(spark, exact):
    """Many nodes of few pieces: residual bins meet further up."""
    rng = random.Random(3)
    data = [(k, "a b " * rng.randint(0, 60)) for k in range(800)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    got = packing.pack(docs, capacity=64, fan_in=3, slack=0, node_pieces=256).collect()
    n, tokens = check(got, data, exact, 64)
    assert n <= 1.05 * tokens / 64 + 2


def test_empty_and_extra_columns(spark, exact):
    assert packing.pack(empty(spark)).collect() == []
    got = packing.pack(clashing(odd_docs(spark)))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(got.collect(), [r[:2] for r in odd_rows()], exact)


def test_best_fit_against_item_by_item():
    """Groups hold every item once and never overflow."""
    rng = random.Random(5)
    for _ in range(50):
        entries = [(rng.randint(1, 30), rng.randint(1, 40)) for _ in range(rng.randint(1, 12))]
        seen = {}
        for fill, bins, parts in packing.best_fit(entries, 30):
            assert sum(entries[e][0] for e, _, _ in parts) == fill <= 30
            assert sorted(o for _, _, o in parts) == sorted(o for _, _, o in parts)
            for e, first, _ in parts:
                for j in range(first, first + bins):
                    assert (e, j) not in seen
                    seen[e, j] = True
        assert len(seen) == sum(c for _, c in entries)


def test_ranks_give_the_ids_of_the_tokenizer(exact):
    """Over code points of every plane in use, and over mixed strings."""
    encode = packing.tokenizer()
    points = [c for c in (*range(1, 0x3400), *range(0xA000, 0x11000, 3), *range(0x1F000, 0x1FB00), *range(0xE0000, 0xE0080)) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1000):
        texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 .{chr(c)}. {chr(c)}\n{chr(c)}'s" for c in points[at:at + 1000]]
        for t, e in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
            assert encode(t).tolist() == e.ids
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "日本", "'s", "1", "²", " ", " ", "́", "😀", "\x00", "\x85"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids
    long = " " * 300_000 + "x"
    assert encode(long).tolist() == exact.encode(long, add_special_tokens=False).ids


def test_repeats_are_packed_as_often_as_they_occur(spark):
    docs = spark.createDataFrame([(1, "same text")] * 5, "doc_id long, text string")
    assert len(rows(packing.pack(docs))) == 5
