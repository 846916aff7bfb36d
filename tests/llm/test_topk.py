import random

from llm_cases import Row  # noqa: F401

from larkseek.llm import topk
from larkseek.llm.common import table


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(data, queries, k):
    return sorted((q, r + 1, i, d) for q, c in queries
                  for r, (d, i) in enumerate(sorted(((c ^ x) & (2 ** 64 - 1)).bit_count() and (((c ^ x) & (2 ** 64 - 1)).bit_count(), i) or (0, i) for i, x in data)[:k]))


def run(spark, data, queries, k, **more):
    def df(rows):
        return spark.createDataFrame([(i, signed(c)) for i, c in rows], "id long, code long").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df(data), df(queries), k, **more).collect())


def test_random_and_clustered_codes(spark):
    rng = random.Random(1)
    data = [(i, rng.getrandbits(64)) for i in range(250)]
    for i in range(250, 400):
        data.append((i, data[rng.randrange(250)][1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))))
    queries = data[::37] + [(9999, rng.getrandbits(64))]
    assert run(spark, data, queries, 7) == brute(data, queries, 7)


def test_copies_ties_and_slices(spark):
    """Half of the rows share one code; values are sliced at four rows."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    data = [(i, base) for i in range(150)] + [(i, base ^ (1 << rng.randrange(16))) for i in range(150, 200)] + [(i, rng.getrandbits(64)) for i in range(200, 260)]
    queries = data[::50]
    assert run(spark, data, queries, 5, group_rows=4) == brute(data, queries, 5)


def test_fewer_rows_than_k_and_empty(spark):
    data = [(1, 5), (2, 2 ** 64 - 1), (3, 5)]
    assert run(spark, data, data[:1], 10) == brute(data, data[:1], 10)
    none = spark.createDataFrame([], "id long, code long")
    assert topk.top_k(none, none).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, 5)], "id long, code long"), none).collect() == []


def test_sign_codes(spark):
    rows = [(1, [0.5, -1.0] * 32), (2, None), (3, [1.0, None]), (4, []), (5, [1.0] * 80), (None, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as id", "1 as code")
    got = {r["id"]: r["code"] for r in topk.sign_codes(df, "vec_id", "embedding").collect()}
    assert got == {1: 0x5555555555555555, 4: 0, 5: -1, None: 2}


def test_given_table(spark, sf):
    rows = topk.sign_codes(table(spark, sf, "embeddings"), "vec_id", "embedding")
    data = [(r["id"], r["code"] & (2 ** 64 - 1)) for r in rows.collect()]
    queries = [r for r in data if r[0] % 50 == 0]
    got = sorted(tuple(r) for r in topk.top_k(rows, rows.where("id % 50 = 0")).collect())
    assert got == brute(data, queries, 10)
