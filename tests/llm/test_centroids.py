import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from larkseek.llm import centroids
from larkseek.llm.common import table


def brute(data, k=16, rounds=3, dims=64):
    """Every distance of every round, in Python integers."""
    kept = [(i, [max(-centroids.BOUND, min(centroids.BOUND, math.floor(64 * float(x)))) for x in v]) for i, v in data
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    c = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), o in zip(kept, of, strict=True) if o == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [nearest(x) for _, x in kept]
    total = sum(d for d, _ in last)
    return sorted(((i, j, d, sum(e for e, o in last if o == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, last, strict=True)), key=repr)


def run(spark, data, **more):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    for name in ("x", "near", "second", "upper", "lower", "distance", "h", "cluster"):
        df = df.withColumn(name, F.lit("y"))
    out = centroids.cluster(centroids.integers(df, dims=more.pop("dims", 64)), **more).drop("centroid")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def blobs(rng, n, dims, spread=1.0):
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in rng.choice(middles)]) for i in range(n)]


def test_clusters_and_copies(spark):
    """Blobs, a third of all rows one vector, and equal vectors among the first."""
    rng = random.Random(3)
    data = blobs(rng, 300, 64, 0.1)
    data += [(1000 + k, data[0][1]) for k in range(160)]
    assert run(spark, data) == brute(data)


def test_ties(spark):
    """Few integer places: many equal distances and equal centroids."""
    rng = random.Random(4)
    data = [(i, [rng.randrange(-2, 3) / 64 for _ in range(3)]) for i in range(400)]
    for rounds in (0, 1, 5):
        assert run(spark, data, k=12, rounds=rounds, dims=3) == brute(data, 12, rounds, 3)


def test_odd_vectors(spark):
    v = [0.5] * 64
    data = [(1, v), (1, v), (None, v), (2, None), (3, []), (4, v[:63]), (5, v + [1.0]), (6, [None] + v[1:]), (7, [math.nan] + v[1:]), (8, [math.inf] + v[1:]),
            (9, [3e38, -3e38] + v[2:]), (10, [-0.001] * 64), (None, [1.0] * 64)]
    assert run(spark, data) == brute(data)
    assert run(spark, data, k=1) == brute(data, 1)
    assert run(spark, data[3:9]) == [] and run(spark, []) == []


def test_bounds_save_work():
    """In later rounds most vectors need few distances, and none is assigned otherwise than by all."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-400, 400, (16, 64))
    x = (middles[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 64))).astype(np.int64)
    c, state, moved, work = x[:16].copy(), None, None, []
    for _ in range(5):
        search = centroids.Search(c, moved)
        state = state or search.fresh(len(x))
        work.append(search.run(x, *state))
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        d.sort(1)
        assert (state[2] >= np.sqrt(d[:, 0]) - 1e-6).all() and (state[3] <= np.sqrt(d[:, 1]) + 1e-6).all()
        new = np.array([x[state[0] == j].sum(0) // max((state[0] == j).sum(), 1) if (state[0] == j).any() else c[j] for j in range(16)])
        moved, c = np.sqrt(((new - c) ** 2).sum(1)), new
    assert work[0] < 0.9 * len(x) * 16 and work[-1] < 0.2 * len(x) * 16


def test_given_table(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    assert run(spark, [tuple(r) for r in rows]) == brute([tuple(r) for r in rows])
