"""Centroid clustering of integer vectors by Shallot search, exact.

Every vector keeps its nearest and second-nearest centroid, an upper bound on its distance to the
nearest and a lower bound on that to any other. A round first moves the bounds by what the centroids
moved; where they stay apart nothing is computed. Otherwise the distances to the two remembered
centroids are computed and the search starts from the closer one: its neighbours are visited in the
order of their distance to it, up to the ball whose radius is the vector's distance to the start plus
its distance to the second-best found so far, which shrinks as better ones are met. Bounds are
floating point with a margin; whatever survives them is compared as exact integers, ties going to
the smaller number.

Tasks hold vectors in batches and the centroids (a bounded number). Sums for the next centroids are
a Spark aggregate with partial sums, one row per centroid to the driver. A round's state is a table
in the shared folder, and the one before it is removed when the next is complete.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are
left out; components beyond 2**27 in size are held there, as their squared distances would not fit
a long; with fewer vectors than centroids, each is one; equal vectors among the first are separate
centroids, of which all vectors take the smaller number; a centroid without vectors stays; null and
repeated ids are rows like any other; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkseek.llm.common import discard, output_batch, scratch, slices, stored

CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
BOUND = 1 << 27
MARGIN = 1e-9
STATE = "vec_id long, x array<int>, near int, second int, upper double, lower double, distance long"
LONGEST = (1 << 63) - 1


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that count, components as integers floor(scale * x)."""
    v = f"`{vector}`"
    return (vectors.where(f"size({v}) = {dims} and not exists({v}, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.expr(f"transform({v}, x -> int(greatest(-{BOUND}L, least({BOUND}L, floor({scale} * double(x))))))").alias("x")))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """One assignment of vectors to ``centroids``, which moved by ``moved`` since the last one."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None):
        self.c, k = centroids, len(centroids)
        self.moved = moved
        self.others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)]) if moved is not None else None
        self.gap = np.sqrt([_squared(centroids, c) for c in centroids]).reshape(k, k)
        self.order = [[int(j) for j in np.argsort(self.gap[a], kind="stable") if j != a] for a in range(k)]

    def fresh(self, n: int) -> tuple[np.ndarray, ...]:
        return np.zeros(n, np.int32), np.full(n, min(1, len(self.c) - 1), np.int32), np.full(n, np.inf), np.zeros(n)

    def run(self, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Update the four state arrays in place; the number of distances computed is returned."""
        if len(self.c) == 1:
            return 0
        if self.moved is not None:
            upper += self.moved[near]
            lower -= self.others[near]
        at = np.flatnonzero(upper * (1 + MARGIN) + MARGIN >= lower)
        best = _squared(x[at], self.c[near[at]])
        work = len(at)
        upper[at] = np.sqrt(best)
        keep = upper[at] * (1 + MARGIN) + MARGIN >= lower[at]
        at, best = at[keep], best[keep]
        work += len(at)
        other = _squared(x[at], self.c[second[at]])
        a, b = near[at], second[at]
        swap = (other < best) | ((other == best) & (b < a))
        a, b, best, other = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, other, best), np.where(swap, best, other)
        start, seen, ball = a.copy(), b.copy(), np.sqrt(best)
        for s in range(len(self.c)):
            rows = np.flatnonzero(start == s)
            for j in self.order[s]:
                rows = rows[self.gap[s, j] <= (ball[rows] + np.sqrt(other[rows])) * (1 + MARGIN) + MARGIN]
                if not len(rows):
                    break
                new = rows[seen[rows] != j]
                d = _squared(x[at[new]], self.c[j])
                work += len(new)
                first = (d < best[new]) | ((d == best[new]) & (j < a[new]))
                to = new[first]
                b[to], other[to] = a[to], best[to]
                a[to], best[to] = j, d[first]
                next_ = ~first & (d < other[new])
                to = new[next_]
                b[to], other[to] = j, d[next_]
        near[at], second[at], upper[at], lower[at] = a, b, np.sqrt(best), np.sqrt(other)
        return work


def _assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    started = "near" in state.columns
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("near", pa.int32()), ("second", pa.int32()),
                        ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, moved)
        for batch in batches:
            for rows in slices(batch, 8192):
                x = rows.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, -1)
                bounds = (tuple(rows.column(c).to_numpy(zero_copy_only=False).copy() for c in ("near", "second", "upper", "lower"))
                          if started else search.fresh(rows.num_rows))
                search.run(x, *bounds)
                yield output_batch(schema, [rows.column("vec_id"), rows.column("x").cast(pa.list_(pa.int32())), *bounds, _squared(x, centroids[bounds[0]])])

    return state.mapInArrow(run, STATE)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256 of every row of
    ``vectors`` (vec_id, x of one length)."""
    spark = vectors.sparkSession
    first = (vectors.select(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x")
             .orderBy("h", "x").limit(k).collect())
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    centroids, moved, state, path = np.array([r["x"] for r in first], np.int64), None, vectors, None
    dims = centroids.shape[1]
    for turn in range(rounds + 1):
        before, path = path, scratch(spark, f"clusters-{turn}")
        state = stored(_assign(state, centroids, moved), path)
        if before:
            discard(spark, before)
        if turn == rounds:
            break
        # one row per centroid
        sums = state.groupBy("near").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dims)]).collect()
        after = centroids.copy()
        for r in sums:
            after[r["near"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        moved, centroids = np.sqrt(_squared(after, centroids)), after
    of = {r["near"]: int(r["d"]) for r in state.groupBy("near").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(sum(of.values()), LONGEST)
    about = spark.createDataFrame([(j, min(d, LONGEST), [int(v) for v in centroids[j]], hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest())
                                   for j, d in of.items()], "near int, cluster_inertia long, centroid array<long>, centroid_sha256 string")
    # about: one row per centroid
    return (state.select("vec_id", "near", "distance").join(F.broadcast(about), "near")
            .select("vec_id", F.col("near").alias("cluster"), "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid", "centroid_sha256"))
