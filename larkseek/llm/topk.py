"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into m segments of about log2(N) bits and stand in one table per segment value. A query
probes every segment at radius 0, then 1, and so on. After radius r in all segments, each code within
m * (r + 1) - 1 differing bits was seen, for it must agree to r bits in some segment. A query ends as
soon as its kth verified distance lies within that bound, so results are exact.

Rows with equal codes are one entry with its k smallest ids. The first bits of a segment value name a
block, and one task holds it. A query visits the blocks that its radius reaches; the values there are
probed and candidates verified inside the task, and only new ones within the query's bound (its kth
distance so far) leave it, at most k: no pair rows and no rows per probe are made. A block with very
many codes is dealt over slices, and its visitors go to each slice.

Defined cases: a query finds itself; ties go by id; vectors that are null or hold a null have no code
and are neither found nor answered; dimensions beyond 64 are not used and missing ones count as zero;
repeated ids are separate neighbours; with fewer than k rows all are returned; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkseek.llm.common import scratch, shuffle_partitions, stored

K = 10
BITS = 64
#: Index rows of one block on average; a block with more is sliced.
GROUP_ROWS = 400_000
FOUND = "q long, code long, distance int, least_id long, ids int"


def sign_codes(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, code): bit i is 1 where dimension i is above zero."""
    v = f"`{vector}`"
    code = F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (a, i) -> a | if(coalesce(get({v}, i), 0) > 0, shiftleft(1L, i), 0L))")
    return (vectors.where(f"{v} is not null and not exists({v}, x -> x is null)")
            .select(F.col(vec_id).cast("long").alias("id"), code.alias("code")))


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments for ``n`` codes: about log2(n) bits each."""
    m = min(BITS, max(2, round(BITS / max(math.log2(max(n, 2)), 1))))
    cuts = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(code: str, shift: int, width: int) -> str:
    return f"(shiftrightunsigned({code}, {shift}) & {(1 << width) - 1}L)"


def _entries(cuts: list[tuple[int, int]], prefix: int) -> Column:
    """Array of (segment, prefix, low) of column code: a segment value's first ``prefix`` bits name
    its block, the others its place there."""
    return F.expr("array(" + ", ".join(
        f"named_struct('segment', {s}, 'prefix', shiftright({_value('code', shift, w)}, {w - prefix}), 'low', {_value('code', shift, w)} & {(1 << (w - prefix)) - 1}L)"
        for s, (shift, w) in enumerate(cuts)) + ")")


def _visits(cuts: list[tuple[int, int]], prefix: int, radius: int) -> Column:
    """Array of (segment, prefix, rest) of query code q: the blocks that hold values with exactly
    ``radius`` changed bits, ``rest`` of them in the place."""
    parts = []
    for s, (shift, w) in enumerate(cuts):
        for changed in range(max(0, radius - (w - prefix)), min(prefix, radius) + 1):
            masks = ",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(prefix), changed))
            parts.append(f"transform(split('{masks}', ','), x -> named_struct('segment', {s}, 'prefix', "
                         f"shiftright({_value('q', shift, w)}, {w - prefix}) ^ cast(x as bigint), 'rest', {radius - changed}))")
    return F.expr(f"concat({', '.join(parts)})")


def _nearest(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest entries of each query: by distance, then smallest id."""
    group = group.sort_values(["q", "distance", "least_id"], kind="stable")
    return group[group.groupby("q").cumcount() < k]


def _search_block(visits: pd.DataFrame, index: pd.DataFrame, k: int, cuts: list[tuple[int, int]], prefix: int, radius: int) -> pd.DataFrame:
    """Probe the places of one block and verify the codes there.

    A code is reported only where it is first met, in the order of radius and then segment, and only
    if its distance is within the query's bound.
    """
    out = [pd.DataFrame({"q": np.zeros(0, np.int64), "code": np.zeros(0, np.int64), "distance": np.zeros(0, np.int32),
                         "least_id": np.zeros(0, np.int64), "ids": np.zeros(0, np.int32)})]
    if visits.empty or index.empty:
        return out[0]
    segment = int(index["segment"].iloc[0])
    shift, width = cuts[segment]
    bits = width - prefix
    index = index.sort_values("low", kind="stable")
    place, code, least, ids = (index[c].to_numpy() for c in ("low", "code", "least_id", "ids"))
    for rest, group in visits.groupby("rest"):
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(bits), int(rest))], np.int64)
        q_all, bound_all = group["q"].to_numpy(), group["bound"].to_numpy()
        step = max(1, 500_000 // len(masks))
        for at in range(0, len(q_all), step):
            q, bound = q_all[at:at + step], bound_all[at:at + step]
            own = (q.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
            asked = (own[:, None] ^ masks[None, :]).ravel()
            low = np.searchsorted(place, asked, "left")
            count = np.searchsorted(place, asked, "right") - low
            held = np.flatnonzero(count)
            total, begin = np.cumsum(count[held]), 0
            while begin < len(held):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 1_000_000, "right")))
                n = count[held[begin:end]]
                which = np.repeat(held[begin:end] // len(masks), n)
                row = np.repeat(low[held[begin:end]], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                differ = (q[which] ^ code[row]).view(np.uint64)
                distance = np.bitwise_count(differ).astype(np.int32)
                first = distance <= bound[which]
                for t, (s, w) in enumerate(cuts):
                    here = np.bitwise_count((differ >> np.uint64(s)) & np.uint64((1 << w) - 1))
                    first &= here > radius if t < segment else here >= radius
                which, row = which[first], row[first]
                out.append(_nearest(pd.DataFrame({"q": q[which], "code": code[row], "distance": distance[first], "least_id": least[row], "ids": ids[row]}), k))
                begin = end
    return _nearest(pd.concat(out), k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the ``k`` rows nearest to each query by Hamming
    distance. Both frames have columns id and code."""
    spark = rows.sparkSession
    first = Window.partitionBy("code").orderBy("id")
    members = stored(rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
                     .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), scratch(spark, "members"))
    n = members.count()
    cuts = segments(n)
    prefix = min(math.ceil(math.log2(max(shuffle_partitions(spark) / len(cuts), n / group_rows, 1))), min(w for _, w in cuts))
    index = members.select("code", F.col("ids")[0].alias("least_id"), F.size("ids").alias("ids"), F.explode(_entries(cuts, prefix)).alias("e")
                           ).select("e.segment", "e.prefix", "e.low", "code", "least_id", "ids")
    crowded = stored(index.groupBy("segment", "prefix").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("slices")).where("slices > 1"),
                     scratch(spark, "crowded-blocks"))
    any_crowded = bool(crowded.limit(1).count())

    def sliced(df: DataFrame, each: bool) -> DataFrame:
        if not any_crowded:
            return df.withColumn("slice", F.lit(0))
        df = df.join(crowded, ["segment", "prefix"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        slice_ = F.explode(F.expr("sequence(0, slices - 1)")) if each else F.pmod(F.xxhash64("code"), F.col("slices")).cast("int")
        return df.withColumn("slice", slice_).drop("slices")

    def at_radius(radius: int):
        return lambda visits, index: _search_block(visits, index, k, cuts, prefix, radius)

    block = ["segment", "prefix", "slice"]
    index = stored(sliced(index, False), scratch(spark, "index"))
    waiting = stored(queries.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)), scratch(spark, "queries"))
    best = spark.createDataFrame([], FOUND)
    near = Window.partitionBy("q").orderBy("distance", "least_id")
    for radius in range(max(w for _, w in cuts) + 1):
        if not n or not waiting.limit(1).count():
            break
        visits = sliced(waiting.select("q", "bound", F.explode(_visits(cuts, prefix, radius)).alias("v")).select("q", "bound", "v.segment", "v.prefix", "v.rest"), True)

        found = visits.groupBy(*block).cogroup(index.groupBy(*block)).applyInPandas(at_radius(radius), FOUND)
        best = stored(best.unionByName(found).withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k).drop("nth"), scratch(spark, f"best-{radius}"))
        proven = len(cuts) * (radius + 1) - 1
        kth = (best.withColumn("upto", F.sum("ids").over(near.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") >= k)
               .groupBy("q").agg(F.min("distance").alias("kth")))
        waiting = stored(waiting.join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > proven))
                         .select("q", F.least("bound", F.coalesce("kth", F.lit(BITS))).alias("bound")), scratch(spark, f"waiting-{radius}"))
    order = Window.partitionBy("q").orderBy("distance", "id")
    answers = (best.join(members.select("code", F.col("ids").alias("members")), "code").select("q", "distance", F.explode("members").alias("id"))
               .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    answers = stored(answers, scratch(spark, "answers"))
    return (queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(answers, "q")
            .select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance"))
