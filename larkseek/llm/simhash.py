"""SimHash near-duplicates by a generalised pigeonhole search.

1. Fingerprint: a bit is 1 if more than half of the hashes of a text's word shingles set it.
2. The distinct fingerprints are searched for pairs with at most ``radius`` differing bits. Their
   bits are grouped into m parts, correlated bits together. With thresholds t_i that sum to
   ``radius - m + 1`` every such pair differs in at most t_i bits of some part i (t_i = -1 skips a
   part). Dynamic programming allocates the thresholds, and the number of parts, by the estimated
   number of probes and candidates; the statistics come from all fingerprints.
3. Probe: each fingerprint stands under its part's value and, for t_i > 0, under every value within
   t_i bits. Verify: the fingerprints under one value are compared whole.
4. A value that very many fingerprints share is not compared pair by pair: its fingerprints stand
   under themselves and their 64 one-bit changes. Two of them differ in at most two bits exactly if
   they meet there, and no such place holds more than 65.
5. Links are contracted to connected components; documents get the smallest id of theirs.

Copies share a fingerprint and never meet as pairs. Only a spanning forest of each value's links
leaves a task.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle; a null id takes part and is ignored as
the smallest id, a component of null ids has component null; repeated rows stay repeated in
:func:`near_duplicates`, and one of them stays in :func:`deduplicate`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkseek.llm.common import ASCII_LOWER, blocks, free_name, output_batch, scratch, shuffle_partitions, slices, stored, text_bytes
from larkseek.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
#: Values with more entries than this are searched through one-bit changes instead.
HOT = 512
#: Relative cost of one probe entry (shuffled) and of one candidate comparison (in memory).
PROBE_COST, CANDIDATE_COST = 1.0, 0.01
SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _counted(hashes: list[int], ones: np.ndarray) -> None:
    """Add the set bits of 64-bit hashes to ``ones`` through one histogram per byte."""
    data = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        ones[8 * k:8 * k + 8] += np.bincount(data[:, k], minlength=256) @ _BYTE_BITS


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash."""
    ones, n, tail, digest = np.zeros(BITS, np.int64), 0, [], xxhash.xxh64_intdigest
    for block in blocks(text_bytes(text).translate(ASCII_LOWER), SPACE):
        words = tail + block.split()
        hashes = [digest(b" ".join(w), seed) for w in zip(*(words[k:] for k in range(shingle)), strict=False)]
        if hashes:
            n += len(hashes)
            _counted(hashes, ones)
        tail = words[-(shingle - 1):] if shingle > 1 else []
    if not n and tail:
        n = 1
        _counted([digest(b" ".join(tail), seed)], ones)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint as a signed long in column ``name``."""
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = [_signed(fingerprint(t)) for t in part.column(at).to_pylist()]
                yield output_batch(pa.schema([*part.schema, pa.field(name, pa.int64())]), [*part.columns, values])

    return docs.mapInArrow(run, schema)


def bit_statistics(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, matrix of how many set bits i and j), over all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                total += (x[at:at + (1 << 16)].T @ x[at:at + (1 << 16)]).astype(np.int64)
        i, j = np.triu_indices(BITS)
        yield output_batch(pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())]), [i.astype(np.int32), j.astype(np.int32), total[i, j]])

    out = np.zeros((BITS, BITS))
    # 64 * 65 / 2 sums
    for r in fingerprints.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return fingerprints.count(), out


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each starts from the strongest free pair and takes the bits most
    correlated with what it has."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    c = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(c, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        sub = c[np.ix_(free, free)]
        group = [free[int(np.argmax(sub.max(axis=1)))]]
        free.remove(group[0])
        while len(group) < width:
            best = free[int(np.argmax(c[np.ix_(free, group)].sum(axis=1)))]
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return _signed(sum(1 << b for b in bits))


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per part, that sum to ``total`` at the lowest cost: dynamic programming over
    the parts and the sum so far."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in options.items():
                new = (cost + c, [*chosen, t])
                if spent + t not in step or new < step[spent + t]:
                    step[spent + t] = new
        best = step
    return best[total]


def plan(fingerprints: DataFrame, radius: int = RADIUS, choices: tuple[int, ...] = (3, 2, 4, 1)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe.

    Pairs that agree in a part are counted over all fingerprints; pairs that differ in up to t of its
    bits are estimated from that count and the share of ones of each bit.
    """
    n, both = bit_statistics(fingerprints)
    agree = np.clip((np.diag(both) / max(n, 1)) ** 2 + (1 - np.diag(both) / max(n, 1)) ** 2, 0.5, 1)
    groupings = {m: group_bits(n, both, m) for m in choices}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v"))
            for m, groups in groupings.items() for k, bits in enumerate(groups) if m > 1]
    equal = {(r["m"], r["k"]): float(r["pairs"]) for r in
             fingerprints.select(F.explode(F.array(*keys)).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("s.m", "s.k").agg(F.sum(F.expr("c * (c - 1.0) / 2")).alias("pairs")).collect()} if n else {}
    best = None
    for m, groups in groupings.items():
        costs = []
        for k, bits in enumerate(groups):
            odds = [(1 - agree[b]) / agree[b] for b in bits]
            more = [1.0, sum(odds), sum(a * b for a, b in combinations(odds, 2))]
            floor = float(np.prod(agree[bits])) * n * n / 2
            base = max(equal.get((m, k), 0.0), floor)
            options = {-1: 0.0}
            for t in range(radius + 1):
                probes = sum(comb(len(bits), d) for d in range(t + 1))
                options[t] = PROBE_COST * n * probes + CANDIDATE_COST * base * sum(more[:t + 1])
            costs.append(options)
        found = allocate(costs, radius - m + 1)
        if best is None or found[0] < best[0]:
            best = (found[0], [(bits, t) for bits, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def _entries(fingerprints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, own): where each fingerprint stands; ``own`` marks its true value."""
    rows = []
    for k, (bits, t) in enumerate(parts):
        for d in range(t + 1):
            for flips in combinations(bits, d):
                value = F.col("fp").bitwiseXOR(F.lit(_mask(flips))) if flips else F.col("fp")
                rows.append(F.struct(F.lit(k).alias("part"), value.bitwiseAND(F.lit(_mask(bits))).alias("key"), F.lit(not flips).alias("own")))
    return fingerprints.select("fp", F.explode(F.array(*rows)).alias("e")).select("e.part", "e.key", "fp", "e.own")


def _verify(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each (part, key) run of a sorted stream, as a spanning forest: (a, b), a > b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def links(part: np.ndarray, key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        n = len(fp)
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
        after = end - np.arange(n) - 1
        label = np.arange(n)
        cuts = np.searchsorted(np.cumsum(after), np.arange(1, int(after.sum()) // 2_000_000 + 2) * 2_000_000)
        left_all, right_all, at = [], [], 0
        for stop in [*cuts.tolist(), n]:
            stop = min(stop + 1, n)
            count = after[at:stop]
            left = np.repeat(np.arange(at, stop), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            near = (own[left] | own[right]) & (fp[left] != fp[right]) & (np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= radius)
            left_all.append(left[near])
            right_all.append(right[near])
            at = stop
        left, right = np.concatenate(left_all), np.concatenate(right_all)
        while True:
            low = np.minimum(label[left], label[right])
            before = label.copy()
            np.minimum.at(label, left, low)
            np.minimum.at(label, right, low)
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(n))
        x, y = fp[moved], fp[label[moved]]
        differ = x != y
        return output_batch(schema, [np.maximum(x, y)[differ], np.minimum(x, y)[differ]])

    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        rows = [np.concatenate([a, b]) for a, b in zip(rest, new, strict=True)]
        if not len(rows[0]):
            continue
        last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1 if ((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).any() else 0
        rest = [r[last:] for r in rows]
        if last:
            yield links(*(r[:last] for r in rows))
    if len(rest[0]):
        yield links(*rest)


def _met(fingerprints: DataFrame) -> DataFrame:
    """Links at up to two bits among ``fingerprints`` through their one-bit changes. At most 65
    fingerprints stand at one place."""
    places = fingerprints.select("fp", F.explode(F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")).alias("place"))
    met = places.groupBy("place").agg(F.array_sort(F.collect_list("fp")).alias("l")).where("size(l) > 1")
    return met.select(F.explode(F.expr("slice(l, 2, size(l) - 1)")).alias("a"), F.col("l")[0].alias("b")).distinct()


def links(fingerprints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(a, b) links, a > b, among distinct fingerprints (column fp), enough to connect every pair
    with at most ``radius`` differing bits."""
    spark = fingerprints.sparkSession
    entries = _entries(fingerprints, plan(fingerprints, radius))
    often = stored(entries.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), scratch(spark, "hot-values"))
    crowded = None
    if radius == 2 and often.limit(1).count():
        crowded = entries.join(often, ["part", "key"], "left_semi").select("fp").distinct()
        entries = entries.join(often, ["part", "key"], "left_anti")
    ordered = entries.repartition(shuffle_partitions(spark), "part", "key").sortWithinPartitions("part", "key")
    found = ordered.select("part", "key", "fp", "own").mapInArrow(lambda it: _verify(it, radius), "a long, b long")
    return found if crowded is None else found.unionByName(_met(stored(crowded, scratch(spark, "crowded"))))


def _classes(rows: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in ``rows`` (doc_id, fp); root is the smallest
    fingerprint of the component. ``find`` makes the links of distinct fingerprints."""
    spark = rows.sparkSession
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), scratch(spark, "fingerprints"))
    roots = stored(components(find(nodes)), scratch(spark, "roots"))
    rooted = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), scratch(spark, "rooted"))
    smallest = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), scratch(spark, "smallest"))
    return stored(rooted.join(smallest, "root").select("fp", "root", "component_id"), scratch(spark, "classes"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stored(with_fingerprints(slim, "text", "fp").select("doc_id", "fp"), scratch(docs.sparkSession, "doc-fingerprints"))
    return (rows.join(_classes(rows, lambda nodes: links(nodes, radius, hot)), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (then the smallest
    fingerprint; one of its repeats)."""
    name = free_name(docs, "fp")
    whole = stored(with_fingerprints(docs, text, name), scratch(docs.sparkSession, "documents-fp"))
    return _first_rows(whole, doc_id, name, lambda nodes: links(nodes, radius, hot), docs.columns)


def _first_rows(whole: DataFrame, doc_id: str, name: str, find: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    spark = whole.sparkSession
    rows = whole.select(F.col(doc_id).alias("doc_id"), F.col(name).alias("fp"))
    first = rows.join(_classes(rows, find), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(first.groupBy("root").agg(F.min("fp").alias("kept_fp"), F.min("component_id").alias("kept_id"), F.count(F.lit(1)).alias("kept_rows")), scratch(spark, "kept"))
    out = whole.join(kept, whole[doc_id].eqNullSafe(kept["kept_id"]) & (whole[name] == kept["kept_fp"]), "left_semi")
    if kept.where("kept_rows > 1").limit(1).count():
        out = out.dropDuplicates([doc_id, name])
    return out.select(*[F.col(f"`{c}`") for c in columns])
