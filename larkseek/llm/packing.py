"""Best-fit packing of token sequences by hierarchical residual packing.

1. Each partition tokenises its documents, cuts those beyond the capacity, and packs its pieces
   best-fit, largest first. Nearly full bins are emitted.
2. Underfull bins are the items of the next round: groups of ``fan_in`` nodes merge theirs, best-fit
   again, and so on up a tree until one node is left.

A piece is at most ``capacity`` long, so bins of one node with the same fill are interchangeable. A
round works on *classes* (node, fill, number of bins) and says which range of a class goes to which
bins at which offset. A node therefore handles at most ``fan_in * capacity`` rows whatever the size
of the corpus, and no piece passes through the tree; pieces pick up their place in a join per level.

Defined cases: null and empty texts are the single end id; repeated rows are packed as often as
they occur; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkseek.llm.common import output_batch, scratch, slices, start_of_parts, stored

CAPACITY = 1024
END_ID = 2
FAN_IN = 16
#: A bin with at most this much room left is emitted.
SLACK = CAPACITY // 64
NODE_PIECES = 200_000
VOCABULARY, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"

Group = tuple[int, int, list[tuple[int, int, int]]]


def best_fit(entries: list[tuple[int, int]], capacity: int) -> list[Group]:
    """Pack ``count`` items of each ``size``, largest first, each into the fullest bin with room.

    Returns groups of equal bins: (fill, bins, parts), where a part (entry, first, offset) says that
    bin j of the group holds item ``first + j`` of the entry at ``offset``.
    """
    free: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
    held = 0  # bit r: some bins have room r

    def put(room: int, bins: int, parts: list) -> None:
        nonlocal held
        if bins:
            free[room].append((bins, parts))
            held |= 1 << room

    for entry in sorted(range(len(entries)), key=lambda i: -entries[i][0]):
        (size, left), at = entries[entry], 0
        while left:
            fits = held >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                bins, parts = free[room].pop()
                if not free[room]:
                    held &= ~(1 << room)
            else:
                room, parts = capacity, []
                bins = -(-left // (capacity // size))
            each = min(room // size, left)
            used = min(bins, left // each)
            filled = [*parts, *((entry, at + i * used, capacity - room + i * size) for i in range(each))]
            put(room - each * size, used, filled)
            put(room, bins - used, [(e, first + used, offset) for e, first, offset in parts])
            at, left = at + each * used, left - each * used
    return [(capacity - room, bins, parts) for room in range(capacity + 1) for bins, parts in free[room] if room < capacity]


def _places(groups: list[Group], full: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(entry, first, bins, offset, fill, first bin of the fill, first emitted bin or -1)."""
    emitted, of_fill = 0, {}
    for fill, bins, parts in groups:
        final, at = -1, of_fill.get(fill, 0)
        if fill >= full:
            final, emitted = emitted, emitted + bins
        else:
            of_fill[fill] = at + bins
        for entry, first, offset in parts:
            yield entry, first, bins, offset, fill, at, final


def tokenizer():
    """Text to ids as the JSON tokenizer gives them.

    The ranks file holds the same vocabulary and pattern and yields the same ids (tests compare
    them over every code point) several times faster; a text that it refuses, or that holds the
    special token's string, goes to the JSON tokenizer itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if SPECIAL not in text:
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:
                pass
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole, or full pieces after a first remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


LEAF = "doc_id long, piece int, start long, length long, ids_crc32 long, node long, fill int, bin long, place long, final long"


def _leaf(docs: DataFrame, capacity: int, full: int, end_id: int, node_pieces: int) -> DataFrame:
    """Tokenise and pack inside each partition; nothing is shuffled. A partition with very many
    pieces makes several nodes, so a task holds the numbers of ``node_pieces`` pieces at most."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("node", pa.int64()), ("fill", pa.int32()), ("bin", pa.int64()), ("place", pa.int64()), ("final", pa.int64())])

    def flush(docs_of: list, rows: list[tuple[int, int, int, int]], node: int) -> Iterator[pa.RecordBatch]:
        data = np.array(rows, np.int64).reshape(-1, 4)
        order = np.argsort(-data[:, 2], kind="stable")
        sizes, first, counts = np.unique(-data[order, 2], return_index=True, return_counts=True)
        place = np.zeros((len(rows), 4), np.int64)  # fill, bin, offset, final
        for entry, at, bins, offset, fill, bin_at, final in _places(best_fit(list(zip((-sizes).tolist(), counts.tolist(), strict=True)), capacity), full):
            steps = np.arange(bins)
            who = order[first[entry] + at + steps]
            place[who] = np.stack([np.full(bins, fill), bin_at + steps, np.full(bins, offset), final + steps if final >= 0 else np.full(bins, -1)], axis=1)
        for at in range(0, len(rows), 20_000):
            p, d = place[at:at + 20_000], data[at:at + 20_000]
            yield output_batch(schema, [docs_of[at:at + 20_000], *(d[:, k].astype(np.int32) if k == 0 else d[:, k] for k in range(4)),
                                        np.full(len(p), node), p[:, 0].astype(np.int32), p[:, 1], p[:, 2], p[:, 3]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, node = tokenizer(), TaskContext.get().partitionId() << 20
        docs_of, rows = [], []
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4").tobytes()
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        docs_of.append(doc)
                        rows.append((k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
                if len(rows) >= node_pieces:
                    yield from flush(docs_of, rows, node)
                    docs_of, rows, node = [], [], node + 1
        if rows:
            yield from flush(docs_of, rows, node)

    return docs.mapInArrow(run, LEAF)


MERGE = "node long, fill int, first long, bins long, shift long, to_node long, to_fill int, to_bin long, to_final long"


def _merge(classes: DataFrame, capacity: int, full: int) -> DataFrame:
    """One round: best-fit of the classes that share ``to_node``."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "node"], ascending=[False, True])
        entries = list(zip(group["fill"].tolist(), group["bins"].tolist(), strict=True))
        node, fill, to = group["node"].tolist(), group["fill"].tolist(), int(group["to_node"].iloc[0])
        rows = [(node[e], fill[e], first, bins, offset, to, to_fill, at, final)
                for e, first, bins, offset, to_fill, at, final in _places(best_fit(entries, capacity), full)]
        return pd.DataFrame(rows, columns=["node", "fill", "first", "bins", "shift", "to_node", "to_fill", "to_bin", "to_final"])
    return classes.groupBy("to_node").applyInPandas(run, MERGE)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, fan_in: int = FAN_IN,
         slack: int | None = None, node_pieces: int = NODE_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``slack`` is the room up to which a bin counts as nearly full (capacity / 64 by default).
    """
    spark = docs.sparkSession
    full = capacity - (capacity // 64 if slack is None else slack)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = stored(_leaf(slim, capacity, full, end_id, node_pieces), scratch(spark, "pieces"))
    out = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).alias("level"), "node", "fill", "bin", F.col("place").alias("offset"), "final")
    # number the nodes densely, so that every tree node has up to fan_in children
    nodes = start_of_parts(pieces.select("node").distinct().withColumn("one", F.lit(1).cast("long")), [], "node", {"one": "number"})
    classes = (pieces.where("final < 0").groupBy("node", "fill").agg((F.max("bin") + 1).alias("bins"))
               .join(F.broadcast(nodes), "node").select("node", "fill", "bins", F.floor(F.col("number") / fan_in).alias("to_node")))
    emitted = [pieces.where("final >= 0").groupBy("node").agg((F.max("final") + 1).alias("n")).select(F.lit(0).alias("level"), "node", "n")]
    width, level = nodes.count(), 0
    while width:
        level += 1
        last = width <= fan_in
        moves = stored(_merge(classes, capacity, 0 if last else full), scratch(spark, f"merge-{level}"))
        emitted.append(moves.where("to_final >= 0").groupBy("to_node").agg(F.max(F.col("to_final") + F.col("bins")).alias("n"))
                       .select(F.lit(level).alias("level"), F.col("to_node").alias("node"), "n"))
        # at most capacity ranges per (node, fill): the ranges of one class side by side
        lists = stored(moves.groupBy("node", "fill").agg(F.collect_list(F.struct("first", "bins", "shift", "to_node", "to_fill", "to_bin", "to_final")).alias("moves")),
                       scratch(spark, f"moves-{level}"))
        moved = (out.where("final < 0").join(lists, ["node", "fill"])
                 .withColumn("m", F.expr("filter(moves, m -> bin >= m.first and bin < m.first + m.bins)[0]"))
                 .select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(level).alias("level"), F.expr("m.to_node").alias("node"),
                         F.expr("m.to_fill").alias("fill"), F.expr("m.to_bin + bin - m.first").alias("bin"), F.expr("offset + m.shift").alias("offset"),
                         F.expr("if(m.to_final < 0, -1L, m.to_final + bin - m.first)").alias("final")))
        out = out.where("final >= 0").unionByName(moved if last else stored(moved, scratch(spark, f"moved-{level}")))
        if last:
            break
        classes = (moves.where("to_final < 0").groupBy("to_node", "to_fill").agg(F.max(F.col("to_bin") + F.col("bins")).alias("bins"))
                   .select(F.col("to_node").alias("node"), F.col("to_fill").alias("fill"), "bins", F.floor(F.col("to_node") / fan_in).alias("to_node")))
        width = -(-width // fan_in)
    counts = emitted[0]
    for e in emitted[1:]:
        counts = counts.unionByName(e)
    counts = counts.withColumn("key", F.struct("level", "node"))
    starts = start_of_parts(counts, [], "key", {"n": "base"}).select(F.col("key.level").alias("level"), F.col("key.node").alias("node"), "base")
    # one row per tree node
    return (out.join(F.broadcast(starts), ["level", "node"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("final")).alias("sequence_id"), "offset"))

