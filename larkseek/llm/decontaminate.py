"""Benchmark decontamination: scan documents for windows of benchmark items.

The windows (13 consecutive words; a shorter item is one window) go out as a broadcast hash set:
words become numbers of the benchmark's own vocabulary, windows become 64-bit hashes with their
words beside them. A task turns a text into word numbers, looks up the hash of each window that
holds known words only, and verifies every hit word by word, so results are exact.

The broadcast is bounded: items are dealt into slices of at most ``slice_words`` words each, and
further slices are scanned in further passes that add to the hits of the earlier ones.

Defined cases: a null or empty text has no words and no hits; an item without words has no
windows; equal items, and equal texts in several items, all count; a null item id is named
``null``; several rows with one item id count once. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkseek.llm.common import ASCII_LOWER, blocks, free_name, output_batch, slices, text_bytes

WINDOW = 13
SLICE_WORDS = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
# words: digits, lower-case letters and everything beyond ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = h * BASE + rows[:, j].astype(np.uint64)
    return h


class WindowSet:
    """Hash set of the windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            words = WORD.findall(text_bytes(text).translate(ASCII_LOWER))
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
            if len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                found.setdefault(rows.shape[1], []).append((rows, number[name]))
        self.lengths = {}
        for length, parts in found.items():
            rows = np.concatenate([r for r, _ in parts])
            owner = np.concatenate([np.full(len(r), o, np.int32) for r, o in parts])
            h = _hash_rows(rows)
            order = np.argsort(h, kind="stable")
            self.lengths[length] = (h[order], rows[order], owner[order])

    def numbers(self, text: str | None) -> np.ndarray:
        """Word numbers of a text, 0 for a word that no item has."""
        get = self.vocabulary.get
        parts = [np.array([get(w, 0) for w in WORD.findall(b)], np.int32)
                 for b in blocks(text_bytes(text).translate(ASCII_LOWER), GAP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def mark(self, ids: np.ndarray, hit: np.ndarray, step: int = 1 << 18) -> set[str]:
        """Set ``hit`` for each word inside a window; the names of the items that occur."""
        owners: set[int] = set()
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for length, (hashes, rows, owner) in self.lengths.items():
            if len(ids) < length:
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            for at in range(0, len(starts), step):
                s = starts[at:at + step]
                windows = ids[s[:, None] + np.arange(length)]
                h = _hash_rows(windows)
                low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                n = high - low
                which = np.repeat(np.arange(len(s)), n)
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                same = (rows[entry] == windows[which]).all(axis=1)
                owners.update(owner[entry[same]].tolist())
                for start in np.unique(s[which[same]]).tolist():
                    hit[start:start + length] = True
        return {self.names[k] for k in owners}


def _window_sets(benchmark: DataFrame, item: str, text: str, window: int, slice_words: int) -> Iterator[WindowSet]:
    """One bounded window set per slice of the benchmark; bytes / 2 is an upper bound of the words."""
    b = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("string").alias("t"))
    size = b.agg(F.sum(F.octet_length("t") / 2)).first()[0] or 0
    n = max(1, math.ceil(size / slice_words))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield WindowSet([(r["i"], r["t"]) for r in part.toLocalIterator()], window)


def _scan(docs: DataFrame, text: str, finish: Callable, result: T.StructType | str, benchmark: DataFrame, item: str, item_text: str, window: int, slice_words: int) -> DataFrame:
    """Pass ``docs`` by every window set. ``finish(rows, flags, names)`` makes the result from some
    input rows, the hit flags of their words, and the items that occur in them.

    Between the passes of a benchmark of several slices, two more columns carry flags and items.
    """
    spark, at = docs.sparkSession, docs.columns.index(text)
    state = [(free_name(docs, "hit_words"), pa.binary(), T.BinaryType()), (free_name(docs, "hit_items"), pa.list_(pa.string()), T.ArrayType(T.StringType()))]
    sets = _window_sets(benchmark, item, item_text, window, slice_words)
    out, k, following = docs, 0, next(sets)
    while following is not None:
        shared, following = spark.sparkContext.broadcast(following), next(sets, None)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0, last=following is None) -> Iterator[pa.RecordBatch]:
            found = shared.value
            for batch in batches:
                for part in slices(batch):
                    old = None if first else list(zip(*(part.column(part.num_columns - c).to_pylist() for c in (2, 1)), strict=True))
                    flags, names = [], []
                    for row, value in enumerate(part.column(at).to_pylist()):
                        ids = found.numbers(value)
                        hit = np.zeros(len(ids), bool) if first else np.unpackbits(np.frombuffer(old[row][0], np.uint8), count=len(ids)).astype(bool)
                        names.append(sorted(found.mark(ids, hit) | set(() if first else old[row][1])))
                        flags.append(hit)
                    rows = part if first else part.select(range(part.num_columns - 2))
                    if last:
                        yield finish(rows, flags, names)
                    else:
                        schema = pa.schema([*rows.schema, *(pa.field(name, kind) for name, kind, _ in state)])
                        yield output_batch(schema, [*rows.columns, [np.packbits(f).tobytes() for f in flags], names])

        between = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, _, kind in state)])
        out = out.mapInArrow(scan, result if following is None else between)
        k += 1
    return out


def contaminated_words(n_words: int, n_hit: int) -> bool:
    """At least one word in twenty was hit."""
    return n_hit > 0 and 20 * n_hit >= n_words


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row per document: counts, a digest of the items that occur, and the verdict."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def digest(rows: pa.RecordBatch, flags: list[np.ndarray], names: list[list[str]]) -> pa.RecordBatch:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                            ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
        hits = [int(f.sum()) for f in flags]
        return output_batch(schema, [rows.column(0), [len(f) for f in flags], hits, [len(n) for n in names],
                                     [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names],
                                     [contaminated_words(len(f), h) for f, h in zip(flags, hits, strict=True)]])

    return _scan(slim, "text", digest, REPORT, benchmark, item, item_text, window, slice_words)


def _without_spans(text: str, hit: np.ndarray) -> str:
    """The text without its hit words; what stands between two hit words goes with them."""
    data, out, at, inside = text_bytes(text), [], 0, False
    for k, m in enumerate(WORD.finditer(data.translate(ASCII_LOWER))):
        if hit[k] and not inside:
            out.append(data[at:m.start()])
        if hit[k]:
            at = m.end()
        inside = bool(hit[k])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with the hit spans cut
    out of contaminated documents (``remove="spans"``). All other rows and columns stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    at = docs.columns.index(text)

    def decide(rows: pa.RecordBatch, flags: list[np.ndarray], names: list[list[str]]) -> pa.RecordBatch:
        bad = [contaminated_words(len(f), int(f.sum())) for f in flags]
        if remove == "documents":
            return rows.filter(pa.array([not b for b in bad], pa.bool_()))
        old = rows.column(at).to_pylist()
        columns = rows.columns
        columns[at] = pa.array([_without_spans(t, f) if b else t for t, f, b in zip(old, flags, bad, strict=True)], columns[at].type)
        return pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return _scan(docs, text, decide, docs.schema, benchmark, item, item_text, window, slice_words)
