"""Search items on plain files: a base plus one small folder per applied batch.

A batch is known by (stream, batch number). It writes only its own net changes, then a commit row
that gives it the next place in the order of all streams; folders without a commit row are not read.
A batch that comes again after its commit changes nothing, and is refused if it holds other changes,
so a stream that was restarted from a new checkpoint needs, and gets, a name of its own. Readers fold
the batches committed after the base; compaction writes the next base. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkseek.operators.index import latest_actions
from larkseek.schemas import ITEM_KEY, SEARCH_ITEMS

_NET = f"{SEARCH_ITEMS}, action string"
_DELTA = f"{_NET}, stream string, batch_id bigint"
_COMMIT = "stream string, batch_id bigint, place bigint, n bigint, digest decimal(38,0)"


class ItemStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the store, empty before anything was written to it."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def generation(self) -> int:
        """Place of the last commit that the visible base includes (-1 for an initial base)."""
        return self._read("pointer", "generation bigint").agg(F.max("generation")).first()[0]

    def create(self, items: DataFrame | None = None) -> ItemStore:
        """Start from the given items, or empty. The path must not hold a store."""
        if self.generation() is not None:
            raise ValueError(f"{self.path} holds a store already")
        self._write_base(self.spark.createDataFrame([], SEARCH_ITEMS) if items is None else items, -1)
        return self

    def _write_base(self, items: DataFrame, generation: int) -> None:
        (items.select(*ITEM_KEY, "title", "subtitle").hint("rebalance").write.mode("overwrite")
         .parquet(f"{self.path}/base/{generation}"))
        self._append("pointer", "generation bigint", (generation,))

    def commits(self) -> DataFrame:
        """One row per applied batch: stream, batch_id, place in the order, and what it held."""
        return self._read("commits", _COMMIT)

    def append_batch(self, actions: DataFrame, batch_id: int, stream: str = "main") -> bool:
        """Write the net effect of a batch of classified events; False if it was applied before."""
        net = latest_actions(actions).select(*ITEM_KEY, "title", "subtitle", "action")
        summary = [F.count("*"), F.coalesce(F.sum(F.xxhash64(*net.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))]
        done = self.commits().where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).first()
        if done is not None:
            if tuple(net.agg(*summary).first()) != (done["n"], done["digest"]):
                raise ValueError(f"batch {batch_id} of {stream} was applied with other changes; name a restarted stream anew")
            return False
        place = self.commits().agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0] + 1
        folder = f"{self.path}/delta/stream={stream}/batch_id={batch_id}"
        net.write.mode("overwrite").parquet(folder)
        n, digest = self.spark.read.schema(_NET).parquet(folder).agg(*summary).first()
        self._append("commits", _COMMIT, (stream, batch_id, place, n, digest))
        return True

    def base(self, generation: int | None = None) -> DataFrame:
        g = self.generation() if generation is None else generation
        return self.spark.read.schema(SEARCH_ITEMS).parquet(f"{self.path}/base/{g}")

    def _current(self, generation: int, upto: int | None) -> DataFrame:
        commits = self.commits().where(F.col("place") > generation)
        if upto is not None:
            commits = commits.where(F.col("place") <= upto)
        deltas = self._read("delta", _DELTA).join(commits.select("stream", "batch_id", "place"), ["stream", "batch_id"])
        last = latest_actions(deltas, ["place"])
        kept = self.base(generation).join(last.select(*ITEM_KEY), ITEM_KEY, "left_anti")
        return kept.unionByName(last.where("action = 'UPSERT'").select(*ITEM_KEY, "title", "subtitle"))

    def current(self) -> DataFrame:
        """The item table after all applied batches."""
        return self._current(self.generation(), None)

    def compact(self) -> int:
        """Write a new base that includes all batches committed so far. Older folders stay for
        readers that still use them; remove them with the storage's own retention."""
        generation = self.generation()
        newest = self.commits().agg(F.max("place")).first()[0]
        if newest is None or newest <= generation:
            return generation
        self._write_base(self._current(generation, newest), newest)
        return newest
