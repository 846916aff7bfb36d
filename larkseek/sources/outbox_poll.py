"""A streaming source that polls an outbox table in id order, a bounded number of rows a batch.

A batch is one poll, or up to ``polls`` of them to drain a backlog: a batch costs seconds whatever
its rows. Its offset is the last id taken, so the checkpoint of the query is the published mark: a restarted
query goes on after it, and a batch that was planned but not finished is read again between the same
ids. Every poll takes at most ``rows`` rows, oldest first. The rows of one poll are read where the offsets
are; of a backlog only the ids are, by which polls are told apart, and tasks read the rows (:class:`OutboxDrain`).

The table is parquet files that writers append to. The smallest and largest id of each row group come
from the files' footers, each read once; a poll opens only the row groups that can hold the next ids
and keeps what it read of them until their ids have passed, so no row group is read twice. Writers
give ids that grow over time (:func:`larkseek.operators.outbox.append`); an id that appears after a
later one was taken is not seen. Rows without an id, and published ones, are never taken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import PySparkNotImplementedError
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from larkseek.operators.outbox import POLL_ROWS
from larkseek.schemas import OUTBOX

FORMAT = "outbox_poll"
# Row groups are put together until a task of a backlog has so many rows.
TASK_ROWS = 50_000


def _filesystem(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _unpublished(part, columns: list[str], after: int | None, upto: int | None = None):
    """The unpublished rows with after < id <= upto of a row group as an Arrow table in id order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    wanted = pc.field("id").is_valid() & ~pc.field("published")
    if after is not None:
        wanted &= pc.field("id") > after
    if upto is not None:
        wanted &= pc.field("id") <= upto
    table = part.to_table(columns=columns, filter=wanted).sort_by("id")
    # stored times are UTC, in whatever unit the writer chose
    utc = [table[c].cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(table[c].type) else table[c] for c in columns]
    return pa.table(utc, names=columns)


class _RowGroups:
    """The row groups of an outbox table that may hold ids to come."""

    def __init__(self, path: str, rows: int, columns: list[str]):
        self.path, self.rows, self.columns = path, rows, columns
        self.seen: set[str] = set()
        self.groups: list = []

    def initialOffset(self) -> dict:
        return {"after": None}

    def _find_groups(self) -> None:
        """Add (smallest id, largest id, row group, rows once read) of files that are new."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        where, path = _filesystem(self.path)
        new = [f.path for f in where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
               if f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")) and "/_" not in f.path[len(path):] and f.path not in self.seen]
        for fragment in ds.dataset(new, filesystem=where, format="parquet").get_fragments() if new else ():
            footer = fragment.metadata
            at = footer.schema.names.index("id")
            for part in fragment.split_by_row_group():
                ids = footer.row_group(part.row_groups[0].id).column(at).statistics
                # without statistics the row group has only null ids, or its writer kept none
                known = ids is not None and ids.has_min_max
                self.groups.append([ids.min if known else None, ids.max if known else None, part, None])
        self.seen.update(new)

    def _ordered(self, after: int | None) -> list[list]:
        """The row groups with ids after ``after`` by their smallest id, unknown ones first; passed ones are let go."""
        if after is not None:
            self.groups = [g for g in self.groups if g[1] is None or g[1] > after]
        return sorted(self.groups, key=lambda g: (g[0] is not None, g[0]))


class OutboxPoller(_RowGroups, SimpleDataSourceStreamReader):
    """One poll a batch, its rows read on the driver."""

    def _rows_of(self, group: list, after: int | None):
        """The unpublished rows of a row group as an Arrow table in id order, and their ids."""
        if group[3] is None:
            table = _unpublished(group[2], self.columns, after).combine_chunks()
            group[3] = (table, table["id"].to_numpy())
        return group[3]

    def _between(self, after: int | None, upto: int | None, most: int | None) -> list[tuple]:
        """Rows with after < id <= upto in id order, the first ``most`` of them. Only they are made
        Python rows; a row group is searched, not walked through, for its share."""
        at = self.columns.index("id")
        out: list[tuple] = []
        for group in self._ordered(after):
            low = group[0]
            if low is not None and (upto is not None and low > upto or most is not None and len(out) >= most and out[most - 1][at] <= low):
                break
            table, ids = self._rows_of(group, after)
            first = 0 if after is None else int(ids.searchsorted(after, "right"))
            end = len(ids) if upto is None else int(ids.searchsorted(upto, "right"))
            part = table.slice(first, max(0, end - first if most is None else min(most, end - first)))
            out += zip(*[part[c].to_pylist() for c in self.columns], strict=True)
            out.sort(key=lambda r: r[at])
            out = out if most is None else out[:most]
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._find_groups()
        rows = self._between(start["after"], None, self.rows)
        return iter(rows), {"after": rows[-1][self.columns.index("id")] if rows else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if end["after"] is None:
            return iter(())
        self._find_groups()
        return iter(self._between(start["after"], end["after"], None))


class OutboxDrain(_RowGroups, DataSourceStreamReader):
    """Up to ``polls`` polls a batch. The driver holds the ids of the row groups that a batch opens, not their rows: they
    give the last id of the batch and, for each row group, how many of its rows belong to which poll. Tasks read the rows.
    Rows of the batch's last id are taken together, so if the id is repeated the batch may have one more poll, a short one."""

    def __init__(self, path: str, rows: int, polls: int, columns: list[str]):
        super().__init__(path, rows, columns)
        self.polls, self.at = polls, None

    def _ids(self, after: int | None, upto: int | None, most: int | None) -> list[tuple]:
        """(row group, its ids with after < id <= upto in order) of the row groups that have some; with ``most``, at least
        those that hold the first ``most`` ids."""
        out, total = [], 0
        for group in self._ordered(after):
            low = group[0]
            if low is not None and (upto is not None and low > upto or most is not None and total >= most
                                    and sum(int(ids.searchsorted(low)) for _, ids in out) >= most):
                break
            if group[3] is None:
                group[3] = _unpublished(group[2], ["id", "published"], after)["id"].to_numpy()
            ids = group[3]
            ids = ids[0 if after is None else ids.searchsorted(after, "right"):len(ids) if upto is None else ids.searchsorted(upto, "right")]
            if len(ids):
                out.append((group, ids))
                total += len(ids)
        return out

    def latestOffset(self) -> dict:
        import numpy as np

        start = self.at or self.initialOffset()
        self._find_groups()
        most = self.rows * self.polls
        found = self._ids(start["after"], None, most)
        if found:
            ids = np.concatenate([i for _, i in found])
            at = min(most, len(ids)) - 1
            start = {"after": int(np.partition(ids, at)[at])}
        self.at = start
        return start

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        import numpy as np

        if self.at is None:
            # a restarted query names where it stands by an empty batch
            self.at = end
        if end["after"] is None or start == end:
            return []
        self._find_groups()
        found = self._ids(start["after"], end["after"], None)
        places = np.empty(sum(len(i) for _, i in found), "int64")
        places[np.concatenate([i for _, i in found]).argsort(kind="stable") if found else []] = np.arange(len(places))
        tasks, task, taken, begin = [], [], 0, 0
        for group, ids in found:
            polls, counts = np.unique(places[begin:begin + len(ids)] // self.rows, return_counts=True)
            task.append((group[2].path, [g.id for g in group[2].row_groups], polls.astype("int32"), counts))
            begin, taken = begin + len(ids), taken + len(ids)
            if taken >= TASK_ROWS:
                tasks, task, taken = [*tasks, task], [], 0
        return [InputPartition((start["after"], end["after"], t)) for t in [*tasks, task] if t]

    def read(self, partition: InputPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as ds

        after, upto, parts = partition.value
        where, _ = _filesystem(self.path)
        names = [c for c in self.columns if c != "poll"]
        for path, groups, polls, counts in parts:
            table = _unpublished(ds.ParquetFileFormat().make_fragment(path, where, row_groups=groups), names, after, upto)
            # a row group's ids ascend, and so do the polls they belong to
            yield from table.append_column("poll", pa.array(np.repeat(polls, counts))).select(self.columns).to_batches(10_000)


class OutboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return OUTBOX if self._polls() == 1 else f"{OUTBOX}, poll int"

    def _polls(self) -> int:
        return int(self.options.get("polls", 1))

    def _rows(self) -> int:
        return int(self.options.get("rows", POLL_ROWS))

    def streamReader(self, schema: StructType) -> OutboxDrain:
        if self._polls() == 1:
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "tasks for a single poll"})
        return OutboxDrain(self.options["path"], self._rows(), self._polls(), schema.fieldNames())

    def simpleStreamReader(self, schema: StructType) -> OutboxPoller:
        return OutboxPoller(self.options["path"], self._rows(), schema.fieldNames())


def polled_outbox(spark: SparkSession, path: str, rows: int = POLL_ROWS, polls: int = 1) -> DataFrame:
    """Stream of the unpublished rows of the outbox table at ``path``, up to ``polls`` polls a batch; if several, ``poll``
    is the number of a row's poll in its batch, from 0."""
    spark.dataSource.register(OutboxSource)
    return spark.readStream.format(FORMAT).option("path", path).option("rows", str(rows)).option("polls", str(polls)).load()


# The source's worker may not have this package on its path; ship it by value.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
