"""The bounded, id-ordered poll of an outbox table."""

import datetime as dt

from larkseek.schemas import OUTBOX
from larkseek.sources import outbox_poll
from larkseek.sources.outbox_poll import OutboxDrain, OutboxPoller, polled_outbox
from larkseek.streaming.outbox_stream import start_outbox_stream

T0 = dt.datetime(2024, 1, 1)


def row(i, kind="CONTACT", published=False):
    return (i, "t", kind, str(i), "x", f"payload {i}", T0, published, None)


def append(spark, path, rows, files=1):
    spark.createDataFrame(rows, OUTBOX).repartition(files).write.mode("append").parquet(path)


def polls(reader, after=None):
    out, at = [], {"after": after}
    while True:
        got, end = reader.read(at)
        got = [r[0] for r in got]
        if not got:
            return out
        assert end == {"after": got[-1]}
        assert [r[0] for r in reader.readBetweenOffsets(at, end)] == got
        out, at = [*out, got], end


def reader(path, rows):
    return OutboxPoller(path, rows, [c.strip().split(" ")[0] for c in OUTBOX.split(",")])


def test_polls_are_bounded_and_ordered_over_many_files(spark, tmp_path):
    """Ids lie scattered over files; published rows and rows without an id are left out."""
    path = str(tmp_path / "box")
    append(spark, path, [row(i, published=i % 5 == 0) for i in range(-20, 200)] + [row(None)], files=7)
    wanted = [i for i in range(-20, 200) if i % 5]
    got = polls(reader(path, 7))
    assert [i for g in got for i in g] == wanted and all(len(g) == 7 for g in got[:-1])
    assert [i for g in polls(reader(f"file://{path}", 1000), after=100) for i in g] == [i for i in wanted if i > 100]


def test_rows_are_read_whole_and_appended_files_are_found(spark, tmp_path):
    path = str(tmp_path / "box")
    r = reader(path, 10)
    assert polls(r) == [] and list(r.readBetweenOffsets({"after": None}, {"after": None})) == []
    append(spark, path, [row(1)])
    got, end = r.read({"after": None})
    assert [x[:6] for x in got] == [row(1)[:6]] and end == {"after": 1}
    append(spark, path, [row(3), row(2)])
    assert polls(r, after=1) == [[2, 3]]
    # a batch planned before a restart is read again by a new reader
    assert [x[0] for x in reader(path, 10).readBetweenOffsets({"after": 1}, {"after": 2})] == [2]


def test_passed_row_groups_are_let_go(spark, tmp_path):
    path = str(tmp_path / "box")
    for k in range(4):
        append(spark, path, [row(i) for i in range(10 * k, 10 * k + 10)])
    r = reader(path, 5)
    held = []
    at = {"after": None}
    for _ in range(9):
        _, at = r.read(at)
        held.append((len(r.groups), sum(g[3] is not None for g in r.groups)))
    assert held[0] == (4, 1) and max(h[1] for h in held) <= 2 and held[-1] == (0, 0)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """A publisher that fails once gets the same rows again; nothing is lost or out of order."""
    path, batches, fail = str(tmp_path / "box"), [], [True]
    append(spark, path, [row(i, "CAMPAIGN" if i == 4 else "LISTING") for i in range(1, 12)], files=3)

    def publish(good):
        rows = [(r.id, r.key, r.value) for r in good.collect()]
        if rows[0][0] == 5 and fail and fail.pop():
            raise RuntimeError("broker away")
        batches.append(rows)

    def run():
        q = start_outbox_stream(polled_outbox(spark, path, rows=4), str(tmp_path / "out"), str(tmp_path / "cp"), publish)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    try:
        run()
        raise AssertionError("the failure was swallowed")
    except Exception as e:
        assert "broker away" in str(e)
    run()
    append(spark, path, [row(i) for i in (20, 21)])
    run()
    assert [[r[0] for r in b] for b in batches] == [[1, 2, 3], [5, 6, 7, 8], [9, 10, 11], [20, 21]]
    assert batches[0][0] == (1, "t:1", "payload 1")
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == [4]


def test_a_backlog_is_drained_by_many_polls_a_batch(spark, tmp_path):
    """Polls keep their rows and order; a batch takes several, and a rejected row has its poll too."""
    path, out = str(tmp_path / "box"), str(tmp_path / "out")
    append(spark, path, [row(i, "CAMPAIGN" if i == 4 else "LISTING") for i in range(1, 24)], files=3)
    q = start_outbox_stream(polled_outbox(spark, path, rows=4, polls=3), out, str(tmp_path / "cp"), poll_rows=4)
    q.processAllAvailable()
    q.stop()
    sent = [(r.id, r.batch_id, r.poll) for kind in ("topics", "rejected") for r in spark.read.parquet(f"{out}/{kind}").collect()]
    assert sorted(sent) == [(i, (i - 1) // 12, (i - 1) % 12 // 4) for i in range(1, 24)]


def drain(path, rows, polls):
    return OutboxDrain(path, rows, polls, [*[c.strip().split(" ")[0] for c in OUTBOX.split(",")], "poll"])


def drained(reader):
    """(id, poll) of every batch, read task by task, and the ids the batches end at."""
    out, at = [], reader.initialOffset()
    while True:
        end = reader.latestOffset()
        if end == at:
            return out
        parts = reader.partitions(at, end)
        out.append(sorted((r["id"], r["poll"]) for p in parts for b in reader.read(p) for r in b.to_pylist()))
        # a new reader reads the same between the same ids, and goes on after them
        again = drain(reader.path, reader.rows, reader.polls)
        assert again.partitions(end, end) == [] and again.at == end
        assert sorted((r["id"], r["poll"]) for p in again.partitions(at, end) for b in again.read(p) for r in b.to_pylist()) == out[-1]
        at = end


def test_a_backlog_is_read_by_tasks_poll_by_poll(spark, tmp_path, monkeypatch):
    """Ids scattered over files or in order: the same rows and polls, and no row is read on the driver."""
    monkeypatch.setattr(outbox_poll, "TASK_ROWS", 10)
    ids = [i for i in range(-20, 200) if i % 5]
    want = [[(i, k // 7) for k, i in enumerate(ids[at:at + 21])] for at in range(0, len(ids), 21)]
    scattered, ordered = str(tmp_path / "a"), str(tmp_path / "b")
    rows = [row(i, published=i % 5 == 0) for i in range(-20, 200)] + [row(None)]
    append(spark, scattered, rows, files=7)
    for k in range(0, 220, 10):
        append(spark, ordered, rows[k:k + 10])
    for path in (scattered, f"file://{ordered}"):
        r = drain(path, 7, 3)
        assert drained(r) == want
    r = drain(ordered, 7, 3)
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    assert len(parts) == 2 and sum(g[3] is not None for g in r.groups) <= 4
    assert all(len(part) == 4 for p in parts for part in p.value[2])


def test_repeated_ids_are_drained_together(spark, tmp_path):
    path = str(tmp_path / "box")
    append(spark, path, [row(i) for i in (1, 2, 2, 3, 4)])
    append(spark, path, [row(i) for i in (4, 4, 5)])
    assert drained(drain(path, 2, 2)) == [[(1, 0), (2, 0), (2, 1), (3, 1)], [(4, 0), (4, 0), (4, 1), (5, 1)]]
    # a batch that ends in a repeated id has one more poll
    assert drained(drain(path, 5, 1)) == [[(1, 0), (2, 0), (2, 0), (3, 0), (4, 0), (4, 1), (4, 1)], [(5, 0)]]
