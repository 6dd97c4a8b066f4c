"""Logs of merged runs: what a read opens, crashes between steps, batches that come again."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from statuspulse.sources import runs
from statuspulse.sources.runs import RunTable

SHAPE = "site_id int, ts int, v string"


def test_a_read_opens_few_runs_after_many_batches():
    """Every number of batches: all batches are covered once, by at most 7 runs a level."""
    live: set = set()
    for batch in range(10_000):
        live.add((0, batch))
        level = 1
        while (batch + 1) % 8**level == 0:
            live.add((level, batch // 8**level))
            level += 1
        if batch % 97 == 0 or batch == 9_999:
            needed = runs.cover(live, 8)
            assert len(needed) <= 7 * 5
            assert [b for run in needed for b in runs.span(run, 8)] == list(range(batch + 1))


def _row(spark, site, ts, v):
    return spark.createDataFrame([(site, ts, v)], SHAPE)


def _latest(table):
    return {r.site_id: (r.ts, r.v) for r in table.latest().collect()}


def test_last_written_wins_and_old_runs_go(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), keys=("site_id",), order="ts", fanout=2)
    want = {}
    for batch in range(9):
        site, ts = batch % 3, 100 - batch if batch == 7 else batch  # batch 7 has the greatest ts
        table.append(_row(spark, site, ts, f"b{batch}"), batch)
        if site not in want or (ts, batch) > want[site][:2]:
            want[site] = (ts, batch)
        assert _latest(table) == {s: (t, f"b{b}") for s, (t, b) in want.items()}
    assert runs.cover(table.runs(), 2) == [(3, 0), (0, 8)]
    assert len(table.runs()) <= 8  # those of earlier intervals are removed
    assert table.latest().columns == ["site_id", "ts", "v"]


def test_a_batch_again_and_equal_order(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), keys=("site_id",), order="ts", fanout=2)
    table.append(_row(spark, 1, 5, "first"), 0)
    table.append(_row(spark, 1, 5, "wrong"), 1)
    table.append(_row(spark, 1, 5, "again"), 1)  # the merge of both is written again too
    assert _latest(table) == {1: (5, "again")}
    assert table.read().count() == 1


def test_null_keys_and_orders(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), keys=("site_id",), order="ts", fanout=2)
    rows = [(None, 1, "a"), (None, 2, "b"), (1, None, "c"), (1, 0, None), (2, None, "d")]
    table.append(spark.createDataFrame(rows, SHAPE), 0)
    table.append(spark.createDataFrame([], SHAPE), 1)
    assert _latest(table) == {None: (2, "b"), 1: (0, None), 2: (None, "d")}


@pytest.mark.parametrize("step", ["before the merge", "within the merge", "within the removal"])
def test_crash_between_two_steps(spark, tmp_path, monkeypatch, step):
    table = RunTable(spark, str(tmp_path / "t"), fanout=2)
    for batch in range(3):
        table.append(_row(spark, batch, batch, "x"), batch)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        if step == "before the merge":
            patched.setattr(RunTable, "merge", fail)
        elif step == "within the merge":
            patched.setattr(RunTable, "_rows", fail)
        else:
            patched.setattr(RunTable, "_remove", fail)
        with pytest.raises(RuntimeError):
            table.append(_row(spark, 3, 3, "x"), 3)
    (tmp_path / "t" / "level=1" / "run=9").mkdir(parents=True)  # begun, never ended
    assert sorted(r.site_id for r in table.read().collect()) == [0, 1, 2, 3]
    table.append(_row(spark, 3, 3, "x"), 3)
    table.append(_row(spark, 4, 4, "x"), 4)
    assert sorted(r.site_id for r in table.read().collect()) == [0, 1, 2, 3, 4]
    assert runs.cover(table.runs(), 2) == [(2, 0), (0, 4)]


def test_a_reader_that_began_before_a_merge_ends(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), fanout=2)
    table.append(_row(spark, 0, 0, "x"), 0)
    begun = table.read()
    table.append(_row(spark, 1, 1, "x"), 1)  # merges, and keeps what begun reads
    assert begun.count() == 1 and table.read().count() == 2


def test_empty_table(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "none"), keys=("site_id",), order="ts")
    assert table.latest(SHAPE).collect() == [] and table.read(SHAPE).columns[-1] == "batch"
    with pytest.raises((FileNotFoundError, PySparkException)):
        table.latest()


def test_settling_with_numbers_left_out(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), keys=("site_id",), fanout=2)
    for batch in (1, 4, 6, 9, 12):
        table.write(_row(spark, batch % 2, batch, f"b{batch}"), batch)
        if batch != 6:  # a batch that nothing settled after
            table.settle(batch)
        assert {r.v for r in table.read().collect()} >= {f"b{batch}"}
    assert _latest(table) == {0: (12, "b12"), 1: (9, "b9")}
    assert runs.cover(table.runs(), 2) == [(3, 0), (2, 2), (0, 12)]
    found = table.runs()
    table.settle(12)
    assert table.runs() == found


def test_a_merge_of_sums(spark, tmp_path):
    def summed(rows):
        return rows.groupBy("site_id").agg(F.sum("ts").alias("ts"), F.max("v").alias("v"), F.max("batch").alias("batch"))

    table = RunTable(spark, str(tmp_path / "t"), fanout=2, reduce=summed)
    for batch in range(5):
        table.append(_row(spark, batch % 2, batch, f"b{batch}"), batch)
    assert sorted(tuple(r) for r in table.read().collect()) == [(0, 2, "b2", 2), (0, 4, "b4", 4), (1, 4, "b3", 3)]
