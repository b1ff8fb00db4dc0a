"""Log-structured state against latest-wins by plain code."""

import random

import pytest

from tidewarden.streaming import keyed_state
from tidewarden.streaming.keyed_state import KeyedState

SCHEMA = "source string, stage string, record_key string, fingerprint string, processed_at bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted(map(str, (tuple(r) for r in df.select("source", "stage", "record_key", "fingerprint", "processed_at").collect())))


def latest(*batches):
    state = {}
    for n, batch in enumerate(batches):
        for row in batch:
            rank = (row[4] if row[4] is not None else -(10**18), n, row[3] or "")
            if row[:3] not in state or rank >= state[row[:3]][0]:
                state[row[:3]] = rank, row
    return sorted(str(r) for _, r in state.values())


def batch(seed, n, keys):
    rnd = random.Random(seed)
    return [("s", rnd.choice(["a", "b", None]), f"k{rnd.randrange(keys)}", f"f{rnd.randrange(5)}", rnd.randrange(50)) for _ in range(n)]


def test_latest_row_of_each_key_over_batches_restarts_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_state, "MAX_RUNS", 3)
    path, batches = str(tmp_path / "state"), []
    for i in range(6):
        batches.append(batch(i, 60, 40))
        state = KeyedState(spark, path, SCHEMA, buckets=4)  # as after a restart
        state.upsert(frame(spark, batches[-1]))
        assert got(state.read()) == latest(*batches)
        assert len(state.manifest()["runs"]) <= 4
    state.upsert(frame(spark, batches[-1]))  # a batch that comes again
    assert got(state.read()) == latest(*batches)
    state.compact(), state.compact()
    assert got(KeyedState(spark, path, SCHEMA).read()) == latest(*batches)
    assert state.vacuum() > 0 and got(state.read()) == latest(*batches) and state.vacuum() == 0


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "state"), SCHEMA, buckets=4)
    state.upsert(frame(spark, [("s", "a", f"k{i}", "f", 1) for i in range(5000)]))
    state.upsert(frame(spark, [("s", "a", f"k{i}", "g", 2) for i in range(50)]))
    assert [r["rows"] for r in state.manifest()["runs"]] == [5000, 50]
    assert state.read().where("fingerprint = 'g'").count() == 50 and state.read().count() == 5000
    state.compact()  # 50 are less than half: the large run stays as it is
    assert [r["rows"] for r in state.manifest()["runs"]] == [5000, 50]
    state.upsert(frame(spark, [("s", "a", f"k{i}", "h", 3) for i in range(4000)]))
    state.compact()
    assert [r["rows"] for r in state.manifest()["runs"]] == [5000] and state.read().columns == state.columns


def test_lookup_reads_only_files_that_may_have_a_key(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "state"), SCHEMA, buckets=8)
    state.upsert(frame(spark, [("s", "a", f"k{i}", "f", 1) for i in range(400)]))
    state.upsert(frame(spark, [("s", None, f"n{i}", "f", 1) for i in range(400)]))
    asked = frame(spark, [("s", None, "n7", "x", 0), ("s", "a", "missing", "x", 0)])
    files = state.files_for(asked)
    assert sum(map(len, files.values())) <= 3  # of 16; one is right, others are false alarms
    assert got(state.lookup(asked)) == [str(("s", None, "n7", "f", 1))]
    assert got(state.changed(asked)) == got(asked)
    assert got(state.changed(frame(spark, [("s", None, "n7", "f", 9)]))) == []


def test_empty_batches_and_states(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "state"), SCHEMA)
    state.upsert(frame(spark, []).limit(0))
    assert state.manifest() is None and state.read().count() == 0
    assert state.lookup(frame(spark, [("s", "a", "b", "c", 1)])).count() == 0
    state.upsert(frame(spark, [(None, None, None, None, None)] * 3))
    assert got(state.read()) == [str((None,) * 5)]


def test_two_writers_clash(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "state"), SCHEMA)
    state.upsert(frame(spark, [("s", "a", "b", "c", 1)]))
    before = state.manifest()
    state.upsert(frame(spark, [("s", "a", "b", "d", 2)]))
    with pytest.raises(RuntimeError):
        state._commit(before, before["runs"])
    assert got(state.read()) == [str(("s", "a", "b", "d", 2))]
