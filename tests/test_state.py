import os

import pytest

from rolecast.engine import Engine
from rolecast.operators import ops
from rolecast.sources.sinks import push
from rolecast.sources.state import Conflict, Store
from rolecast.streaming.snapshots import SnapshotState


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def keys(store, name="a"):
    return sorted(r.key for r in store.read(name, "key string").collect())


def test_tables_change_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    assert keys(store) == [] and store.version()["notes"] == {}
    store.commit({"batch": 1}, a=frame(spark, "x"), b=frame(spark, "y"))
    store.commit(a=store.read("a", "key string").union(frame(spark, "z")))  # made from itself
    assert keys(store) == ["x", "z"] and keys(store, "b") == ["y"] and store.version()["notes"] == {"batch": 1}
    # a crash after the tables are written, and one before the version is put in its place
    left = store.write({"a": frame(spark, "lost"), "b": frame(spark)})
    assert keys(store) == ["x", "z"] and keys(store, "b") == ["y"]
    (tmp_path / "state" / "versions" / ".half").write_text('{"tables"')
    assert keys(store) == ["x", "z"]
    store.publish(left)
    assert keys(store) == ["lost"] and keys(store, "b") == []
    for i in range(4):  # what no kept version names goes
        store.commit(a=frame(spark, str(i)))
    assert keys(store) == ["3"] and len(os.listdir(tmp_path / "state" / "a")) == 2 and store.versions() == [6, 7]


def test_a_version_is_committed_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "state"))
    store.commit(a=frame(spark, "x"))
    other = store.write({"a": frame(spark, "other")})
    monkeypatch.setattr(Store, "versions", lambda self: [])  # as seen before the first commit
    with pytest.raises(Conflict):
        store.publish(other)
    monkeypatch.undo()
    assert keys(store) == ["x"]


def test_a_stream_stopped_before_its_commit_folds_again(spark, tmp_path, monkeypatch):
    state = SnapshotState(spark, str(tmp_path / "state"))
    result = "key string, provider string, identifier string, status string, job_count bigint, synced_at string, error string, round int"
    job = "key string, source_id string, board_key string, title string, location string, synced_at string, ord int, round int"
    t = "2026-07-20T00:00:00.000Z"

    def split(rows):
        return spark.createDataFrame([("b:1", "1", "b", "Cook", "x", t, 0, 1)], job), spark.createDataFrame([("b", "lever", "b", "active", 1, t, None, 1)], result)

    def crash(self, folders, notes=None):
        raise RuntimeError("stopped")

    monkeypatch.setattr(Store, "publish", crash)
    with pytest.raises(RuntimeError):
        state.batch(split)(None, 0)
    assert state.jobs().count() == 0 and state.done() == -1
    monkeypatch.undo()
    for _ in range(2):  # the second time it is known
        state.batch(split)(None, 0)
        assert state.jobs().count() == 1 and state.boards().count() == 1 and state.done() == 0
    assert state.store.versions() == [1]


def test_only_archived_postings_leave_the_state(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "state"))
    names = engine.table("jobs").columns
    old = [{"key": f"k{i}", "closed_at": "2026-01-01T00:00:00.000Z", "is_active": 0, "title": "t", "provider": "lever"} for i in range(3)]
    live = [{"key": "live", "closed_at": None, "is_active": 1, "title": "t", "provider": "lever"}]
    engine.save(jobs=spark.createDataFrame([tuple(r.get(n) for n in names) for r in old + live], engine.table("jobs").schema))
    monkeypatch.setattr(ops, "write_archive", lambda rows, path: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError):
        engine.run_maintenance("2026-07-20T00:00:00.000Z")
    assert engine.table("jobs").count() == 4
    monkeypatch.undo()
    few = ops.archive_rows
    monkeypatch.setattr(ops, "archive_rows", lambda jobs, now: few(jobs, now, most=2))
    engine.run_maintenance("2026-07-20T00:00:00.000Z")
    assert sorted(r.key for r in engine.table("jobs").collect()) == ["k2", "live"]
    assert sorted(r.key for r in spark.read.json(str(tmp_path / "state" / "archive")).collect()) == ["k0", "k1"]


TRIES = {}


def post(rows):
    """Fails once for the row "later", always for "never", is refused for "bad"."""
    name = rows[0]["key"]
    TRIES[name] = TRIES.get(name, 0) + 1
    if name == "later" and TRIES[name] == 1 or name == "never":
        return 503
    if name == "lost" and TRIES[name] == 1:
        raise ConnectionError
    return 422 if name == "bad" else None


def test_pushes_are_tried_again(spark):
    rows = frame(spark, "fine", "later", "never", "lost", "bad").coalesce(1)
    assert push(rows, "tests.test_state:post", size=1, retries=2, wait=0.01).first().asDict() == {"sent": 3, "failed": 2}
