import os
import sqlite3
import threading
import time

import pytest
from pyspark.sql import functions as F

from docweave import session
from docweave.api import Client
from docweave.errors import ConfigurationError, DuplicateKeyError, OperationFailure
from docweave.functions import ejson
from docweave.functions.order import sort_key
from docweave.sources.store import FlatFileStore, SnapshotStore, SqliteStore


def rows(spark, ids, start):
    return spark.createDataFrame([(start + n, sort_key(i), ejson.dumps({"_id": i})) for n, i in enumerate(ids)], "seq long, id_key binary, doc string")


def ids(df):
    return [ejson.loads(r.doc)["_id"] for r in df.orderBy("seq").collect()]


def test_two_writers_lose_nothing(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    store.create("d", "c")
    errors = []

    def write(n):
        try:
            store.append("d", "c", rows(spark, [f"{n}a", f"{n}b"], store.next_seq("d", "c")))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    held = store.load("d", "c")
    assert not errors and sorted(ids(held)) == sorted(f"{n}{x}" for n in range(4) for x in "ab")
    assert held.select("seq").distinct().count() == 8 and store.next_seq("d", "c") == 9


def interleaved(store, monkeypatch, other):
    """Let ``other`` commit between the next reading of the manifest and its commit."""
    own, done = store.files.create_text, []

    def create(path, text):
        if not done:
            done.append(1)
            other()
        return own(path, text)

    monkeypatch.setattr(store.files, "create_text", create)


def test_commits_from_one_manifest(spark, tmp_path, monkeypatch):
    a, b = (SnapshotStore(spark, f"file://{tmp_path}") for _ in range(2))
    a.append("d", "c", rows(spark, [1], 1))
    interleaved(a, monkeypatch, lambda: b.append("d", "c", rows(spark, [2], 2)))
    a.append("d", "c", rows(spark, [3, 4], 2))
    assert ids(a.load("d", "c")) == [1, 2, 3, 4] and a.next_seq("d", "c") == 5


def test_the_same_key_by_two_writers(spark, tmp_path, monkeypatch):
    a, b = (SnapshotStore(spark, f"file://{tmp_path}") for _ in range(2))
    a.append("d", "c", rows(spark, [1], 1))
    interleaved(a, monkeypatch, lambda: b.append("d", "c", rows(spark, [2], 2)))
    with pytest.raises(DuplicateKeyError):
        a.append("d", "c", rows(spark, [2], 2))
    assert ids(b.load("d", "c")) == [1, 2]


def test_two_changes_of_the_same_rows(spark, tmp_path, monkeypatch):
    a, b = (SnapshotStore(spark, f"file://{tmp_path}") for _ in range(2))
    a.append("d", "c", rows(spark, [1, 2], 1))
    a.append("d", "c", rows(spark, [3], 3))

    def change(store, seq, new):
        made = store.load("d", "c").withColumn("doc", F.when(F.col("seq") == seq, f'{{"_id":{new}}}').otherwise(F.col("doc")))
        store.rewrite("d", "c", made, rows(spark, [0], seq).select("seq"), store.version("d", "c"))

    interleaved(a, monkeypatch, lambda: change(b, 1, 10))
    change(a, 3, 30)  # another part: both stay
    assert ids(a.load("d", "c")) == [10, 2, 30]
    monkeypatch.undo()
    interleaved(a, monkeypatch, lambda: change(b, 1, 11))
    with pytest.raises(OperationFailure) as e:
        change(a, 2, 20)
    assert e.value.code == 112 and ids(b.load("d", "c")) == [11, 2, 30]


def test_open_readers_and_sweeping(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    store.append("d", "c", rows(spark, [1, 2], 1))
    frame = store.load("d", "c")
    store.replace("d", "c", rows(spark, [7], 3))
    assert ids(frame) == [1, 2] and ids(store.load("d", "c")) == [7]
    time.sleep(0.05)
    store.compact("d", "c", keep=0.0)
    assert ids(store.load("d", "c")) == [7]
    assert len(store.files.directories(f"file://{tmp_path}/d/c")) == 1 and len(store._numbers(f"file://{tmp_path}/d/c")) == 1


def test_a_manifest_being_written_is_passed_over(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    store.append("d", "c", rows(spark, [1], 1))
    with open(f"{tmp_path}/d/c/m000000002.json", "w") as out:
        out.write('{"parts"')
    assert ids(store.load("d", "c")) == [1]


def test_flatfile_appends(spark, tmp_path):
    store = FlatFileStore(spark, str(tmp_path))
    store.create("d", "c")
    for n in range(3):
        store.append("d", "c", rows(spark, [10 * n, 10 * n + 1], 1))
    path = f"{tmp_path}/d/c.json"
    assert ids(store.load("d", "c")) == [0, 1, 10, 11, 20, 21] == [d["_id"] for d in ejson.loads(open(path).read())]
    with open(path, "w") as out:
        out.write('[{"_id": 5}]   \n\n')
    store.append("d", "c", rows(spark, [6], 2))
    assert ids(store.load("d", "c")) == [5, 6] and os.listdir(f"{tmp_path}/d") == ["c.json"]


def test_sqlite_replace_streams(spark, tmp_path, monkeypatch):
    store = SqliteStore(spark, str(tmp_path))
    store.append("d", "c", rows(spark, [1, 2, 3], 1))
    kept = store.load("d", "c").where("doc NOT LIKE '%2%'")
    monkeypatch.setattr(type(kept), "collect", lambda self: pytest.fail("the collection was collected"))
    store.replace("d", "c", kept)
    monkeypatch.undo()
    assert ids(store.load("d", "c")) == [1, 3] and store.collections("d") == ["c"]
    with sqlite3.connect(f"{tmp_path}/d/c.collection") as c:
        assert c.execute("SELECT count(*) FROM documents").fetchone() == (2,)


def test_sqlite_write_concern(spark, tmp_path):
    with Client(str(tmp_path), spark=spark, storage="sqlite", wtimeout=200, journal_mode="wal", synchronous="off") as client:
        client.shop.items.insert_one({"_id": 1})
        with sqlite3.connect(f"{tmp_path}/shop/items.collection") as c:
            assert c.execute("PRAGMA journal_mode").fetchone() == ("wal",)
            c.execute("BEGIN EXCLUSIVE")
            began = time.time()
            with pytest.raises(sqlite3.OperationalError):
                client.store.append("shop", "items", rows(spark, [2], 2))
            assert time.time() - began < 30
        client.shop.items.update_many({}, {"$set": {"a": 1}})
        assert list(client.shop.items.find()) == [{"_id": 1, "a": 1}]
    with pytest.raises(ConfigurationError), Client(str(tmp_path), spark=spark, storage="sqlite", synchronous="sometimes") as client:
        client.shop.items.insert_one({"_id": 3})


def test_staged_results_are_deleted(spark, tmp_path):
    before = len(session._STAGED)
    with session.scratch():
        kept = session.staged(spark.range(5), "one")
        assert kept.count() == 5 and os.path.exists(kept._staged_at.removeprefix("file://"))
        other = session.staged(spark.range(3), "two")
        session.release(kept)
        assert not os.path.exists(kept._staged_at.removeprefix("file://")) and other.count() == 3
    assert len(session._STAGED) == before and not os.path.exists(other._staged_at.removeprefix("file://"))


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)}))}))

    fake = type("S", (), {"conf": {}, "sparkContext": Context})
    with pytest.raises(ConfigurationError):
        session.shared_dir(fake)


def test_collection_keeps_frames_readable(spark, tmp_path):
    with Client(f"file://{tmp_path}/r", spark=spark) as client:
        items = client.shop.items
        items.insert_many([{"_id": n, "a": n} for n in range(5)])
        frame = items.frame()
        items.update_many({"a": {"$gt": 2}}, {"$set": {"a": 0}})
        assert sorted(ejson.loads(r.doc)["a"] for r in frame.collect()) == [0, 1, 2, 3, 4]
        assert sorted(d["a"] for d in items.find()) == [0, 0, 0, 1, 2]
