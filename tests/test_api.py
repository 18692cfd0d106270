import datetime
import json
import sqlite3

import pytest

from docweave.api import Client, QueryList
from docweave.api.collection import ReturnDocument
from docweave.api.configure import open_repo, set_storage
from docweave.errors import BulkWriteError, CollectionInvalid, ConfigurationError, DuplicateKeyError, InvalidDocument, InvalidName, InvalidOperation, OperationFailure, WriteError
from docweave.functions import bson, ejson
from docweave.functions.bsontypes import Binary, Code, Decimal128, Int64, MaxKey, MinKey, ObjectId, Regex, Timestamp
from docweave.functions.order import sort_key
from docweave.sources import sqlite, transfer


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    with Client(str(tmp_path_factory.mktemp("repo")), spark=spark) as c:
        yield c


def test_crud(client):
    coll = client.shop.items
    assert coll.insert_one({"_id": 1, "a": 3, "t": [1, 5]}).inserted_id == 1
    with pytest.raises(DuplicateKeyError):
        coll.insert_one({"_id": 1.0})
    with pytest.raises(InvalidDocument):
        coll.insert_one({"x.y": 1})
    coll.insert_many([{"_id": n, "a": n % 3, "b": {"c": n}} for n in range(2, 8)])
    with pytest.raises(BulkWriteError) as e:
        coll.insert_many([{"_id": 20}, {"_id": 1}, {"_id": 21}])
    assert e.value.details["nInserted"] == 1 and coll.count_documents({"_id": {"$gte": 20}}) == 1
    with pytest.raises(BulkWriteError) as e:
        coll.insert_many([{"_id": 30}, {"_id": 1}, {"_id": 31}], ordered=False)
    assert e.value.details["nInserted"] == 2
    assert [d["_id"] for d in coll.find({"a": 0}).sort("_id", -1)] == [6, 3]
    assert [d["_id"] for d in coll.find().skip(1).limit(3)] == [2, 3, 4]
    assert coll.find_one(5, {"b.c": 1}) == {"_id": 5, "b": {"c": 5}}
    assert coll.find()[2]["_id"] == 3 and [d["_id"] for d in coll.find()[1:3]] == [2, 3]
    assert coll.distinct("a") == [0, 1, 2, 3] and coll.distinct("t") == [1, 5]
    assert coll.distinct("a", {"_id": {"$lt": 3}}) == [2, 3]
    r = coll.update_many({"a": {"$gte": 2}}, {"$inc": {"a": 10}, "$set": {"b.d": "x"}})
    assert (r.matched_count, r.modified_count) == (3, 3)
    r = coll.update_one({"a": 0}, {"$set": {"a": 0}})
    assert (r.matched_count, r.modified_count) == (1, 0)
    r = coll.update_one({"x": 1, "y.z": 2, "w": {"$gt": 1}}, {"$set": {"k": 2}, "$setOnInsert": {"o": 1}}, upsert=True)
    new = coll.find_one({"_id": r.upserted_id})
    assert new == {"_id": r.upserted_id, "x": 1, "y": {"z": 2}, "k": 2, "o": 1} and r.matched_count == 0
    with pytest.raises(WriteError) as e:
        coll.update_one({"_id": 1}, {"$set": {"_id": 9}})
    assert e.value.code == 66
    before = coll.count_documents()
    with pytest.raises(WriteError):
        coll.update_many({}, {"$inc": {"b": 1}})
    assert coll.count_documents({"b": {"$type": "object"}}) == 7 and coll.count_documents() == before
    assert coll.replace_one({"_id": 2}, {"q": 1}).modified_count == 1 and coll.find_one(2) == {"_id": 2, "q": 1}
    assert coll.find_one_and_update({"b.c": {"$gt": 0}}, {"$set": {"z": 1}}, sort=[("b.c", -1)], return_document=ReturnDocument.AFTER)["_id"] == 7
    assert coll.find_one_and_update({"b.c": 4}, {"$unset": {"b": ""}})["b"] == {"c": 4}
    assert coll.delete_one({"a": 0}).deleted_count == 1 and coll.delete_many({"_id": {"$gte": 20}}).deleted_count == 3
    assert coll.delete_many({"_id": "none"}).deleted_count == 0
    coll.create_index("a")
    with pytest.raises(NotImplementedError):
        coll.aggregate([])
    assert client.shop.list_collection_names() == ["items"] and client.list_database_names() == ["shop"]
    coll.drop()
    assert client.shop.list_collection_names() == [] and coll.count_documents() == 0


def test_changes_touch_only_their_parts(client):
    coll = client.shop.parts
    for start in (0, 10, 20):
        coll.insert_many([{"_id": n, "a": n} for n in range(start, start + 10)])
    names = lambda: [p["name"] for p in client.store._manifest("shop", "parts")["parts"]]
    before = names()
    assert coll.update_one({"_id": 12}, {"$set": {"a": -1}}).modified_count == 1
    after = names()
    assert after[0] == before[0] and after[2] == before[2] and after[1] != before[1]
    assert coll.update_many({"a": {"$gte": 25}}, {"$inc": {"a": 100}}).modified_count == 5 and names()[:2] == after[:2]
    assert coll.delete_one({"_id": 0}).deleted_count == 1 and coll.delete_many({"_id": {"$gte": 10, "$lt": 20}}).deleted_count == 10
    assert len(names()) == 2 and [d["_id"] for d in coll.find()] == [*range(1, 10), *range(20, 30)]
    coll.insert_one({"_id": "new"})
    coll.compact()
    assert len(names()) == 1 and [d["_id"] for d in coll.find()][-1] == "new" and coll.count_documents() == 20


def test_names_and_cursors(client):
    for bad in ("", "a$b", "system.x", ".a", "a..b"):
        with pytest.raises(InvalidName):
            client.shop[bad]
    with pytest.raises(InvalidName):
        client["a.b"]
    client.shop.create_collection("c1")
    with pytest.raises(CollectionInvalid):
        client.shop.create_collection("c1")
    coll = client.shop.c1
    coll.insert_many([{"doc": n} for n in range(20)])
    cursor = coll.find(max_scan=5)
    assert cursor.count() == 5 and len(list(cursor)) == 5
    with pytest.raises(InvalidOperation):
        cursor.sort("doc")
    assert len(list(cursor.rewind())) == 5 and len(list(cursor.clone())) == 5
    assert coll.find({}, {}).next().keys() == {"_id"}
    assert coll.count_documents({}, skip=3, limit=5) == 5 and coll.find().limit(4).count() == 20
    assert list(coll.find()[3:3]) == []
    for bad in (lambda: coll.find()[-1], lambda: coll.find()[0:5:2], lambda: coll.find()[50]):
        with pytest.raises(IndexError):
            bad()
    with pytest.raises(TypeError):
        coll.find([1])
    bad = coll.find({"$foo": 1})  # found when the first document is asked for
    with pytest.raises(OperationFailure):
        next(bad)
    with pytest.raises(NotImplementedError):
        coll.find().hint("x")


def test_order_over_types(client):
    coll = client.shop.mixed
    vals = [MaxKey(), True, "b", 3, None, [], [2, 9], {"x": 1}, b"1", ObjectId("0" * 24), datetime.datetime(2020, 1, 1), Timestamp(1, 1), Regex("a"), Decimal128("2.5"), MinKey(), -1.5]
    coll.insert_many([{"_id": n, "a": v} for n, v in enumerate(vals)] + [{"_id": 99}])
    up = [d["_id"] for d in coll.find().sort("a", 1)]
    assert up == [14, 5, 4, 99, 15, 6, 13, 3, 2, 7, 8, 9, 1, 10, 11, 12, 0]
    assert [d["_id"] for d in coll.find().sort([("a", -1)])][:4] == [0, 12, 11, 10]
    assert coll.distinct("a")[:3] == [MinKey(), None, -1.5]
    assert coll.find_one({"a": [2, 9]})["_id"] == 6


@pytest.mark.parametrize("engine", ["memory", "flatfile", "sqlite"])
def test_engines(spark, tmp_path, engine):
    repo = ":memory:" if engine == "memory" else str(tmp_path)
    if engine != "memory":
        set_storage(repo, storage=engine, version="4.0")
    with open_repo(repo), Client(spark=spark) as client:
        assert client.store.name == engine
        coll = client.db["a.b"]
        coll.insert_many([{"_id": n, "v": n} for n in (3, 1, 2)])
        coll.update_many({"v": {"$gt": 1}}, {"$mul": {"v": 2}})
        coll.delete_one({"_id": 1})
        assert [(d["_id"], d["v"]) for d in coll.find()] == [(3, 6), (2, 4)]
        assert client.db.collection_names() == ["a.b"]
        client.drop_database("db")
        assert client.database_names() == []
    if engine != "memory":
        with pytest.raises(ConfigurationError):
            Client(repo, spark=spark, storage="nope")


def test_engines_that_need_a_library(spark, tmp_path):
    pytest.importorskip("pyspark")
    try:
        import lmdb  # noqa: F401
    except ImportError:
        with pytest.raises(ConfigurationError):
            Client(str(tmp_path), spark=spark, storage="lightning")


EVERY_TYPE = {
    "_id": ObjectId("5f" * 12), "i": 1, "big": 2**40, "l": Int64(5), "f": 1.5, "d": Decimal128("1.10"), "n": None, "b": True, "s": "é\u0000x", "o": {"z": 1, "a": [1, {"q": 2}]},
    "bin": b"ab", "bin4": Binary(b"x" * 16, 4), "re": Regex("a.b", "i"), "ts": Timestamp(4, 13), "code": Code("f()"), "scoped": Code("g()", {"x": 1}), "min": MinKey(), "max": MaxKey(),
    "at": datetime.datetime(2021, 5, 4, 3, 2, 1, 500000, datetime.timezone.utc), "inf": float("inf"),
}


def test_codecs():
    assert bson.decode(bson.encode(EVERY_TYPE)) == EVERY_TYPE
    assert ejson.loads(ejson.dumps(EVERY_TYPE)) == EVERY_TYPE
    assert list(ejson.loads(ejson.dumps(EVERY_TYPE))) == list(EVERY_TYPE)
    for text in ("NaN", "-Infinity", "0E-10", "9.999E+100", "-123.456"):
        assert str(bson.decode_decimal(bson.encode_decimal(Decimal128(text).value))) == str(Decimal128(text))
    with pytest.raises(ValueError):
        list(bson.split(bson.encode({"a": 1})[:-1]))
    assert bson.encode({"a": 1}) == b"\x0c\x00\x00\x00\x10a\x00\x01\x00\x00\x00\x00"


def test_sort_keys_agree_with_values():
    numbers = [float("nan"), float("-inf"), -1e300, -10, -9.5, -1, -0.001, 0, 1e-9, 0.5, 1, Decimal128("1.5"), 2, 9, 10, 11, 2**70, 1e300, float("inf")]
    keys = [sort_key(n) for n in numbers]
    assert keys == sorted(keys) and sort_key(1) == sort_key(1.0) == sort_key(Decimal128("1.00")) and sort_key(0.0) == sort_key(-0.0)
    assert sort_key("a") < sort_key("a\x00") < sort_key("ab") and sort_key([1]) < sort_key([1, 0]) < sort_key([2])
    assert sort_key({"a": 1}) < sort_key({"a": 2}) < sort_key({"b": 0}) < sort_key({"a": "x"})


def test_import_and_export(client, tmp_path):
    coll = client.shop.imported
    lines = tmp_path / "in.jsonl"
    lines.write_text("\n".join(json.dumps(d) for d in [{"_id": 1, "a": 1}, {"_id": 2, "a": 2}, {"_id": 1, "a": 3}, {"a": 9}]) + "\n")
    assert transfer.import_lines(coll, str(lines)) == 3 and coll.find_one(1)["a"] == 1
    lines.write_text('{"_id": 1, "a": 5}\n{"_id": 7, "a": 7}\n')
    assert transfer.import_lines(coll, str(lines), mode="merge") == 1 and coll.find_one(1)["a"] == 1
    transfer.import_lines(coll, str(lines), mode="upsert")
    assert coll.find_one(1)["a"] == 5 and coll.count_documents() == 4
    assert transfer.export_lines(coll, str(tmp_path / "out"), ["a"], {"a": {"$gt": 4}}) == 3
    assert transfer.dump(coll, str(tmp_path / "x.bson")) == 4
    assert transfer.restore(client.shop.restored, str(tmp_path / "x.bson")) == 4
    assert list(client.shop.restored.find().sort("_id")) == list(coll.find().sort("_id"))


def test_sqlite_source(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("CREATE TABLE documents (k TEXT, v TEXT)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", [(str(n), json.dumps({"_id": n})) for n in range(100)])
    df = sqlite.read_table(spark, str(tmp_path / "x.db"))
    assert df.count() == 100 and df.rdd.getNumPartitions() == 8


def test_lists():
    x = QueryList([{"a": 3}, {"a": 1, "b": [1, 2]}, 5, {"a": 2}])
    assert x.find({"a": {"$gt": 1}}, sort=[("a", 1)]) == [{"a": 2}, {"a": 3}]
    assert x.find({"b": 2}, {"b.$": 1}) == [{"b": [2]}]
    x.sort([("a", -1)])
    assert x[0] == {"a": 3} and QueryList([3, "a", None]) < [4]
    with pytest.raises(NotImplementedError):
        x.update_one({}, {})
