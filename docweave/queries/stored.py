"""Queries that write: first-match forms on typed tables, and collections in each storage engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.api import Client
from docweave.api.collection import Collection, ReturnDocument
from docweave.plans import reshape, typed
from docweave.session import shared_dir
from docweave.sources import transfer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# --- one row of a typed table ---------------------------------------------------

_BY_KEY, _BY_PRICE = [("o_orderkey", 1)], [("o_totalprice", -1), ("o_orderkey", 1)]
_FIRST = "(SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000)"
_DEAREST = "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)"
_OPEN = {"o_orderstatus": "F", "o_totalprice": {"$gt": 1000}}


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


_add(
    "update_one",
    lambda s, d: reshape.update_first(_orders(s, d), _OPEN, {"$set": {"o_orderpriority": "first"}, "$inc": {"o_custkey": 5}}, _BY_KEY).select("o_orderkey", "o_custkey", "o_orderpriority"),
    f"SELECT o_orderkey, CASE WHEN o_orderkey = {_FIRST} THEN o_custkey + 5 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey = {_FIRST} THEN 'first' ELSE o_orderpriority END AS o_orderpriority FROM orders",
)
_add("delete_one", lambda s, d: reshape.delete_first(_orders(s, d), _OPEN, _BY_KEY).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE o_orderkey <> {_FIRST}")
_add(
    "replace_first",
    lambda s, d: reshape.replace_rows(_orders(s, d), _OPEN, {"o_orderstatus": "X"}, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus"),
    f"SELECT o_orderkey, CASE WHEN o_orderkey <> {_FIRST} THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey = {_FIRST} THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
_add(
    "find_one_and_update_before",
    lambda s, d: reshape.find_and_update(_orders(s, d), {"o_orderpriority": "1-URGENT"}, {"$set": {"o_orderstatus": "done"}}, _BY_PRICE)[0].select("o_orderkey", "o_orderstatus"),
    f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = {_DEAREST}",
)
_add(
    "find_one_and_update_after",
    lambda s, d: reshape.find_and_update(_orders(s, d), {"o_orderpriority": "1-URGENT"}, {"$set": {"o_orderstatus": "done"}}, _BY_PRICE, return_new=True)[0].select("o_orderkey", "o_orderstatus"),
    f"SELECT o_orderkey, 'done' AS o_orderstatus FROM orders WHERE o_orderkey = {_DEAREST}",
)
_add(
    "find_one_and_update_table",
    lambda s, d: reshape.find_and_update(_orders(s, d), {"o_orderpriority": "1-URGENT"}, {"$set": {"o_orderstatus": "done"}}, _BY_PRICE)[1].select("o_orderkey", "o_orderstatus"),
    f"SELECT o_orderkey, CASE WHEN o_orderkey = {_DEAREST} THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
_add(
    "upsert_new",
    lambda s, d: reshape.upsert_rows(_orders(s, d), {"o_orderkey": -1}, {"$set": {"o_orderstatus": "N"}, "$setOnInsert": {"o_custkey": 7}}).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT -1, 7, 'N', NULL",
)
_add(
    "upsert_held",
    lambda s, d: reshape.upsert_rows(_orders(s, d), {"o_orderstatus": "P"}, {"$set": {"o_orderpriority": "N"}, "$setOnInsert": {"o_custkey": 7}}).select("o_orderkey", "o_custkey", "o_orderpriority"),
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE o_orderpriority END AS o_orderpriority FROM orders",
)
_add("find_one", lambda s, d: typed.find(_orders(s, d), _OPEN, ["o_orderkey", "o_totalprice"], _BY_PRICE, limit=-1), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
_add("count_skip_limit", lambda s, d: typed.count_documents(_orders(s, d), {"o_orderstatus": "F"}, skip=100, limit=5000), "SELECT least(greatest(count(*) - 100, 0), 5000) AS n FROM orders WHERE o_orderstatus = 'F'")
_add(
    "max_scan",
    lambda s, d: typed.count_documents(typed.find(_orders(s, d), {"o_orderkey": {"$exists": True}}, max_scan=321), {}),
    "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 321)",
)

# --- collections -------------------------------------------------------------------


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.struct(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return _table(spark, sf, "customer").select("c_custkey", F.to_json(fields).alias("doc"))


def _opened(spark: SparkSession, engine: str) -> Client:
    """A new repository; files of single-file engines lie in the shared folder too."""
    return Client(":memory:" if engine == "memory" else f"{shared_dir(spark)}/stored-{uuid.uuid4().hex[:12]}", spark=spark, storage=engine)


_ROW = "_id long, name string, segment string, nation long, flag string"


def _rows(coll: Collection) -> DataFrame:
    return coll.frame().select(F.from_json("doc", _ROW).alias("r")).select("r.*")


_COLUMNS = "c_custkey AS _id, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation"


def _engine(engine: str) -> None:
    """Insert, update, delete and read back: all documents of the table."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        coll = _opened(spark, engine).shop.customers
        coll.insert_frame(_customers(spark, sf), order="c_custkey")
        coll.update_many({"segment": "BUILDING"}, {"$set": {"flag": "b"}, "$inc": {"nation": 100}})
        coll.delete_many({"balance": {"$lt": 0}})
        coll.insert_one({"_id": -1, "name": "one"})
        return _rows(coll)

    _add(
        f"engine_{engine}",
        run,
        "SELECT c_custkey AS _id, c_name AS name, c_mktsegment AS segment, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 100 ELSE c_nationkey END AS BIGINT) AS nation, "
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' END AS flag FROM customer WHERE NOT c_acctbal < 0 UNION ALL SELECT -1, 'one', NULL, NULL, NULL",
    )


for _name in ("snapshot", "memory", "flatfile", "sqlite"):
    _engine(_name)


def _writes_of_one(spark: SparkSession, sf: str) -> DataFrame:
    """One document at a time: update, replace, delete, upsert, find and update, save."""
    coll = _opened(spark, "snapshot").shop.customers
    coll.insert_frame(_customers(spark, sf), order="c_custkey")
    coll.update_one({"segment": "MACHINERY"}, {"$set": {"flag": "first"}})
    coll.replace_one({"segment": "AUTOMOBILE"}, {"name": "new"})
    coll.delete_one({"segment": "FURNITURE"})
    coll.update_one({"_id": -1}, {"$set": {"name": "up"}, "$setOnInsert": {"segment": "NEW"}}, upsert=True)
    coll.find_one_and_update({"segment": "HOUSEHOLD"}, {"$set": {"flag": "top"}}, sort=[("balance", -1), ("_id", 1)], return_document=ReturnDocument.AFTER)
    return _rows(coll)


_add(
    "stored_writes_of_one",
    _writes_of_one,
    f"""
WITH firsts AS (SELECT c_mktsegment AS g, min(c_custkey) AS f FROM customer GROUP BY 1),
  top AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'HOUSEHOLD' ORDER BY c_acctbal DESC, c_custkey LIMIT 1),
  t AS (SELECT {_COLUMNS}, c_custkey = f AS is_first, c_custkey IN (SELECT k FROM top) AS is_top FROM customer JOIN firsts ON g = c_mktsegment)
SELECT _id, CASE WHEN is_first AND segment = 'AUTOMOBILE' THEN 'new' ELSE name END AS name, CASE WHEN NOT (is_first AND segment = 'AUTOMOBILE') THEN segment END AS segment,
  CASE WHEN NOT (is_first AND segment = 'AUTOMOBILE') THEN nation END AS nation, CASE WHEN is_first AND segment = 'MACHINERY' THEN 'first' WHEN is_top THEN 'top' END AS flag
FROM t WHERE NOT (is_first AND segment = 'FURNITURE') UNION ALL SELECT -1, 'up', 'NEW', NULL, NULL
""",
)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Export a part as JSON lines, import it elsewhere, then the whole again, which adds the rest."""
    client = _opened(spark, "snapshot")
    coll, other = client.shop.customers, client.shop.others
    coll.insert_frame(_customers(spark, sf), order="c_custkey")
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex[:12]}"
    transfer.export_lines(coll, f"{path}/a", query={"segment": "BUILDING"})
    transfer.import_lines(other, f"{path}/a")
    other.update_many({}, {"$set": {"flag": "old"}})
    transfer.export_lines(coll, f"{path}/b", query={"nation": {"$lt": 10}})
    transfer.import_lines(other, f"{path}/b", mode="merge")
    return _rows(other)


_add("import_export", _lines, f"SELECT {_COLUMNS}, CASE WHEN c_mktsegment = 'BUILDING' THEN 'old' END AS flag FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey < 10")


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Import in the mode that replaces documents of equal ids."""
    client = _opened(spark, "snapshot")
    coll, other = client.shop.customers, client.shop.others
    coll.insert_frame(_customers(spark, sf), order="c_custkey")
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex[:12]}"
    transfer.export_lines(coll, path, query={"nation": {"$lt": 10}})
    other.insert_frame(_customers(spark, sf).where("c_custkey % 2 = 0"), order="c_custkey")
    other.update_many({}, {"$set": {"flag": "old"}})
    transfer.import_lines(other, path, mode="upsert")
    return _rows(other)


_add("import_upsert", _upserted, f"SELECT {_COLUMNS}, CASE WHEN c_nationkey >= 10 THEN 'old' END AS flag FROM customer WHERE c_custkey % 2 = 0 OR c_nationkey < 10")


def _dumped(spark: SparkSession, sf: str) -> DataFrame:
    """A BSON dump and its restoration."""
    client = _opened(spark, "snapshot")
    coll, other = client.shop.customers, client.shop.others
    coll.insert_frame(_customers(spark, sf), order="c_custkey")
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex[:12]}.bson"
    transfer.dump(coll, path.removeprefix("file://"))
    transfer.restore(other, path)
    return _rows(other).drop("flag")


_add("dump_restore", _dumped, f"SELECT {_COLUMNS} FROM customer")


def _cursor(spark: SparkSession, sf: str) -> DataFrame:
    """A cursor with filter, projection, sort, slice; its count; distinct values and list of collections."""
    client = _opened(spark, "snapshot")
    coll = client.shop.customers
    coll.insert_frame(_customers(spark, sf), order="c_custkey")
    found = coll.find({"nation": {"$gte": 5}}, {"name": 1, "balance": 1}).sort([("balance", -1), ("_id", 1)])
    rows = [("page", d["_id"], d["name"]) for d in found[10:60]]
    rows.append(("fifth", found[4]["_id"], found[4]["name"]))
    rows.append(("count", coll.find({"nation": {"$gte": 5}}).count(), None))
    rows.append(("count skip limit", coll.count_documents({"nation": {"$gte": 5}}, skip=7, limit=40), None))
    rows += [("distinct", None, v) for v in coll.distinct("segment")]
    rows += [("collection", None, v) for v in client.shop.list_collection_names()]
    rows += [("database", None, v) for v in client.list_database_names()]
    return spark.createDataFrame(rows, "what string, n long, text string")


_FOUND = "(SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_nationkey >= 5)"
_add(
    "cursor_pages",
    _cursor,
    f"""
SELECT 'page' AS what, c_custkey AS n, c_name AS text FROM {_FOUND} WHERE r BETWEEN 11 AND 60
UNION ALL SELECT 'fifth', c_custkey, c_name FROM {_FOUND} WHERE r = 5
UNION ALL SELECT 'count', count(*), NULL FROM {_FOUND}
UNION ALL SELECT 'count skip limit', least(greatest(count(*) - 7, 0), 40), NULL FROM {_FOUND}
UNION ALL SELECT DISTINCT 'distinct', NULL, c_mktsegment FROM customer
UNION ALL SELECT 'collection', NULL, 'customers' UNION ALL SELECT 'database', NULL, 'shop'
""",
)
