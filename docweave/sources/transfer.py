"""Import and export of collections: JSON lines and BSON dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import bson, ejson
from docweave.functions.bsontypes import ObjectId
from docweave.functions.order import sort_key


def numbered(rows: DataFrame, doc: str = "doc", order: str | None = None) -> DataFrame:
    """``at, id_key, doc`` of documents in a text column; a missing ``_id`` is made."""
    at = F.col(order).cast("long") if order else F.monotonically_increasing_id()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, docs = [], []
            for text in batch["doc"]:
                value = ejson.loads(text)
                if "_id" not in value:
                    value = {"_id": ObjectId()} | value
                keys.append(sort_key(value["_id"]))
                docs.append(ejson.dumps(value))
            yield batch[["at"]].assign(id_key=keys, doc=docs)

    return rows.select(at.alias("at"), F.col(doc).alias("doc")).where("doc IS NOT NULL AND trim(doc) != ''").mapInPandas(run, "at long, id_key binary, doc string")


def import_lines(collection, path: str, mode: str = "insert") -> int:
    """Documents of a JSON-lines file into a collection; returns how many came in.

    ``insert`` skips ids the collection has, ``upsert`` replaces their
    documents, ``merge`` keeps theirs (only new ones come in).
    """
    if mode not in ("insert", "upsert", "merge"):
        raise ValueError("mode is insert, upsert or merge")
    lines = collection._store.spark.read.text(path).withColumnRenamed("value", "doc")
    if mode != "upsert":
        return collection.insert_frame(lines)
    from docweave.session import staged

    incoming = numbered(lines)
    last = staged(incoming.groupBy("id_key").agg(F.max_by("doc", "at").alias("doc"), F.min("at").alias("at")), "import")
    own = collection.frame()
    kept = own.join(last.select("id_key", F.col("doc").alias("new")), "id_key", "left").select("seq", "id_key", F.coalesce("new", "doc").alias("doc"))
    start = collection._store.next_seq(collection.database.name, collection.name)
    added = last.join(own.select("id_key"), "id_key", "left_anti").select((F.col("at") + F.lit(start)).alias("seq"), "id_key", "doc")
    collection._store.replace(collection.database.name, collection.name, kept.unionByName(added))
    return last.count()


def export_lines(collection, path: str, fields=None, query: dict | None = None) -> int:
    """Matching documents as JSON lines, one folder of files; returns how many."""
    projection = {name: 1 for name in fields} if fields else None
    rows = collection.find(query, projection).frame()
    rows.select("doc").write.mode("overwrite").text(path)
    return collection._store.spark.read.text(path).count()


def dump(collection, path: str) -> int:
    """The collection as one BSON file; rows stream through the driver."""
    n = 0
    with open(path, "wb") as out:
        for row in collection.frame().orderBy("seq").toLocalIterator():
            out.write(bson.encode(ejson.loads(row.doc)))
            n += 1
    return n


def read_dump(spark, path: str) -> DataFrame:
    """``at, doc`` of BSON files, decoded where the files are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                docs = [ejson.dumps(bson.decode(x)) for x in bson.split(bytes(data))]
                yield pd.DataFrame({"at": range(len(docs)), "doc": docs})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "at long, doc string")


def restore(collection, path: str) -> int:
    """Documents of a BSON dump into a collection; ids it has are skipped."""
    return collection.insert_frame(read_dump(collection._store.spark, path), order="at")
