"""Collections: reading and writing documents."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.api.cursor import Cursor, sort_pairs
from docweave.api.results import DeleteResult, InsertManyResult, InsertOneResult, UpdateResult
from docweave.documents import frames
from docweave.documents.project import Projection, compile_projection
from docweave.documents.update import Update, Updater
from docweave.errors import BulkWriteError, DuplicateKeyError, InvalidDocument, OperationFailure, WriteError
from docweave.functions import ejson
from docweave.functions.bsontypes import ObjectId
from docweave.functions.order import same, sort_key
from docweave.plans.spec import equalities, parse_filter
from docweave.sources.store import SnapshotStore

#: Methods of the collection API that exist elsewhere and raise NotImplementedError here.
_UNSUPPORTED = (
    "aggregate", "aggregate_raw_batches", "map_reduce", "inline_map_reduce", "bulk_write", "find_one_and_delete", "find_one_and_replace", "create_indexes",
    "drop_index", "drop_indexes", "reindex", "list_indexes", "index_information", "rename", "options", "parallel_scan", "find_raw_batches", "watch",
)
_ERRORS = {"WriteError": WriteError, "OperationFailure": OperationFailure}


class ReturnDocument:
    BEFORE, AFTER = False, True


def check_document(doc: Any, names: bool = True) -> None:
    """Raises InvalidDocument for names that can't be stored by an insert."""
    if isinstance(doc, dict):
        for key, value in doc.items():
            if not isinstance(key, str):
                raise InvalidDocument(f"documents must have only string keys, key was {key!r}")
            if "\x00" in key:
                raise InvalidDocument(f"key {key!r} must not contain NUL")
            if key[:1] == "$" and names:
                raise InvalidDocument(f"key {key!r} must not start with '$'")
            if "." in key and names:
                raise InvalidDocument(f"key {key!r} must not contain '.'")
            check_document(value, names)
    elif isinstance(doc, (list, tuple)):
        for x in doc:
            check_document(x, names)


class Collection:
    def __init__(self, database, name: str):
        self.database, self.name = database, name
        self.full_name = f"{database.name}.{name}"

    @property
    def compat(self):
        return self.database.client.compat

    @property
    def document_class(self):
        return self.database.client.document_class

    @property
    def _store(self):
        return self.database.client.store

    def __repr__(self) -> str:
        return f"Collection({self.full_name!r})"

    def __eq__(self, other) -> bool:
        return isinstance(other, Collection) and (self.database, self.name) == (other.database, other.name)

    def __hash__(self) -> int:
        return hash(self.full_name)

    def __getattr__(self, name: str):
        if name in _UNSUPPORTED:
            raise NotImplementedError(f"collection.{name} is not supported")
        if name[:1] == "_":
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Collection:
        return self.database.get_collection(f"{self.name}.{name}")

    def with_options(self, *_, **__) -> Collection:
        return Collection(self.database, self.name)

    # -- reading --------------------------------------------------------

    def frame(self) -> DataFrame:
        """The collection as a table ``seq, id_key, doc``."""
        return self._store.load(self.database.name, self.name)

    def find(self, *args, **kwargs) -> Cursor:
        return Cursor(self, *args, **kwargs)

    def find_one(self, filter=None, *args, **kwargs) -> dict | None:
        if filter is not None and not isinstance(filter, dict):
            filter = {"_id": filter}
        kwargs["limit"] = -1
        return next(self.find(filter, *args, **kwargs), None)

    def count_documents(self, filter=None, skip: int = 0, limit: int = 0, **_) -> int:
        if filter is not None and not isinstance(filter, dict):
            raise TypeError("a filter is a dict")
        return self.find(filter, skip=skip, limit=limit).count(with_limit_and_skip=True)

    def count(self, filter=None, **kwargs) -> int:
        warnings.warn("count is deprecated, use count_documents", DeprecationWarning, stacklevel=2)
        return self.count_documents(filter, **kwargs)

    def estimated_document_count(self) -> int:
        return self.frame().count()

    def distinct(self, key: str, filter=None) -> list:
        if not isinstance(key, str):
            raise TypeError("the key is a string")
        if filter is not None and not isinstance(filter, dict):
            raise TypeError("a filter is a dict")
        return [ejson.loads(r.value)["v"] for r in frames.distinct_values(self.frame(), key, filter, self.compat).collect()]

    # -- inserting ------------------------------------------------------

    def _known(self, keys: list[bytes]) -> set[bytes]:
        """Which of the id keys the collection has."""
        frame = self.frame().select("id_key")
        if len(keys) <= 200:  # few keys are pushed down to the file statistics
            found = frame.where(F.col("id_key").isin(keys))
        else:
            found = frame.join(self._store.spark.createDataFrame([(k,) for k in keys], "id_key binary"), "id_key", "left_semi")
        return {bytes(r.id_key) for r in found.collect()}

    def _append(self, docs: list[dict]) -> None:
        if docs:
            start = self._store.next_seq(self.database.name, self.name)
            rows = [(start + n, sort_key(d["_id"]), ejson.dumps(d)) for n, d in enumerate(docs)]
            self._store.append(self.database.name, self.name, self._store.spark.createDataFrame(rows, frames.ROWS))

    def insert_one(self, document: dict) -> InsertOneResult:
        if not isinstance(document, dict):
            raise TypeError("a document is a dict")
        document.setdefault("_id", ObjectId())
        check_document(document)
        if self._known([sort_key(document["_id"])]):
            raise DuplicateKeyError(f"E11000 duplicate key error collection: {self.full_name} index: _id_ dup key: {document['_id']!r}")
        self._append([document])
        return InsertOneResult(document["_id"])

    def insert_many(self, documents: Iterable[dict], ordered: bool = True) -> InsertManyResult:
        """Insert documents; an ordered insert keeps what comes before a duplicate."""
        if isinstance(documents, dict) or not isinstance(documents, Iterable):
            raise TypeError("documents is a non-empty list")
        documents = list(documents)
        if not documents:
            raise TypeError("documents is a non-empty list")
        for doc in documents:
            if not isinstance(doc, dict):
                raise TypeError("a document is a dict")
            doc.setdefault("_id", ObjectId())
            check_document(doc)
        keys = [sort_key(d["_id"]) for d in documents]
        taken = self._known(keys)
        good, errors = [], []
        for n, (doc, key) in enumerate(zip(documents, keys)):
            if key in taken:
                errors.append({"index": n, "code": 11000, "errmsg": f"E11000 duplicate key error: {doc['_id']!r}", "op": doc})
                if ordered:
                    break
            else:
                taken.add(key)
                good.append(doc)
        self._append(good)
        if errors:
            raise BulkWriteError({"writeErrors": errors, "writeConcernErrors": [], "nInserted": len(good), "nUpserted": 0, "nMatched": 0, "nModified": 0, "nRemoved": 0, "upserted": []})
        return InsertManyResult([d["_id"] for d in documents])

    def insert_frame(self, rows: DataFrame, doc: str = "doc", order: str | None = None) -> int:
        """Insert the documents of a table column; returns how many.

        The distributed way in: nothing passes through the driver. Documents
        whose ``_id`` the collection or an earlier row has are skipped.
        """
        from docweave.sources.transfer import numbered

        incoming = numbered(rows, doc, order)
        first = incoming.groupBy("id_key").agg(F.min_by(F.struct("at", "doc"), "at").alias("x")).select("id_key", "x.at", "x.doc")
        new = first.join(self.frame().select("id_key"), "id_key", "left_anti")
        start = self._store.next_seq(self.database.name, self.name)
        before = self.frame().count()
        self._store.append(self.database.name, self.name, new.select((F.col("at") + F.lit(start)).alias("seq"), "id_key", "doc"))
        return self.frame().count() - before

    # -- updating -------------------------------------------------------

    def _version(self):
        return self._store.version(self.database.name, self.name)

    def _first_match(self, filter: dict, sort=None) -> int | None:
        pairs = sort_pairs(sort) if sort else []
        rows = frames.matching(self.frame(), filter, pairs, self.compat)
        row = frames.ordered(rows, pairs).select("seq").first()
        return None if row is None else row.seq

    def _rewrite(self, filter: dict, update, only: int | None) -> tuple[int, int]:
        """Apply an update to all matches, or to one row; (matched, modified)."""
        from docweave.session import release, staged

        base = self._version()
        whole = not isinstance(self._store, SnapshotStore)
        own = self.frame() if only is None or whole else self._store.load(self.database.name, self.name, [only])
        done = staged(frames.updated(own, filter, update, only, self.compat), "update")
        sums = done.agg(F.count_if("matched").alias("n"), F.count_if("modified").alias("m"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error")).first()
        if sums.error:
            release(done)
            kind, message, code = json.loads(sums.error)
            raise _ERRORS.get(kind, OperationFailure)(message, code)
        if sums.m:
            self._store.rewrite(self.database.name, self.name, done.select("seq", "id_key", "doc"), done.where("modified").select("seq"), base)
        release(done)
        return sums.n, sums.m

    def _upsert(self, filter: dict, update) -> Any:
        seed: dict = {}
        for path, value in equalities(filter).items():
            node = seed
            *parents, last = path.split(".")
            for step in parents:
                node = node.setdefault(step, {})
            node[last] = value
        if isinstance(update, Update):
            if update.touches_id:
                for path, op, arg in update.changes:
                    if path == "_id" and op in ("$set", "$setOnInsert") and "_id" in seed and not same(seed["_id"], arg):
                        raise WriteError("performing an update on the path '_id' would modify the immutable field '_id'", 66)
            doc = Updater(update).apply(seed, {}, inserting=True)
        else:
            doc = ({"_id": seed["_id"]} if "_id" in seed else {}) | update
        if "_id" not in doc:
            doc = {"_id": ObjectId()} | doc
        check_document(doc, names=False)
        if self._known([sort_key(doc["_id"])]):
            raise DuplicateKeyError(f"E11000 duplicate key error collection: {self.full_name} index: _id_ dup key: {doc['_id']!r}")
        self._append([doc])
        return doc["_id"]

    def _guard_id(self, update: Update) -> None:
        if update.touches_id:
            raise WriteError("performing an update on the path '_id' would modify the immutable field '_id'", 66)

    def _update(self, filter, update, upsert: bool, array_filters, many: bool) -> UpdateResult:
        if not isinstance(filter, dict):
            raise TypeError("a filter is a dict")
        if not isinstance(upsert, bool):
            raise TypeError("upsert is a bool")
        parsed = Update(update, array_filters, self.compat)
        parse_filter(filter, self.compat)
        first = self._first_match(filter)
        if first is None:
            if upsert:
                return UpdateResult({"n": 1, "nModified": 0, "upserted": self._upsert(filter, parsed), "updatedExisting": False})
            return UpdateResult({"n": 0, "nModified": 0, "updatedExisting": False})
        self._guard_id(parsed)
        n, m = self._rewrite(filter, parsed, None if many else first)
        return UpdateResult({"n": n, "nModified": m, "updatedExisting": True})

    def update_one(self, filter, update, upsert: bool = False, array_filters=None, **_) -> UpdateResult:
        return self._update(filter, update, upsert, array_filters, many=False)

    def update_many(self, filter, update, upsert: bool = False, array_filters=None, **_) -> UpdateResult:
        return self._update(filter, update, upsert, array_filters, many=True)

    def replace_one(self, filter, replacement: dict, upsert: bool = False, **_) -> UpdateResult:
        if not isinstance(filter, dict) or not isinstance(replacement, dict):
            raise TypeError("filter and replacement are dicts")
        if replacement and next(iter(replacement))[:1] == "$":
            raise ValueError("replacement can not include $ operators")
        check_document(replacement, names=False)
        first = self._first_match(filter)
        if first is None:
            if upsert:
                return UpdateResult({"n": 1, "nModified": 0, "upserted": self._upsert(filter, replacement), "updatedExisting": False})
            return UpdateResult({"n": 0, "nModified": 0, "updatedExisting": False})
        if "_id" in replacement:
            old = self.frame().where(F.col("seq") == first).first()
            if bytes(old.id_key) != sort_key(replacement["_id"]):
                raise WriteError("the _id field cannot be changed", 66)
        n, m = self._rewrite(filter, replacement, first)
        return UpdateResult({"n": n, "nModified": m, "updatedExisting": True})

    def find_one_and_update(self, filter, update, projection=None, sort=None, return_document: bool = ReturnDocument.BEFORE, upsert: bool = False, array_filters=None, **_) -> dict | None:
        if not isinstance(filter, dict):
            raise TypeError("a filter is a dict")
        parsed = Update(update, array_filters, self.compat)
        target = self._first_match(filter, sort)

        def at(seq_filter) -> dict | None:
            row = self.frame().where(seq_filter).first()
            doc = None if row is None else ejson.loads(row.doc)
            if doc is not None and projection is not None:
                doc = compile_projection(Projection(projection or {"_id": 1}, filter, self.compat), self.compat)(doc, {})
            return doc

        if target is None:
            if not upsert:
                return None
            key = sort_key(self._upsert(filter, parsed))
            return at(F.col("id_key") == F.lit(key)) if return_document else None
        self._guard_id(parsed)
        before = at(F.col("seq") == target)
        self._rewrite(filter, parsed, target)
        return at(F.col("seq") == target) if return_document else before

    def save(self, document: dict) -> Any:
        warnings.warn("save is deprecated, use insert_one or replace_one", DeprecationWarning, stacklevel=2)
        if "_id" in document:
            self.replace_one({"_id": document["_id"]}, document, upsert=True)
            return document["_id"]
        return self.insert_one(document).inserted_id

    # -- deleting -------------------------------------------------------

    def delete_one(self, filter, **_) -> DeleteResult:
        if not isinstance(filter, dict):
            raise TypeError("a filter is a dict")
        base = self._version()
        first = self._first_match(filter)
        if first is None:
            return DeleteResult(0)
        gone = self._store.spark.createDataFrame([(first,)], "seq long")
        self._store.rewrite(self.database.name, self.name, self.frame().where(F.col("seq") != first), gone, base)
        return DeleteResult(1)

    def delete_many(self, filter, **_) -> DeleteResult:
        if not isinstance(filter, dict):
            raise TypeError("a filter is a dict")
        from docweave.session import release, staged

        base = self._version()
        gone = staged(frames.matching(self.frame(), filter, compat=self.compat).select("seq"), "delete")
        n = gone.count()
        if n:
            self._store.rewrite(self.database.name, self.name, self.frame().join(gone, "seq", "left_anti"), gone, base)
        release(gone)
        return DeleteResult(n)

    def drop(self) -> None:
        self.database.drop_collection(self.name)

    def compact(self) -> None:
        """Store the collection as one part, after many small inserts."""
        self._store.compact(self.database.name, self.name)

    def create_index(self, keys, **_) -> str:
        """Accepted and ignored: there are no indexes."""
        pairs = sort_pairs(keys)
        return "_".join(f"{k}_{d}" for k, d in pairs)
