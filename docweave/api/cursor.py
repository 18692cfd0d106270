"""Cursors: a query that runs when its first document is asked for."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from docweave.documents import frames
from docweave.errors import InvalidOperation, OperationFailure
from docweave.functions import ejson
from docweave.plans.spec import parse_filter

#: Methods of the cursor API that exist elsewhere and raise NotImplementedError here.
_UNSUPPORTED = ("collation", "comment", "distinct", "hint", "max", "max_await_time_ms", "max_time_ms", "min", "remove_option", "where", "batch_size")


class CursorType:
    """Accepted for compatibility; tailable cursors end like all others."""

    NON_TAILABLE, TAILABLE, TAILABLE_AWAIT, EXHAUST = 0, 2, 34, 64


def sort_pairs(key_or_list, direction=None) -> list[tuple[str, int]]:
    if isinstance(key_or_list, str):
        pairs = [(key_or_list, 1 if direction is None else direction)]
    elif isinstance(key_or_list, dict) or not isinstance(key_or_list, (list, tuple)):
        raise TypeError("a sort is a name or a list of (name, direction) pairs")
    elif direction is not None:
        raise TypeError("with a list of pairs the direction goes into the pairs")
    else:
        pairs = [(k, 1) if isinstance(k, str) else tuple(k) for k in key_or_list]
    if not pairs:
        raise ValueError("the sort is empty")
    for name, order in pairs:
        if not isinstance(name, str):
            raise TypeError("sort keys are strings")
        if isinstance(order, bool) or order not in (1, -1):
            raise OperationFailure("a sort direction is 1 or -1", 2)
    return pairs


class Cursor:
    def __init__(self, collection, filter=None, projection=None, skip=0, limit=0, no_cursor_timeout=False, cursor_type=CursorType.NON_TAILABLE, sort=None, max_scan=None, **_):
        if filter is not None and not isinstance(filter, dict):
            raise TypeError("a filter is a dict")
        for name, value in (("skip", skip), ("limit", limit)):
            if not isinstance(value, int) or isinstance(value, bool):
                raise TypeError(f"{name} is an int")
        if skip < 0:
            raise ValueError("skip must be >= 0")
        if projection is not None and not isinstance(projection, (dict, list, tuple)):
            raise TypeError("a projection is a dict or a list of names")
        if cursor_type not in (0, 2, 34, 64):
            raise ValueError("not a valid cursor type")
        self._collection, self._filter, self._projection = collection, filter or {}, projection
        self._skip, self._limit, self._max_scan = skip, limit, max_scan
        self._sort = sort_pairs(sort) if sort else []
        self._documents: Iterator | None = None
        self._retrieved, self._closed = 0, False

    # -- building -------------------------------------------------------

    def _still_open(self) -> None:
        if self._documents is not None:
            raise InvalidOperation("cannot set options after executing query")

    def sort(self, key_or_list, direction=None) -> Cursor:
        self._still_open()
        self._sort = sort_pairs(key_or_list, direction)
        return self

    def skip(self, n: int) -> Cursor:
        if not isinstance(n, int) or isinstance(n, bool):
            raise TypeError("skip is an int")
        if n < 0:
            raise ValueError("skip must be >= 0")
        self._still_open()
        self._skip = n
        return self

    def limit(self, n: int) -> Cursor:
        if not isinstance(n, int) or isinstance(n, bool):
            raise TypeError("limit is an int")
        self._still_open()
        self._limit = n
        return self

    def max_scan(self, n: int) -> Cursor:
        self._still_open()
        self._max_scan = n
        return self

    def __getattr__(self, name: str):
        if name in _UNSUPPORTED:
            raise NotImplementedError(f"cursor.{name} is not supported")
        raise AttributeError(name)

    def clone(self) -> Cursor:
        return Cursor(self._collection, self._filter, self._projection, self._skip, self._limit, sort=list(self._sort) or None, max_scan=self._max_scan)

    __copy__ = clone

    def __deepcopy__(self, memo) -> Cursor:
        return self.clone()

    def rewind(self) -> Cursor:
        self._documents, self._retrieved, self._closed = None, 0, False
        return self

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __getitem__(self, index):
        self._still_open()
        if isinstance(index, slice):
            if index.step is not None:
                raise IndexError("a cursor slice has no step")
            start = index.start or 0
            if start < 0 or (index.stop is not None and index.stop < 0):
                raise IndexError("a cursor slice has no negative index")
            out = self.clone()
            out._skip = start
            out._limit = 0
            if index.stop is not None:
                if index.stop < start:
                    raise IndexError("a cursor slice may not end before its start")
                if index.stop == start:
                    out._documents = iter(())
                out._limit = index.stop - start
            return out
        if not isinstance(index, int):
            raise TypeError(f"index {index!r} cannot be applied to a cursor")
        if index < 0:
            raise IndexError("a cursor has no negative index")
        one = self.clone()
        one._skip += index
        one._limit = -1
        for doc in one:
            return doc
        raise IndexError("no such item for Cursor instance")

    # -- running --------------------------------------------------------

    def _matching(self, sort=None) -> DataFrame:
        compat = self._collection.compat
        frame = self._collection.frame()
        if self._max_scan:
            frame = frame.orderBy("seq").limit(self._max_scan)
        return frames.matching(frame, self._filter, sort, compat)

    def frame(self) -> DataFrame:
        """The result as a table ``seq, id_key, doc``, in order.

        Order of work: scan limit, filter, sort, skip, limit, projection.
        """
        rows = frames.ordered(self._matching(self._sort), self._sort)
        if self._skip:
            rows = rows.offset(self._skip)
        if self._limit:
            rows = rows.limit(abs(self._limit))
        if self._projection is not None:
            spec = self._projection if self._projection or not isinstance(self._projection, dict) else {}
            if spec == {} or spec == []:
                spec = {"_id": 1}
            return frames.projected(rows, spec, self._filter, self._collection.compat)
        return rows.select("seq", "id_key", "doc")

    def explain(self, mode: str = "formatted") -> None:
        self.frame().explain(mode)

    def _run(self) -> Iterator[dict]:
        parse_filter(self._filter, self._collection.compat)
        document_class = self._collection.document_class
        for row in self.frame().toLocalIterator():
            if "error" in row and row.error:
                raise OperationFailure(*json.loads(row.error))
            doc = ejson.loads(row.doc)
            yield doc if document_class is dict else document_class(doc)

    def __iter__(self) -> Cursor:
        return self

    def __next__(self) -> dict:
        if self._closed:
            raise StopIteration
        if self._documents is None:
            self._documents = self._run()
        doc = next(self._documents)
        self._retrieved += 1
        return doc

    next = __next__

    def count(self, with_limit_and_skip: bool = False) -> int:
        """Matches, by default before skip and limit."""
        rows = self._matching()
        if with_limit_and_skip:
            rows = rows.offset(self._skip) if self._skip else rows
            rows = rows.limit(abs(self._limit)) if self._limit else rows
        return rows.count()

    @property
    def alive(self) -> bool:
        return not self._closed

    @property
    def retrieved(self) -> int:
        return self._retrieved

    @property
    def cursor_id(self) -> int | None:
        return None if self._documents is None else id(self)

    @property
    def address(self):
        return self._collection.database.client.address

    @property
    def collection(self):
        return self._collection
