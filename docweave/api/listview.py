"""A list of documents or values with the query language on it."""

from __future__ import annotations

from docweave.api.cursor import sort_pairs
from docweave.compat import DEFAULT
from docweave.documents.frames import path_key
from docweave.documents.match import compile_filter
from docweave.documents.project import Projection, compile_projection
from docweave.functions.order import sort_key
from docweave.plans.spec import parse_filter


class QueryList(list):
    """For values already in memory; compares as the language does."""

    def find(self, filter: dict | None = None, projection=None, sort=None) -> QueryList:
        holds = compile_filter(parse_filter(filter or {}), DEFAULT)
        hits = []
        for x in self:
            hit: dict = {}
            if holds(x, hit):
                hits.append((x, hit))
        if sort:
            for path, direction in reversed(sort_pairs(sort)):
                hits.sort(key=lambda h, p=path, d=direction: path_key(h[0], p, d), reverse=direction == -1)
        if projection is not None:
            reduce_ = compile_projection(Projection(projection, filter), DEFAULT)
            hits = [(reduce_(x, hit) if isinstance(x, dict) else x, hit) for x, hit in hits]
        return QueryList(x for x, _ in hits)

    def sort(self, key_or_list=None, direction=None) -> None:
        """In place: by paths, or by the values themselves."""
        if key_or_list is None or isinstance(key_or_list, int):
            super().sort(key=sort_key, reverse=key_or_list == -1)
            return
        for path, order in reversed(sort_pairs(key_or_list, direction)):
            super().sort(key=lambda x, p=path, d=order: path_key(x, p, d), reverse=order == -1)

    def _key(self) -> bytes:
        return sort_key(list(self))

    def __eq__(self, other) -> bool:
        return isinstance(other, list) and self._key() == sort_key(list(other))

    def __ne__(self, other) -> bool:
        return not self == other

    __hash__ = None

    def __lt__(self, other) -> bool:
        return self._key() < sort_key(other)

    def __le__(self, other) -> bool:
        return self._key() <= sort_key(other)

    def __gt__(self, other) -> bool:
        return self._key() > sort_key(other)

    def __ge__(self, other) -> bool:
        return self._key() >= sort_key(other)

    def _not_supported(self, *_, **__):
        raise NotImplementedError("a list is only queried")

    update_one = update_many = replace_one = delete_one = delete_many = _not_supported
