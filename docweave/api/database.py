"""Databases: names of collections."""

from __future__ import annotations

from docweave.api.collection import Collection
from docweave.errors import CollectionInvalid, InvalidName


def check_collection_name(name: str) -> None:
    if not isinstance(name, str):
        raise TypeError("a collection name is a string")
    if not name or ".." in name or name.startswith(".") or name.endswith("."):
        raise InvalidName("collection names cannot be empty")
    if "$" in name:
        raise InvalidName(f"collection names must not contain '$': {name!r}")
    if name.startswith("system."):
        raise InvalidName(f"invalid system namespace: {name!r}")
    if "\x00" in name:
        raise InvalidName("collection names must not contain NUL")


class Database:
    def __init__(self, client, name: str):
        self.client, self.name = client, name

    def __repr__(self) -> str:
        return f"Database({self.name!r})"

    def __eq__(self, other) -> bool:
        return isinstance(other, Database) and (self.client, self.name) == (other.client, other.name)

    def __hash__(self) -> int:
        return hash(self.name)

    def __getattr__(self, name: str) -> Collection:
        if name[:1] == "_":
            raise AttributeError(f"a collection named {name!r} is reached by db[{name!r}]")
        return self.get_collection(name)

    def __getitem__(self, name: str) -> Collection:
        return self.get_collection(name)

    def get_collection(self, name: str, **_) -> Collection:
        check_collection_name(name)
        return Collection(self, name)

    def list_collection_names(self) -> list[str]:
        return self.client.store.collections(self.name)

    collection_names = list_collection_names

    def create_collection(self, name: str, **_) -> Collection:
        collection = self.get_collection(name)
        if name in self.list_collection_names():
            raise CollectionInvalid(f"collection {name} already exists")
        self.client.store.create(self.name, name)
        return collection

    def drop_collection(self, name_or_collection) -> None:
        name = name_or_collection.name if isinstance(name_or_collection, Collection) else name_or_collection
        if not isinstance(name, str):
            raise TypeError("a collection is given by its name or itself")
        self.client.store.drop(self.name, name)
