"""Clients: a repository of databases in one storage engine."""

from __future__ import annotations

from docweave import __version__
from docweave.api.configure import current_repository, read_settings
from docweave.api.database import Database
from docweave.compat import CompatProfile
from docweave.errors import ConfigurationError, InvalidName, InvalidOperation
from docweave.session import get_session
from docweave.sources.store import ENGINES

_SCHEME = "docweave://"


def check_database_name(name: str) -> None:
    if not isinstance(name, str):
        raise TypeError("a database name is a string")
    if not name:
        raise InvalidName("database name cannot be empty")
    for c in '/\\. "$':
        if c in name:
            raise InvalidName(f"database names cannot contain the character {c!r}")


class WriteConcern:
    """Honoured by the SQLite engine; commits of snapshots are always whole and durable."""

    def __init__(self, wtimeout: int | None = None, **options):
        self.document = {"wtimeout": wtimeout} | options if wtimeout is not None else dict(options)


class Client:
    """Opens a repository: a folder, ``docweave://`` and a folder, or ``:memory:``."""

    def __init__(self, repository: str | None = None, document_class: type = dict, spark=None, storage: str | None = None, version: str | None = None, wtimeout: int | None = None, **options):
        repository = repository or current_repository()
        repository = repository.removeprefix(_SCHEME) or "."
        self.spark = spark or get_session()
        settings = {} if repository == ":memory:" else read_settings(repository)
        engine = "memory" if repository == ":memory:" else storage or settings.get("storage", "snapshot")
        if engine not in ENGINES:
            raise ConfigurationError(f"unknown storage engine {engine!r}; known are {sorted(ENGINES)}")
        self.store = ENGINES[engine](self.spark, repository)
        self.compat = CompatProfile.of(version or settings.get("version", "4.2"))
        self.document_class, self.address = document_class, repository
        self.write_concern = WriteConcern(wtimeout, **options)
        self.store.concern = self.write_concern.document
        self._open = True

    def __repr__(self) -> str:
        return f"Client({self.address!r})"

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __getattr__(self, name: str) -> Database:
        if name[:1] == "_":
            raise AttributeError(f"a database named {name!r} is reached by client[{name!r}]")
        return self.get_database(name)

    def __getitem__(self, name: str) -> Database:
        return self.get_database(name)

    def get_database(self, name: str, **_) -> Database:
        if not self._open:
            raise InvalidOperation("the client is closed")
        check_database_name(name)
        return Database(self, name)

    def list_database_names(self) -> list[str]:
        return self.store.databases()

    database_names = list_database_names

    def drop_database(self, name_or_database) -> None:
        name = name_or_database.name if isinstance(name_or_database, Database) else name_or_database
        if not isinstance(name, str):
            raise TypeError("a database is given by its name or itself")
        self.store.drop_database(name)

    def server_info(self) -> dict:
        return {"version": __version__, "engine": self.store.name, "compat": self.compat.version}

    def close(self) -> None:
        self._open = False
        self.store.close()
